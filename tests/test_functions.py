"""Column functions on literal cases."""

import pytest
from cardloom.functions import dates, geometry, numbers, scoring, text
from cardloom.functions.bind import let
from cardloom.operators import extract
from cardloom.params import Segmentation
from pyspark.sql import functions as F


def run(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (dates.iso_date, {"October 16, 2021": "2021-10-16", "Qctober 16, 202]": "2021-10-16", "3-20-41": "2041-03-20", "3/20/51": "1951-03-20", "2/30/2001": None, "Feb 29 2000": "2000-02-29", "soon": None, "1/2/123": None, "October 30,2021": "2021-10-30", "October 30 , 2021": "2021-10-30", "Dec 12, 199]": "1991-12-12", "10/30/19Z1": "1921-10-30"}),
        (dates.normal_date, {"2021-10-16": "2021-10-16", "  ": "", None: "", "10/30/2021": "2021-10-30", "2021-30-10": None}),
        (dates.repaired_compact, {"35-2094": "3-20-94", "3-20-94": "3-20-94"}),
        (text.standard_name, {"Parks, Carl jr. (owner)": "PARKS, Carl, Jr", "Mr. John Q. Public": "PUBLIC, John Q", "madonna": "MADONNA"}),
        (text.normal_name, {"  smith,   JOHN ": "smith, john", None: ""}),
        (lambda c: text.slug(c, 6), {"Smith, John": "SMITH_", None: "UNKNOW", "--": "UNKNOW"}),
        (text.outer_json, {"```json\n{\"a\": 1}\n```": '{"a": 1}', "none": None}),
        (text.base_name, {"C:\\a\\b.mp4": "b.mp4", "x/": "upload", None: "upload"}),
        (numbers.money, {"$675.00": "675.00", "675-00": "675.00", "$675": "675", "6O0.OO": "600.00", "none": None, "675 . 00": "675.00", "$5.00": None, "fee $ 40": "40"}),
        (numbers.phone, {"call (404) 555-1234 now": "(404) 555-1234", "404.555.1234": "404.555.1234", "12": None, "(404)784-2878": "(404)784-2878", "4045551234": "4045551234", "404 - 555 - 1234": "404 - 555 - 1234"}),
        (numbers.optional_flag, {"Yes": True, "f": False, " ": None, None: None}),
        (numbers.service_number, {"SVC No. 8O47": "8047", "svc 49,711": "49,711", "x": None}),
        (numbers.age, {"Age 6)": "61", "age: 73": "73", "": None}),
        (numbers.duration_text, {125.0: "2:05", 3.9: "0:03"}),
    ],
)
def test_cases(spark, f, cases):
    kind = "double" if any(isinstance(k, float) for k in cases) else "string"
    assert run(spark, f, list(cases), kind) == list(cases.values())


def test_errors_that_must_be_raised(spark):
    with pytest.raises(Exception, match="not a date"):
        run(spark, dates.strict_date, ["2021-30-10"])
    with pytest.raises(Exception, match="not a flag"):
        run(spark, numbers.optional_flag, ["maybe"])
    with pytest.raises(ValueError, match="enter"):
        Segmentation(enter=5.0, exit=6.0)


def test_let_names_a_value(spark):
    assert run(spark, lambda c: let(c * 2, lambda y: y + y), [1, 2], "int") == [4, 8]


def test_status_and_scores(spark):
    assert run(spark, scoring.review_status, [0.5, 0.7, 0.85, 0.95], "double") == ["flagged", "pending", "approved", "approved"]
    assert run(spark, lambda c: scoring.review_status(c, forced=F.lit(True)), [0.95], "double") == ["flagged"]
    assert run(spark, scoring.word_confidence, [None, 0.4, 88.0], "double") == [0.5, 0.4, 0.88]
    none = {f: F.lit("") for f in scoring.CORE_WEIGHTS}
    assert run(spark, lambda c: scoring.card_score(none, {f: c for f in none}), [0.9], "double") == [0.0]


def test_boxes(spark):
    df = spark.sql("SELECT array(0, 0, 10, 10) AS a, array(5, 0, 15, 10) AS b, array(20, 20, 30, 30) AS c")
    r = df.select(F.round(geometry.iou(F.col("a"), F.col("b")), 6).alias("x"), geometry.iou(F.col("a"), F.col("c")).alias("y")).first()
    assert r["x"] == 0.333333 and r["y"] == 0.0


CARD = """PARKS, Carl
Owner: Mary Parks  Relation: wife
Date of Death October 16, 2021
Date of Burial 10/20/2021
Description: Section 4 lot 12
Sex M  Age 73
Undertaker: Cox"""


def test_fields_of_a_card(spark):
    f = run(spark, extract.all_fields, [CARD])[0]
    want = {"deceased_name": "PARKS, Carl", "date_of_death": "2021-10-16", "date_of_burial": "2021-10-20", "sex": "M", "age": "73", "undertaker": "Cox", "relation": "wife", "owner": "Mary Parks"}
    assert {k: f[k] for k in want} == want and f["phone"] is None
    assert run(spark, extract.minimal_fields, ["nothing here", "only 3/4/1999 here"])[1]["date_of_death"] == "1999-03-04"


def test_answers(spark):
    got = run(spark, lambda c: extract.answer_fields(c, ("a", "b")), ['```json\n{"a": "1", "b": null}\n```', '{"a": 1}', "sorry"])
    assert [g["error"] for g in got] == [None, "missing: b", "no JSON"]
    texts = ['{"output": [{"content": [{"text": "x"}, {"text": "y"}]}]}', '{"candidates": [{"content": {"parts": [{"text": "z"}]}}]}', "{}"]
    assert run(spark, extract.answer_text, texts) == ["xy", "z", None]


def test_export_names_keep_all_digits_of_a_number(spark):
    name = lambda c: text.export_name(F.lit("Doe, Jo"), F.lit("1990-01-01"), c, F.lit(".jpg"))
    numbers_ = {7: "007", 123: "123", 999: "999", 1000: "1000", 1234: "1234", 12345: "12345"}
    assert run(spark, name, list(numbers_), "int") == [f"DOE_JO_1990_01_01__card_{n}.jpg" for n in numbers_.values()]


def test_labels_are_whole_words(spark):
    assert run(spark, text.label_hits, ["Date  of Death x\nSEX m AGE 3", "sections and pages", None]) == [3, 0, None]
    assert run(spark, text.is_label_like, ["Grave Fee: 3", "Cox"]) == [True, False]


def test_order_of_the_template(spark):
    card = "PARKS, Carl\nDate of Death x\nDate of Burial y\nDescription z\nSex M Age 3\nUndertaker Cox\nSVC No 8047"
    back = "\n".join(reversed(card.split("\n")[1:]))
    got = run(spark, scoring.template_order, [card, back, "", None, "Date of Death, x", "Sex m Age 7"])
    assert [round(x, 6) for x in got] == [0.48, -0.3, 0.0, 0.0, 0.0, 0.05]


def test_caps_of_scores_without_words(spark):
    rows = [("deceased_name", "x", 0.9), ("svc_no", "x", 0.9), ("phone", "x", 0.9), ("sex", "x", 0.9), ("sex", " ", 0.9), ("relation", "Owner", 0.9), ("age", "3", 0.1)]
    df = spark.createDataFrame(rows, "f string, v string, c double")
    got = [r[0] for r in df.select(scoring.heuristic_score(F.col("f"), F.col("v"), F.col("c"))).collect()]
    assert got == [0.82, 0.68, 0.60, 0.72, 0.0, 0.25, 0.1]


def test_mean_over_the_fields_that_are_there(spark):
    df = spark.sql("SELECT map('owner_name', 0.5D, 'svc_no', 1.0D, 'other', 9.0D) AS m UNION ALL SELECT map('x', 1.0D)")
    assert [round(r[0], 6) for r in df.select(scoring.weighted_score(F.col("m"))).collect()] == [round((0.05 + 0.08) / 0.18, 6), 0.0]


def test_thresholds_are_shares():
    from cardloom.params import Review

    assert Review().updated(review=0.5).review == 0.5
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(ValueError, match="auto_approve"):
            Review().updated(auto_approve=bad)
