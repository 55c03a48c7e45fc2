"""Fields of pages of words with boxes: hand-made pages, and what is to be read from them."""

import re

import pytest
from __spark_entry__ import queries
from cardloom.functions import page as P
from cardloom.operators import layout
from cardloom.plans.layouts import _placed
from pyspark.sql import functions as F

PAGE = "card_id long, words array<struct<text:string,confidence:int,bbox:array<int>>>"


def words(text, step=60, cell=10, rise=0):
    """Words where they stand in the text: ``cell`` pixels a character, ``step`` a line; every second word ``rise`` lower."""
    out = []
    for y, line in enumerate(text.strip("\n").split("\n")):
        for k, m in enumerate(re.finditer(r"\S+", line)):
            top = y * step + (k % 2) * rise
            out.append((m[0], 90, [m.start() * cell, top, m.end() * cell, top + 14]))
    return out


FIRST = """
ADAMS, James      5566 Marbut Road Lithonia, GA.
ESTATE            c/o Mrs. Helen Reaves
Phone             (404) 784-2878
Date of Death     December 8, 2004
Date of Burial    12-14-2004
DOB               6/27/1966
LOT# 316  Range B  Grave# 2
Section 4         Block 5 Northside
Sex M   Age 38   Type of Grave SVC Vault   Grave Fee $675.00
Undertaker        Haugabrooks Funeral                          x
SVC No            49,711
"""
SECOND = """
PARKS (Mrs.) Barbara   12 Elm Street   Atlanta 303 14
Contact Information
Date of Death Date of Burial   Qctober 30,2021 October 16, 2021
Dacof Birth
March 9,1950
Description: Lot #64 Range G Gave #9
Section #2
Block 2 eastside
Sex: F   Age: 71   Type of Grave: Adult Vault Large   Grave Fee: $125.00
"""
COLONS = """
PARKS, Barbara
Contact Information
Date of Death
9/5/1948
Sex: F   Age: 7(1   Type of Grave: Adult   Grave Fee: 35.50
"""
BARE = """
JOHN  SMITH             12  Elm
nothing else
"""
PAGES = {
    1: (FIRST, {
        "owner_name": "ADAMS, James", "owner_address": "5566 Marbut Road Lithonia, GA.", "care_of": "c/o Mrs. Helen Reaves", "phone": "(404) 784-2878", "date_of_death": "2004-12-08", "date_of_burial": "2004-12-14", "date_of_birth": "1966-06-27",
        "lot_no": "316", "range": "B", "grave_no": "2", "section_no": "4", "block_side": "Block 5 Northside", "sex": "M", "age": "38", "type_of_grave": "SVC Vault", "grave_fee": "675", "undertaker": "Haugabrooks", "svc_no": "49,711",
    }),
    # the pair of dates on the line of both labels fills what the layout lacks; what the plain row of text gives stands, colons and all;
    # a side that is neither north nor south is told twice
    2: (SECOND, {
        "owner_name": "PARKS (Mrs.) Barbara", "owner_address": "12 Elm Street Atlanta 303 14", "date_of_death": "October 30, 2021", "date_of_burial": "2021-10-16", "date_of_birth": "March 9, 1950", "lot_no": "64", "range": "G", "grave_no": "9",
        "section_no": "2", "block_side": "Block 2 Eastside eastside", "sex": "F", "age": "71", "type_of_grave": ": Adult Vault Large", "grave_fee": "125",
    }),
    3: (COLONS, {"owner_name": "PARKS, Barbara", "date_of_death": "9/5/1948", "sex": "F", "age": "7", "type_of_grave": ": Adult", "grave_fee": "35.50"}),
    4: (BARE, {"owner_name": "JOHN SMITH", "owner_address": "12 Elm"}),
    5: ("", {}),
}


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(k, words(t) if t else []) for k, (t, _) in PAGES.items()], PAGE).withColumn("__keep", F.lit(1)).drop("__keep")
    return {r["card_id"]: r["fields"] for r in layout.parsed(df).collect()}


@pytest.mark.parametrize("k", PAGES)
def test_fields_of_pages(read, k):
    got = {f: read[k][f]["value"] for f in layout.FIELDS}
    assert {f: v for f, v in got.items() if v is not None} == PAGES[k][1]


def test_support_is_where_a_value_was_looked_for(read):
    assert read[1]["date_of_death"]["support"] == [[180, 180, 260, 194], [270, 180, 290, 194], [300, 180, 340, 194]]
    assert len(read[1]["owner_name"]["support"]) == 4 and read[1]["svc_no"]["support"] == [] and read[4]["sex"]["support"] == []


def test_the_chain_is_for_damaged_pages_only(spark):
    df = spark.createDataFrame([(k, words(t)) for k, (t, _) in PAGES.items() if t], PAGE)
    assert {r["card_id"]: r["d"] for r in layout.by_layout(df).select("card_id", layout.is_damaged().alias("d")).collect()} == {1: False, 2: True, 3: True, 4: False}


def values(spark, rows, kind, *columns):
    return [tuple(r) for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {kind}").orderBy("k").select(*columns).collect()]


def test_dates_as_they_are_written(spark):
    t = F.col("t")
    rows = [("on 0ctober 3, 202] or",), ("9/5/48 and May 3, 1950",), ("3-20-1994",), ("none",), ("35-2094)",), ("--3--20-94-",), ("99-9999",)]
    got = values(spark, rows, "t string", layout.written_date(t), layout.short_hyphens(t), layout.mended_hyphens(t))
    assert [g[0] for g in got] == ["October 3, 2021", "May 3, 1950", "3-20-1994", None, None, None, None]
    assert got[2][1] == "3-20-94" and got[3][1] == "none"
    assert [g[2] for g in got[4:]] == ["3-20-94", "3-20-94", None]
    loose = values(spark, [("Qctober 03,2021 to May 4, 1950)",), ("1/02/50 3-4-1950",), (None,)], "t string", layout.loose_dates(t))
    assert [x for (x,) in loose] == [["October 3, 2021", "May 4, 1950"], ["1/2/50", "3/4/1950"], []]


def test_locations_in_one_line(spark):
    got = values(spark, [("Description: Lot #64~- Range G- Grave 9- Section 2~ Block @ SS",), ("Lot",)], "t string", layout.compact_location(F.col("t")))
    assert [tuple(x) for (x,) in got] == [("64", "G", "9", "2", "Block 2 SS"), (None,) * 5]


def test_row_of_labels_by_words(spark):
    """Without a line of text that has it all: sex by its word, type between the word grave and the fee, without junk."""
    df = spark.createDataFrame([(1, words("Sex_M___  Age 61\n\nx", 20) + [("Grave", 90, [300, 8, 350, 20]), ("hoy", 90, [360, 8, 390, 20]), ("Adult", 90, [400, 8, 450, 20]), ("Vault", 90, [460, 8, 500, 20]), ("Fe$", 90, [520, 8, 550, 20]), ("125-00", 90, [560, 8, 600, 20])])], PAGE)
    row = df.withColumn("row", layout.row_words(F.col("words"))).select(layout.row_of_layout(F.col("row")).alias("r")).first()["r"]
    assert tuple(row) == ("M", "61", "Adult Vault", "125.00")


def test_service_anchor_prefers_the_left_and_a_number_sign(spark):
    page = [("SVC", 90, [500, 0, 530, 12]), ("SVC", 90, [10, 40, 40, 52]), ("SVC", 90, [12, 100, 42, 112]), ("NO", 90, [50, 100, 70, 112]), ("12345", 90, [80, 100, 120, 112]), ("end", 90, [900, 300, 1000, 312])]
    df = spark.createDataFrame([(1, page), (2, page[:2] + page[5:]), (3, page[:1] + page[5:])], PAGE).withColumn("w", P.width(F.col("words")))
    got = df.orderBy("card_id").select(layout.service_anchor(F.col("words"), F.col("w")).alias("a"), layout.service_of_layout(F.col("words"), F.col("w")).alias("v")).collect()
    assert [(r["a"][0], r["v"]) for r in got] == [(12, "12345"), (10, None), (500, None)]


def test_type_and_fee_by_words(spark):
    page = words("Type nothing here\n\n\n\n\nType of Grave Adult Vault      Fee   $75.25\n\nend")
    other = words("Type Child   Grave 9")
    df = spark.createDataFrame([(1, page), (2, other), (3, words("none"))], PAGE)
    got = df.orderBy("card_id").select(layout.type_and_fee(F.col("words"), P.width(F.col("words"))).alias("t")).collect()
    assert [r["t"] and tuple(r["t"]) for r in got] == [("Adult Vault Fee", "75.25"), ("Child", None), None]


NAMES = [
    ("ESTATE of x\nADAMS, James (Mr.)\nSMITH-JONES, Ann\n5 Elm St", "ADAMS, James", 3),
    ("LONGNAME, Ann\nLEE, Bo\nx", "LEE, Bo", 2),
    ("James Carl 5566 Marbut Road\nADAMS,\nDate of death", "ADAMS, James Carl", 6),
    ("Owner\nADAMS\nx", "ADAMS,", 1),
    ("Mary Ann Smith 12 Elm\nsome more", "Mary Ann Smith", 5),
    ("", None, 0),
]


def test_names_from_words(spark):
    """By the three strategies; words of a line may stand a little apart in height."""
    df = spark.createDataFrame([(k, words(t, rise=5) if t else []) for k, (t, _, _) in enumerate(NAMES)], PAGE)
    rows = df.select("card_id", layout.name_of_words(F.col("words")).alias("n")).orderBy("card_id").collect()
    assert [(r["n"] and r["n"]["value"], r["n"] and len(r["n"]["support"])) for r in rows] == [(v, n) for _, v, n in NAMES]


def test_lines_follow_running_means(spark):
    """The first open line that is near enough takes a word, by the mean of what it has so far."""
    page = [("a", 1, [0, 0, 5, 10]), ("b", 1, [50, 8, 55, 18]), ("c", 1, [20, 14, 25, 24]), ("d", 1, [9, 18, 14, 30]), ("  ", 1, [0, 1, 2, 3]), ("z", 1, [0, 90, 5, 100])]
    df = spark.createDataFrame([(1, page), (2, [])], PAGE)
    got = df.orderBy("card_id").select(P.texts(P.lines(F.col("words"), 10.0))).collect()
    assert [r[0] for r in got] == [["a c b", "d", "z"], []]


def test_a_name_that_holds_the_label_is_no_anchor(spark, tmp_path):
    """Documents whose first word, the form's name, holds or is ``death``; the first template's third of them states a date."""
    spark.createDataFrame([(k, t) for k, t in ((3, "Edeath of it"), (6, "Death came"), (9, "plain"), (4, "Death"), (5, "Death"), (12, None))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["card_id"]: r["date_of_death"] for r in queries()["words_date_of_death"](spark, str(tmp_path)).collect()}
    assert got == {3: "1970-01-04", 6: "1970-01-07", 9: "1970-01-10", 4: None, 5: None, 12: "1970-01-13"}


def test_a_line_of_equal_edges_is_one_step(spark):
    """Words of one line are one run for the fold, and the forms' lines are split once each, not for every word."""
    q = "array<struct<y:int,x:int,i:int,w:struct<text:string,confidence:int,bbox:array<int>>>>"
    queue = [(20 * (k // 50), k, k, (str(k), 1, [k, 20 * (k // 50), k + 1, 20 * (k // 50) + 12])) for k in range(100)]
    runs = spark.createDataFrame([(queue,)], f"q {q}").select(P._runs(F.col("q"))).first()[0]
    assert [tuple(r) for r in runs] == [(0, 6.0, 1, 50), (20, 26.0, 51, 50)]
    plan = spark.createDataFrame([("a  b c",)], "t string").select(_placed([F.col("t")]).alias("w"))
    assert plan._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert [(w["text"], w["bbox"]) for w in plan.first()["w"]] == [("a", [0, 0, 10, 14]), ("b", [30, 0, 40, 14]), ("c", [50, 0, 60, 14])]
