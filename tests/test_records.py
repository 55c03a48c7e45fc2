"""Dates of several forms, filled fields, assembled confidences, motion, failures and fallbacks on literal cases."""

from cardloom.functions import dates, scoring, text
from cardloom.operators import extract, review, segmentation
from cardloom.sources import connectors
from pyspark.sql import functions as F


def test_dates_of_any_form(spark):
    cases = {"6/27/1966": "1966-06-27", "December 14, 2004": "2004-12-14", "dec 4, 2004": "2004-12-04", "3-20-94": "1994-03-20", "3-20-68": "2068-03-20", "3/20/69": "1969-03-20", "3/20-69": "3/20-69", " 2/30/2001 ": "2/30/2001", "soon": "soon", " ": None, None: None}
    df = spark.createDataFrame([(x, y) for x, y in cases.items()], "x string, want string")
    assert [r for r in df.select("x", "want", dates.any_form(F.col("x")).alias("got")).collect() if r["got"] != r["want"]] == []


def test_served_addresses(spark):
    df = spark.createDataFrame([("/d/f/v/c.jpg",), ("/d/f2/c.jpg",), ("/d/f/../x.jpg",), (None,)], "p string")
    assert [r[0] for r in df.select(text.image_url(F.col("p"), "/d/f/")).collect()] == ["/static/frames/v/c.jpg", None, None, None]


def test_blank_fields_are_filled_by_acceptable_values_only(spark):
    row = spark.createDataFrame([({"address": " ", "relation": "son", "undertaker": None, "date_of_death": None}, {"address": "12 Elm St", "relation": "wife", "undertaker": "Undertaker", "date_of_death": "1/2/1950", "other": "x"})], "a map<string,string>, b map<string,string>")
    assert row.select(extract.merged_missing(F.col("a"), F.col("b"))).first()[0] == {"address": "12 Elm St", "relation": "son", "undertaker": None, "date_of_death": None}


def test_assembled_confidences(spark):
    values = {"deceased_name": "SMITH, John", "phone": "404", "sex": " ", "age": "5", "address": "owner"}
    confidence = dict.fromkeys(values, 0.3)
    df = spark.createDataFrame([(values, confidence, {"age": True, "sex": True}, {"phone": 1.5}, 0.9)], "v map<string,string>, c map<string,double>, s map<string,boolean>, g map<string,double>, card double")
    got = lambda card: df.select(scoring.assembled(F.col("v"), F.col("c"), F.col("s"), F.col("g"), card)).first()[0]
    assert got(F.col("card")) == {"deceased_name": 0.82, "phone": 1.0, "sex": 0.0, "age": 0.3, "address": 0.25}
    assert got(F.lit(None).cast("double")) == {"deceased_name": 0.3, "phone": 1.0, "sex": 0.0, "age": 0.3, "address": 0.3}


def test_motion_of_arrays(spark):
    df = spark.createDataFrame([(1, 1, [0.0, 2.0]), (1, 2, [1.0, 4.0]), (1, 3, None), (2, 7, [5.0, 5.0])], "video_id int, frame_number int, roi array<double>")
    assert [r[0] for r in segmentation.with_motion(df, "roi").orderBy("video_id", "frame_number").select("motion").collect()] == [None, 1.5, None, None]


def test_failures_make_and_overwrite_results(spark):
    now = spark.createDataFrame([(1, 0.9, "approved", "A", "t1", None), (2, 0.8, "pending", "B", "t2", "old")], "card_id long, confidence_score double, review_status string, deceased_name string, raw_text string, error_message string")
    out = review.with_failures(now, spark.createDataFrame([(2, "busy"), (3, "gone")], "card_id long, error string"), ["deceased_name"]).orderBy("card_id")
    assert [tuple(r) for r in out.collect()] == [(1, 0.9, "approved", "A", "t1", None), (2, 0.0, "flagged", None, "t2", "busy"), (3, 0.0, "flagged", None, None, "gone")]


def test_no_image_is_read_twice_by_an_engine(spark, tmp_path):
    def maker(name, fails):
        class Engine:
            def read(self, image):
                with open(f"{tmp_path}/{name}", "ab") as f:
                    f.write(image)
                if fails:
                    raise ValueError("unreadable")
                return name, 1.0

        return Engine

    df = spark.createDataFrame([("1", bytearray(b"x")), ("2", bytearray(b"x"))], "card_id string, content binary")
    got = connectors.with_fallback(df, maker("first", True), maker("second", False), backoff=0.0).collect()
    assert {r["raw_text"] for r in got} == {"second"} and [(tmp_path / n).read_bytes() for n in ("first", "second")] == [b"xx", b"xx"]
