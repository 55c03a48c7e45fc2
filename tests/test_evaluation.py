"""Percentiles, reports and small readers."""

import json

import numpy as np
import pytest
from cardloom.functions.numbers import fixed
from cardloom.functions.text import normal_path
from cardloom.operators import evaluation
from cardloom.sources import files
from pyspark.sql import functions as F


@pytest.mark.parametrize("ranges", [2, 7, 64, 256])
def test_percentiles_are_those_of_all_values(spark, ranges):
    rng = np.random.default_rng(2)
    groups = {"many": rng.normal(size=900), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([4.5]), "hot": np.r_[np.zeros(700), rng.normal(size=50)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("many", None), ("none", None), (None, 1.0), (None, 2.0)]
    shares = {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in evaluation.percentiles(df, ["g"], "v", shares, ranges).collect()}
    assert set(got) == {*groups, None}
    for g, vs in {**groups, None: np.array([1.0, 2.0])}.items():
        assert [got[g][k] for k in shares] == pytest.approx([np.quantile(vs, q) for q in shares.values()]), g
    whole = evaluation.percentiles(df, [], "v", {"p50": 0.5}, ranges).first()
    assert whole["p50"] == pytest.approx(np.median([v for _, v in rows if v is not None]))


@pytest.fixture(scope="module")
def rows(spark):
    p = [("a", "easy", True, True, 10.0, None), ("a", "hard", True, False, 30.0, None), ("b", "easy", False, False, 5.0, "x"), ("b", "easy", True, True, 7.0, " ")]
    df = spark.createDataFrame([(m, b, n, d, n and d, ms, e) for m, b, n, d, ms, e in p], "model_id string, difficulty_bucket string, name_match boolean, dod_match boolean, exact_match boolean, latency_ms double, error string")
    return evaluation.report(df)


def test_a_report_has_both_levels(rows):
    got = {(r["model_id"], r["difficulty_bucket"]): r for r in rows.collect()}
    assert set(got) == {("a", None), ("a", "easy"), ("a", "hard"), ("b", None), ("b", "easy")}
    assert (got["a", None]["total"], got["a", None]["exact_accuracy"], got["a", None]["latency_p50"], got["a", None]["rank"]) == (2, 0.5, 20.0, 1)
    assert (got["b", "easy"]["errors"], got["b", "easy"]["latency_p95"], got["b", "easy"]["rank"]) == (1, pytest.approx(6.9), 2)


def test_a_report_as_lines_in_a_file(spark, rows, tmp_path):
    files.write_report(evaluation.report_lines(rows, "Comparison", "now"), str(tmp_path / "r"))
    text = next(p for p in (tmp_path / "r").iterdir() if p.suffix == ".txt").read_text().split("\n")
    assert text[0] == "# Comparison" and text[2] == "Generated: now"
    assert text[8] == "| 1 | a | 50.00% | 100.00% | 50.00% | 0 | 20.0 | 29.0 |" and text[9].startswith("| 2 | b | 50.00% | 50.00%")
    at = text.index("### b")
    assert text[at + 2] == "Overall: exact=50.00%, name=50.00%, dod=50.00%, errors=1/2 (50.00%), roundtrip avg=6.0ms p50=6.0ms p95=6.9ms"
    assert text[at + 6] == "| easy | 50.00% | 50.00% | 50.00% | 1 | 50.00% | 2 |"


def test_a_report_as_a_document(rows):
    said = evaluation.report_json(rows, "now", False).first()["document"]
    got = json.loads(said)
    assert list(got) == sorted(got) and [m["model_id"] for m in got["models"]] == ["a", "b"] and [m["model_id"] for m in got["ranking"]] == ["a", "b"]
    assert [b["difficulty_bucket"] for b in got["models"][0]["by_difficulty"]] == ["easy", "hard"] and got["models"][0]["total"] == 2
    assert list(got["models"][0]) == sorted(got["models"][0])
    assert said == evaluation.report_json(rows, "now", False).first()["document"]


def test_ground_truth(spark, tmp_path):
    (tmp_path / "g.csv").write_text('filename,owner_name,date_of_death\na.png,"A, B", 2001-02-03\nb.png,C,   \n')
    assert [tuple(r) for r in files.read_ground_truth(spark, str(tmp_path / "g.csv")).collect()] == [("a.png", "A, B", "2001-02-03"), ("b.png", "C", None)]


def test_opinions_count_by_their_place(spark):
    p = spark.createDataFrame([("c", "m", False, False, False, 1.0, None)], "card_id string, model_id string, name_match boolean, dod_match boolean, exact_match boolean, latency_ms double, error string")
    o = spark.createDataFrame([("c", "m", True, True, 2), ("c", "m", False, None, 1)], "card_id string, model_id string, human_name_correct boolean, human_dod_correct boolean, row long").repartition(2)
    assert [(r["name_match"], r["dod_match"]) for r in evaluation.adjudicated(p, o).collect()] == [(True, True)]


def test_paths(spark):
    said = {"/a//b/./c/": "/a/b/c", "/../a/../b": "/b", "a/../../b": "../b", "~/x/../y": "/home/u/y", "../../x": "../../x", "/": "/", "": "", "a/b": "a/b", "~x": "~x"}
    df = spark.createDataFrame([(k,) for k in said], "p string")
    assert {r[0]: r[1] for r in df.select("p", normal_path(F.col("p"), "/home/u")).collect()} == said


def test_numbers_are_printed_of_their_exact_value(spark):
    values = [947.05, 0.25, 0.35, 58.545, 1234.75, 0.0, 499.8]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(99, None)], "k int, v double").orderBy("k")
    assert [r[0] for r in df.select(fixed(F.col("v"), 1)).collect()] == [f"{v:.1f}" for v in values] + ["null"]
    assert [r[0] for r in df.select(fixed(F.col("v"), 2)).collect()] == [f"{v:.2f}" for v in values] + ["null"]


def test_a_report_prints_percentiles_of_its_exact_value(spark):
    p = [("a", "easy", True, True, True, float(ms), None) for ms in (947.0, 948.0)]
    df = spark.createDataFrame(p, "model_id string, difficulty_bucket string, name_match boolean, dod_match boolean, exact_match boolean, latency_ms double, error string")
    rows = evaluation.report(df).withColumn("latency_p95", F.when(F.col("latency_p95").isNotNull(), F.lit(947.05)))
    assert "| 1 | a | 100.00% | 100.00% | 100.00% | 0 | 947.5 | 947.0 |" in [r["line"] for r in evaluation.report_lines(rows, "t", "now").collect()]
