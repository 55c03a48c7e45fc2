"""Named queries of the model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from . import analogs as A
from .analogs import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_DOUBLES = ("name_accuracy", "dod_accuracy", "exact_accuracy", "error_rate", "latency_avg", "latency_p50", "latency_p95", "latency_min", "latency_max", "latency_total")
_MEASURES = "count(*) AS total, count(*) FILTER (name_match) AS name_correct, count(*) FILTER (dod_match) AS dod_correct, count(*) FILTER (exact_match) AS exact_correct, round(count(*) FILTER (name_match) / count(*)::DOUBLE, 6) AS name_accuracy, round(count(*) FILTER (dod_match) / count(*)::DOUBLE, 6) AS dod_accuracy, round(count(*) FILTER (exact_match) / count(*)::DOUBLE, 6) AS exact_accuracy, count(*) FILTER (trim(coalesce(error, '')) <> '') AS errors, round(count(*) FILTER (trim(coalesce(error, '')) <> '') / count(*)::DOUBLE, 6) AS error_rate, round(avg(latency_ms), 6) AS latency_avg, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95, round(min(latency_ms), 6) AS latency_min, round(max(latency_ms), 6) AS latency_max, round(sum(latency_ms), 6) AS latency_total"
_JUDGED = f"adjudicated AS (SELECT p.card_id, p.model_id, difficulty_bucket, latency_ms, error, coalesce(human_name_correct, name_match) AS name_match, coalesce(human_dod_correct, dod_match) AS dod_match, coalesce(human_name_correct, name_match) AND coalesce(human_dod_correct, dod_match) AS exact_match FROM predictions p LEFT JOIN adjudications a ON p.card_id = a.card_id AND p.model_id = a.model_id)"
_WITH = f"WITH predictions AS ({A.SQL['predictions']}), adjudications AS ({A.SQL['adjudications']}), {_JUDGED} "


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in _DOUBLES else c for c in df.columns])


def _adjudicated(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.adjudicated(A.predictions(spark, d), A.adjudications(spark, d))


@query(_WITH + f"SELECT model_id, {_MEASURES} FROM adjudicated GROUP BY model_id")
def eval_model_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.summary(_adjudicated(spark, d), "model_id"))


@query(_WITH + f"SELECT model_id, difficulty_bucket, {_MEASURES} FROM adjudicated GROUP BY model_id, difficulty_bucket")
def eval_bucket_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.summary(_adjudicated(spark, d), "model_id", "difficulty_bucket"))


@query(sql("SELECT model_id, difficulty_bucket, count(*) AS total, count(*) FILTER (exact_match) AS exact_correct FROM predictions GROUP BY GROUPING SETS ((model_id), (model_id, difficulty_bucket))", "predictions"))
def eval_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary_levels(A.predictions(spark, d))


@query(_WITH + f", s AS (SELECT model_id, {_MEASURES} FROM adjudicated GROUP BY model_id) SELECT model_id, exact_accuracy, row_number() OVER (ORDER BY exact_correct / total::DOUBLE DESC, name_correct / total::DOUBLE DESC, dod_correct / total::DOUBLE DESC, errors, latency_avg NULLS LAST, model_id)::INT AS rank FROM s")
def eval_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.ranking(evaluation.summary(_adjudicated(spark, d), "model_id"))).select("model_id", "exact_accuracy", "rank")


@query(sql("SELECT card_id, model_id, name_match, dod_match FROM predictions WHERE NOT exact_match", "predictions"))
def eval_adjudication_queue(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.to_adjudicate(A.predictions(spark, d)).select("card_id", "model_id", "name_match", "dod_match")


@query("SELECT doc_id AS card_id, m AS model_id FROM labels, (VALUES ('alpha'), ('beta'), ('gamma')) t(m)")
def eval_cross_product(spark: SparkSession, d: str) -> DataFrame:
    return A.predictions(spark, d).select("card_id", "model_id")


@query(sql("SELECT count(DISTINCT card_id) AS cards FROM predictions", "predictions"))
def eval_distinct_cards(spark: SparkSession, d: str) -> DataFrame:
    return A.predictions(spark, d).agg(F.count_distinct("card_id").alias("cards"))


@query("SELECT doc_id AS card_id, doc_id % 3 <> 2 AS name_match, doc_id % 4 <> 1 AS dod_match, doc_id % 3 <> 2 AND doc_id % 4 <> 1 AS exact_match FROM labels")
def eval_normalized_match(spark: SparkSession, d: str) -> DataFrame:
    """Truth and prediction written differently: case, white space, and three layouts of one date."""
    day = F.date_add(F.lit("2004-01-05").cast("date"), (F.col("doc_id") % 5000).cast("int"))
    other = F.date_add(day, 1)
    shown = F.when(F.col("doc_id") % 4 == 1, F.date_format(other, "yyyy-MM-dd")).when(F.col("doc_id") % 4 == 2, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    rows = A.table(spark, d, "labels").select(
        F.col("doc_id").alias("card_id"), F.concat(F.lit("SMITH, John "), F.col("doc_id")).alias("gt_deceased_name"), F.date_format(day, "yyyy-MM-dd").alias("gt_date_of_death"),
        F.when(F.col("doc_id") % 3 == 2, "someone else").otherwise(F.concat(F.lit("  smith,   JOHN "), F.col("doc_id"))).alias("pred_deceased_name"), shown.alias("pred_date_of_death"), F.lit(None).cast("string").alias("error"),
    )
    return evaluation.compared(rows).select("card_id", "name_match", "dod_match", "exact_match")


def _line(cols: list[str]) -> str:
    return "'| ' || " + " || ' | ' || ".join(cols) + " || ' |'"


_PCT, _MS = "printf('%.2f%%', {0} * 100)", "printf('%.1f', {0})"
_P = {c: _PCT.format(c) for c in ("exact_accuracy", "name_accuracy", "dod_accuracy", "error_rate")}
_M = {c: _MS.format(c) for c in ("latency_avg", "latency_p50", "latency_p95")}


@query(
    _WITH.rstrip() + f", s AS (SELECT model_id, {_MEASURES} FROM adjudicated GROUP BY model_id), b AS (SELECT model_id, difficulty_bucket, {_MEASURES} FROM adjudicated GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (ORDER BY exact_correct / total::DOUBLE DESC, name_correct / total::DOUBLE DESC, dod_correct / total::DOUBLE DESC, errors, latency_avg NULLS LAST, model_id) AS rank FROM s), "
    "ls AS (SELECT 0 AS p, '' AS m, i AS q, '' AS k, line FROM (VALUES (0, '# Model comparison'), (1, ''), (2, 'Generated: 2024-01-01T00:00:00Z'), (3, ''), (4, '## Ranking'), (5, ''), (6, '| Rank | Model | Exact | Name | DoD | Errors | Avg RT (ms) | P95 RT (ms) |'), (7, '| --- | --- | ---: | ---: | ---: | ---: | ---: | ---: |')) t(i, line) "
    f"UNION ALL SELECT 1, '', rank, '', {_line(['rank', 'model_id', _P['exact_accuracy'], _P['name_accuracy'], _P['dod_accuracy'], 'errors', _M['latency_avg'], _M['latency_p95']])} FROM r "
    "UNION ALL SELECT 2, '', i, '', line FROM (VALUES (0, ''), (1, '## Per-Model Buckets'), (2, '')) t(i, line) "
    f"UNION ALL SELECT 3, model_id, i, '', line FROM (SELECT model_id, unnest(['### ' || model_id, '', 'Overall: exact=' || {_P['exact_accuracy']} || ', name=' || {_P['name_accuracy']} || ', dod=' || {_P['dod_accuracy']} || ', errors=' || errors || '/' || total || ' (' || {_P['error_rate']} || '), roundtrip avg=' || {_M['latency_avg']} || 'ms p50=' || {_M['latency_p50']} || 'ms p95=' || {_M['latency_p95']} || 'ms', '', '| Bucket | Exact | Name | DoD | Errors | Error Rate | N |', '| --- | ---: | ---: | ---: | ---: | ---: | ---: |', '']) AS line, unnest([0, 1, 2, 3, 4, 5, 7]) AS i FROM r) "
    f"UNION ALL SELECT 3, model_id, 6, difficulty_bucket, {_line(['difficulty_bucket', _P['exact_accuracy'], _P['name_accuracy'], _P['dod_accuracy'], 'errors', _P['error_rate'], 'total'])} FROM b) "
    "SELECT (row_number() OVER (ORDER BY p, m, q, k) - 1)::INT AS line_no, line FROM ls"
)
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the report."""
    return evaluation.report_lines(_rounded(evaluation.report(_adjudicated(spark, d))), "Model comparison", "2024-01-01T00:00:00Z")


@query("SELECT count(*) AS total, round(avg((doc_id % 3 <> 2)::INT), 6) AS name_accuracy, round(avg((doc_id % 4 <> 1)::INT), 6) AS dod_accuracy, round(avg((doc_id % 4 = 2)::INT), 6) AS dod_blank_ok_rate FROM labels")
def eval_two_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = A.table(spark, d, "labels").select(F.lit("A, B").alias("gt_deceased_name"), F.when(k % 3 == 2, "C").otherwise(" A, B ").alias("pred_deceased_name"), F.when(k % 4 != 2, "2001-02-03").alias("gt_date_of_death"), F.when(k % 4 == 2, " ").when(k % 4 != 1, "2001-02-03").alias("pred_date_of_death"))
    out = evaluation.two_field_accuracy(rows)
    return out.select("total", *[F.round(c, 6).alias(c) for c in ("name_accuracy", "dod_accuracy", "dod_blank_ok_rate")])


@query("SELECT o_orderpriority AS grp, round(quantile_cont(o_totalprice::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(o_totalprice::DOUBLE, 0.999), 6) AS p999, round(min(o_totalprice)::DOUBLE, 6) AS p0 FROM orders GROUP BY 1")
def eval_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over many different values."""
    out = evaluation.percentiles(A.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", {"p50": 0.5, "p999": 0.999, "p0": 0.0}, ranges=64)
    return out.select(F.col("o_orderpriority").alias("grp"), *[F.round(c, 6).alias(c) for c in ("p50", "p999", "p0")])
