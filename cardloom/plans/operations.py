"""Named queries of what surrounds the reading of cards: replaced tables, logs, outcomes, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outcome, review
from ..sources import connectors, staging
from ..sources.tables import new_folder
from ..streaming import logs
from . import analogs as A
from .analogs import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


@query(sql("SELECT card_id, review_version + 1 AS review_version, CASE WHEN review_status = 'pending' THEN 'flagged' ELSE review_status END AS review_status FROM results", "results"))
def table_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A table replaced by one made of it, after a replacement that was refused."""
    path = f"{new_folder(spark, 'replaced')}/results"
    staging.replace_table(A.results(spark, d).select("card_id", "review_version", "review_status"), path)

    def refuse(df: DataFrame) -> None:
        raise ValueError("refused")

    now = spark.read.parquet(path)
    try:
        staging.replace_table(now.where("false"), path, refuse)
    except ValueError:
        pass
    now = spark.read.parquet(path)
    staging.replace_table(now.select("card_id", (F.col("review_version") + 1).alias("review_version"), F.when(F.col("review_status") == "pending", "flagged").otherwise(F.col("review_status")).alias("review_status")), path)
    return spark.read.parquet(path)


@query(sql("SELECT card_id, video_id, CASE WHEN video_id IN ('src1', 'src2') THEN 9 ELSE review_version END AS review_version FROM results WHERE video_id IS NULL OR video_id NOT IN ('src1', 'src2', 'src3') OR (video_id <> 'src3' AND review_status <> 'flagged')", "results"))
def partitions_overwritten(spark: SparkSession, d: str) -> DataFrame:
    """Three videos processed anew, twice: of two their cards come again without the flagged ones, of one none."""
    path = f"{new_folder(spark, 'partitions')}/results"
    rows = A.results(spark, d).select("card_id", "review_version", "review_status", "video_id")
    staging.overwrite_partitions(rows, path, "video_id")
    new = rows.where("video_id IN ('src1', 'src2') AND review_status <> 'flagged'").withColumn("review_version", F.lit(9))
    for _ in range(2):
        staging.overwrite_partitions(new, path, "video_id", spark.createDataFrame([("src1",), ("src2",), ("src3",)], "video_id string"))
    return spark.read.schema("card_id long, review_version int, video_id string").parquet(path).select("card_id", "video_id", "review_version")


@query(sql("SELECT decision, count(*) AS n FROM decisions GROUP BY decision", "decisions"))
def log_tail_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a decision log that was appended to in batches, one of them replayed, and read from offsets."""
    path, kind = new_folder(spark, "log"), "event_id long, video_id long, decision string"
    rows = A.decisions(spark, d).select("event_id", "video_id", "decision")
    seen, at = None, -1
    for batch in (0, 1, 1, 2):
        logs.append_batch(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch), batch, path)
        new, at = logs.log_from(spark, path, kind, at)
        seen = new if seen is None else seen.unionByName(new)
    return seen.groupBy("decision").agg(F.count("*").alias("n"))


_FAILED = "(card_id % 5 = 1 AND video_id IN ('src1', 'src2')) OR video_id = 'src3'"


@query(sql(f"SELECT video_id, cards, failed, CASE WHEN failed > 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN failed = cards THEN 'recognition failed for all ' || cards || ' cards, for example: ' || first_error WHEN failed > 0 THEN 'recognition failed for ' || failed || ' of ' || cards || ' cards' END AS message FROM (SELECT video_id, count(*) AS cards, count(*) FILTER ({_FAILED}) AS failed, arg_min('timeout of card ' || card_id, sequence_index) FILTER ({_FAILED}) AS first_error FROM results GROUP BY video_id)", "results"))
def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = A.results(spark, d).withColumn("error", F.when(F.expr(_FAILED), F.concat(F.lit("timeout of card "), "card_id")))
    return outcome.outcomes(rows, "video_id")


class _First:
    """A model that reads the first word as the name."""

    def answer(self, image: bytes) -> dict:
        return {"deceased_name": (image.decode().split(" ") or [""])[0], "date_of_death": "2001-02-03"}


class _Picky:
    """A model that can't read texts of an odd number of characters."""

    def answer(self, image: bytes) -> dict:
        text = image.decode()
        if len(text) % 2:
            raise ValueError("unreadable")
        return {"deceased_name": text[:1], "date_of_death": None}


@query("SELECT doc_id AS card_id, m AS model_id, CASE m WHEN 'first' THEN trim(string_split(text, ' ')[1], ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) WHEN 'picky' THEN CASE WHEN length(text) % 2 = 0 THEN trim(left(text, 1), ' ' || chr(9) || chr(10) || chr(13)) ELSE '' END ELSE '' END AS deceased_name, CASE m WHEN 'first' THEN '2001-02-03' ELSE '' END AS date_of_death, CASE WHEN m = 'picky' AND length(text) % 2 = 1 THEN 'unreadable' WHEN m = 'absent' THEN 'no model is named absent' END AS error FROM documents, (VALUES ('first'), ('picky'), ('absent')) t(m)")
def routed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each text read by two models and by one that there isn't."""
    models = spark.createDataFrame([("first",), ("picky",), ("absent",)], "model_id string")
    asked = A.table(spark, d, "documents").select(F.col("doc_id").alias("card_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content")).crossJoin(F.broadcast(models))  # three models
    return connectors.routed(asked, {"first": _First, "picky": _Picky}).select("card_id", "model_id", "deceased_name", "date_of_death", "error")


_KIND = "CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END"


@query(
    f"WITH e AS (SELECT user_id AS job_id, ts, event_id, {_KIND} AS kind, CAST(round(value) AS INT) AS progress FROM events), "
    "s AS (SELECT job_id, arg_max(kind, (ts, event_id)) FILTER (kind IN ('running', 'completed', 'failed')) AS status, arg_max(CASE WHEN kind = 'completed' THEN 100 ELSE least(greatest(progress, 0), 100) END, (ts, event_id)) FILTER (kind IN ('progress', 'completed')) AS progress, "
    "max(ts) FILTER (kind = 'running') AS started_at, max(ts) FILTER (kind IN ('completed', 'failed')) AS completed_at, arg_max('event ' || event_id, (ts, event_id)) FILTER (kind = 'failed') AS error_message FROM e GROUP BY job_id) "
    "SELECT c_custkey AS job_id, coalesce(status, 'queued') AS status, coalesce(progress, 0)::INT AS progress, epoch_us(started_at) AS started_us, epoch_us(completed_at) AS completed_us, error_message FROM customer LEFT JOIN s ON job_id = c_custkey"
)
def job_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """States of a job for each customer, of whom some have events."""
    kind = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    events = A.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.round("value").cast("int").alias("progress"), F.concat(F.lit("event "), "event_id").alias("message"))
    out = review.job_states(A.table(spark, d, "customer").select(F.col("c_custkey").alias("job_id")), events)
    return out.select("job_id", "status", "progress", F.unix_micros("started_at").alias("started_us"), F.unix_micros("completed_at").alias("completed_us"), "error_message")


@query(sql("SELECT video_id, count(*) AS windows, count(*) FILTER (decision <> 'rejected_short_stable') AS candidates, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'rejected_blur') AS rejected_blur, count(*) FILTER (decision = 'rejected_dedup') AS rejected_dedup, count(*) FILTER (decision = 'rejected_short_stable') AS rejected_short_stable FROM decisions GROUP BY video_id", "decisions"))
def decision_totals(spark: SparkSession, d: str) -> DataFrame:
    return review.decision_totals(A.decisions(spark, d), "video_id")
