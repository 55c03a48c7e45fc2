"""Named queries that run a stream over the test events to its end, in batches that cut through whatever is open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import new_folder
from ..streaming import segments, streams
from . import analogs as A
from .frames import _CHOSEN, _DECISIONS, SHORT, _with

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Spans of time that the events are read in, one batch each.
BATCHES = 6


def in_batches(spark: SparkSession, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make`` over a stream of files. Each part is written when all before it have been read, by a query that starts anew
    from its checkpoint, so that state is carried over between batches and between runs."""
    base = new_folder(spark, "stream")
    for k, v in segments.STATE_STORE.items():
        spark.conf.set(k, v)
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        out = make(spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{base}/in"))
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def spans(rows: DataFrame, ts: str, n: int) -> list[DataFrame]:
    """``rows`` in ``n`` spans of time of equal length."""
    low, high = rows.agg(F.unix_micros(F.min(ts)), F.unix_micros(F.max(ts))).first()
    if low is None:
        return [rows]
    at = F.least(F.floor((F.unix_micros(ts) - F.lit(low)) * n / F.lit(high - low + 1)), F.lit(n - 1))
    return [rows.where(at == k) for k in range(n)]


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return A.frames(spark, d, F.col("ts").cast("timestamp").alias("ts"))


def stream_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The decision log as a stream: windows go on from batch to batch, repeats are told from captures of earlier batches, and
    videos end by their timers, which a frame of a later day lets expire."""
    f = _frames(spark, d)
    later = f.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("video_id"), F.lit(1).alias("frame_number"), F.lit(None).cast("double").alias("motion"), F.lit(None).cast("double").alias("sharpness"), F.lit(None).cast("long").alias("hash"), (F.col("ts") + F.expr("INTERVAL 9000 DAYS")).alias("ts"))
    out = in_batches(spark, [*spans(f, "ts", BATCHES), later], lambda s: segments.decision_stream(s, SHORT, idle=8000 * 86400.0))
    return out.select("video_id", F.col("segment").cast("long").alias("segment"), "decision", "sequence_index", "frame_number", "needs_review")


def stream_segments(spark: SparkSession, d: str) -> DataFrame:
    """The windows of the batch form by a stream in which each video's last frame is marked."""
    f = _frames(spark, d)
    last = f.groupBy(F.col("video_id").alias("v")).agg(F.max("frame_number").alias("last"))
    f = f.join(last, F.col("video_id") == F.col("v")).withColumn("final", F.col("frame_number") == F.col("last")).drop("v", "last")
    out = in_batches(spark, spans(f, "ts", 2), lambda s: segments.decision_stream(s, SHORT, idle=8000 * 86400.0))
    return out.select("video_id", "segment", "first_frame", "final_frame", "frames", "frame_number")


def stream_login_limiter(spark: SparkSession, d: str) -> DataFrame:
    """Refused attempts, in batches."""
    e = A.table(spark, d, "events").select(F.col("user_id").alias("client"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("double").alias("at"), (F.col("event_type") == "purchase").alias("ok"))
    parts = spans(e.withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))), "ts", 3)
    return in_batches(spark, [p.drop("ts") for p in parts], lambda s: streams.lockouts(s, failures=3, seconds=20_000, locked=50_000))


QUERIES |= {"stream_segments_equal_batch": stream_segments, "stream_decisions": stream_decisions, "stream_login_limiter": stream_login_limiter}
ORACLES["stream_segments_equal_batch"] = _with(_CHOSEN, "SELECT video_id, segment::INT AS segment, first_frame, final_frame, frames::INT AS frames, frame_number FROM chosen")
ORACLES["stream_decisions"] = _DECISIONS
ORACLES["stream_login_limiter"] = """
WITH RECURSIVE attempts AS (SELECT user_id AS client, epoch_us(ts) / 1e6 AS t, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
fold AS (SELECT client, 0::BIGINT AS n, 0.0::DOUBLE AS t, false AS ok, false AS refused, []::DOUBLE[] AS recent, 0.0::DOUBLE AS until FROM (SELECT DISTINCT client FROM attempts)
  UNION ALL SELECT client, n, t, ok, refused, CASE WHEN full_up THEN []::DOUBLE[] ELSE failed END, CASE WHEN full_up THEN t + 50000 ELSE until END
  FROM (SELECT *, NOT refused AND len(failed) >= 3 AS full_up FROM (SELECT *, CASE WHEN refused THEN near WHEN ok THEN []::DOUBLE[] ELSE list_append(near, t) END AS failed
    FROM (SELECT a.client, a.n, a.t, a.ok, a.t < f.until AS refused, list_filter(f.recent, lambda x: x >= a.t - 20000) AS near, f.until FROM fold f JOIN attempts a ON a.client = f.client AND a.n = f.n + 1))))
SELECT client, t AS "at", ok, refused FROM fold WHERE n > 0
"""
