"""An append-only log as the sink of a stream, its tail, and what a stream says about its progress."""

from __future__ import annotations

import json
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from ..sources.staging import Folders


def append_batch(rows: DataFrame, batch: int, path: str) -> bool:
    """Appends a batch to a log as a part named by its number. A batch that is there already appends nothing; one that was left
    unfinished is written anew. Gives whether it was written."""
    part = f"{path}/batch={batch}"
    if Folders(rows.sparkSession, path).exists(f"{part}/_SUCCESS"):
        return False
    rows.write.mode("overwrite").parquet(part)
    return True


def appended(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer whose batches become parts of the log at ``path``, each once, however often a batch is replayed."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: append_batch(rows, batch, path) and None)


def log_from(spark: SparkSession, path: str, schema: str, after: int = -1) -> tuple[DataFrame, int]:
    """The log's rows of batches after ``after``, with their batch, and the last batch: where to go on from. Only finished parts
    are read."""
    fs = Folders(spark, path)
    there = sorted(int(n.split("=")[1]) for n in fs.children(path) if n.startswith("batch=") and fs.exists(f"{path}/{n}/_SUCCESS"))
    new = [n for n in there if n > after]
    empty = spark.createDataFrame([], schema)
    if not new:
        return empty.withColumn("batch", F.lit(None).cast("long")), after
    read = spark.read.schema(empty.schema).option("basePath", path).parquet(*[f"{path}/batch={n}" for n in new])
    return read.withColumn("batch", F.col("batch").cast("long")), new[-1]


class Progress(StreamingQueryListener):
    """Keeps a row for each batch of the queries it listens to, and how they ended. ``limit`` bounds what is kept: the latest."""

    SCHEMA = "query string, batch long, rows long, rows_per_second double, state_rows long, watermark string, ended boolean, error string"

    def __init__(self, limit: int = 10_000):
        self._rows: list[tuple] = []
        self._limit, self._lock = limit, Lock()

    def _keep(self, row: tuple) -> None:
        with self._lock:
            self._rows = [*self._rows, row][-self._limit :]

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        state = sum(s.get("numRowsTotal", 0) for s in p.get("stateOperators", []))
        self._keep((p.get("name") or p["id"], p["batchId"], p.get("numInputRows", 0), float(p.get("processedRowsPerSecond") or 0.0), state, (p.get("eventTime") or {}).get("watermark"), False, None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._keep((str(event.id), None, None, None, None, None, True, event.exception))

    def table(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            return spark.createDataFrame(list(self._rows), self.SCHEMA)
