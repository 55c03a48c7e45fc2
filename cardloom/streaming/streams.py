"""Login limits and windowed counts over unbounded input; the segmenter is in ``segments``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Groups that clients are dealt into by a hash. Calls for state and timers are made once for each group and batch, not for each client.
GROUPS = 512


class Limiter(StatefulProcessor):
    """State of a group of clients: of each its recent failures and until when it is locked out; it goes when neither can matter any more."""

    def __init__(self, failures: int, seconds: float, locked: float):
        self._failures, self._seconds, self._locked = failures, seconds, locked

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getListState("clients", "client string, recent array<double>, until double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {client: (list(recent), until) for client, recent, until in self._state.get()}
        r = pd.concat(list(rows)).sort_values("at", kind="stable")
        refused = []
        for client, at, ok in zip(r["client"], r["at"].tolist(), r["ok"].tolist(), strict=True):
            recent, until = known.get(client, ((), 0.0))
            refused.append(at < until)
            if not refused[-1]:
                recent = [] if ok else [*(x for x in recent if x >= at - self._seconds), at]
                known[client] = ([], at + self._locked) if len(recent) >= self._failures else (recent, until)
        ends = {c: 1000 * max([until, *(x + self._seconds for x in recent)]) for c, (recent, until) in known.items()}
        passed = timerValues.getCurrentWatermarkInMs()  # attempts of later batches are later than that
        left = [(c, *known[c]) for c, end in ends.items() if end > max(passed, 0)]
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if left:
            self._state.put(left)
            self._handle.registerTimer(int(max(ends.values())) + 1)
        else:
            self._state.clear()
        yield pd.DataFrame({"client": r["client"], "at": r["at"], "ok": r["ok"].astype(bool), "refused": refused})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._state.clear()
        return iter([])


def lockouts(attempts: DataFrame, *, failures: int = 5, seconds: int = 60, locked: int = 900, late: str = "0 seconds") -> DataFrame:
    """Attempts (client, at seconds, ok) with whether each was refused: so many failures within so many seconds lock a
    client out for a while; a success clears them; refused attempts are not recorded. Attempts later than the watermark are dropped."""
    group, kind = F.pmod(F.xxhash64("client"), F.lit(GROUPS)).cast("int"), attempts.schema["client"].dataType
    named = F.col("client").cast("string").alias("client")  # pandas would hold long ids as doubles where a batch has a null one
    timed = attempts.select(named, "at", "ok", group.alias("group"), F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts")).withWatermark("ts", late)
    out = timed.groupBy("group").transformWithStateInPandas(Limiter(failures, seconds, locked), "client string, at double, ok boolean, refused boolean", "Append", "EventTime")
    return out.withColumn("client", F.col("client").cast(kind))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type in tumbling windows, closed when the watermark passes them. (Beyond what was asked for.)"""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
