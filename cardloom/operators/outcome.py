"""What a batch of recognized cards came to: counted by the pass that writes it, judged after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class BatchFailed(RuntimeError):
    """A batch in which a card failed."""


def _bad() -> Column:
    return F.trim(F.coalesce("error", F.lit(""))) != ""


def watched(results: DataFrame) -> tuple[DataFrame, Observation]:
    """results (error, sequence_index) with an observation of how many failed, and the error of the first failed card. It is filled
    by whatever action runs over the rows, at no pass of its own."""
    seen = Observation()
    first = F.min_by(F.when(_bad(), F.col("error")), F.when(_bad(), F.col("sequence_index")))
    return results.observe(seen, F.count(F.lit(1)).alias("cards"), F.count_if(_bad()).alias("failed"), first.alias("first_error")), seen


def message(cards: Column, failed: Column, first_error: Column) -> Column:
    """Why a batch fails, null if it doesn't: all of its cards failed, or some."""
    every = F.concat(F.lit("recognition failed for all "), cards, F.lit(" cards, for example: "), F.coalesce(first_error, F.lit("unknown error")))
    some = F.concat(F.lit("recognition failed for "), failed, F.lit(" of "), cards, F.lit(" cards"))
    return F.when((cards > 0) & (failed == cards), every).when(failed > 0, some)


def required(seen: Observation) -> dict:
    """The observation's counts; BatchFailed if a card failed. A batch without cards is fine."""
    got = seen.get
    if got["failed"]:
        if got["failed"] == got["cards"]:
            raise BatchFailed(f"recognition failed for all {got['cards']} cards, for example: {got['first_error'] or 'unknown error'}")
        raise BatchFailed(f"recognition failed for {got['failed']} of {got['cards']} cards")
    return got


def outcomes(results: DataFrame, by: str) -> DataFrame:
    """Of each video (or whatever ``by`` names): cards, failed, status of its job, and the message."""
    first = F.min_by(F.when(_bad(), F.col("error")), F.when(_bad(), F.col("sequence_index")))
    out = results.groupBy(by).agg(F.count("*").alias("cards"), F.count_if(_bad()).alias("failed"), first.alias("first_error"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("completed")).withColumn("message", message(F.col("cards"), F.col("failed"), F.col("first_error"))).drop("first_error")
