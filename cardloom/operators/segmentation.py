"""Stable captures from ordered frame measurements: hysteresis segments, best frames, removal of repeats.

Without the backstop everything but repeats is windows over (video_id, frame_number): one shuffle by video, which all windows
share. Repeats and the backstop depend on decisions before them: there a video's rows pass in order, one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import mean_difference
from ..functions.numbers import rounded
from ..params import Backstop, Segmentation
from ..schemas import struct_of
from .tracker import Log, Tracker


def _order() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("frame_number")


def _past() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def with_motion(frames: DataFrame, pixels: str) -> DataFrame:
    """frames with motion: the mean absolute difference of an array of gray values to that of the frame before; null for a
    video's first frame."""
    return frames.withColumn("motion", mean_difference(F.col(pixels), F.lag(pixels).over(_order())))


def streak(condition: Column) -> Column:
    """How many rows in a row up to this one meet a condition; null (a first frame has no motion) doesn't."""
    row = F.row_number().over(_order())
    return row - F.coalesce(F.max(F.when(~F.coalesce(condition, F.lit(False)), F.col("__row"))).over(_past()), F.lit(0))


def streaks(frames: DataFrame, p: Segmentation = Segmentation()) -> DataFrame:
    """frames with high_streak and low_streak."""
    out = frames.withColumn("__row", F.row_number().over(_order()))
    hi, lo = F.col("motion") >= p.enter, F.col("motion") <= p.exit
    return out.withColumn("high_streak", streak(hi)).withColumn("low_streak", streak(lo)).drop("__row")


def members(frames: DataFrame, p: Segmentation = Segmentation()) -> DataFrame:
    """Frames of stable windows, with segment (from 1). A window starts with the low frames that made it stable."""
    out = streaks(frames, p)
    event = F.when(F.col("high_streak") >= p.enter_frames, "E").when(F.col("low_streak") >= p.exit_frames, "X")
    out = out.withColumn("event", event)
    latch, seen = F.last("event", ignorenulls=True).over(_past()), F.max(F.coalesce(F.col("event") == "E", F.lit(False))).over(_past())
    out = out.withColumn("stable", seen & (latch == "X"))
    out = out.withColumn("begins", F.col("stable") & ~F.coalesce(F.lag("stable").over(_order()), F.lit(False)))
    out = out.withColumn("island", F.sum(F.col("begins").cast("int")).over(_past()))
    ahead = _order().rowsBetween(1, p.exit_frames - 1)
    out = out.withColumn("seed", ~F.col("stable") & F.coalesce(F.max("begins").over(ahead), F.lit(False)))
    out = out.withColumn("after", F.lead("motion").over(_order())).withColumn("last_frame", F.max("frame_number").over(Window.partitionBy("video_id")))
    segment = F.when(F.col("seed"), F.col("island") + 1).otherwise(F.col("island"))
    return out.where("stable or seed").withColumn("segment", segment).drop("event", "begins", "island", "high_streak", "low_streak")


def candidates(frames: DataFrame, p: Segmentation = Segmentation()) -> DataFrame:
    """One row for each window: its bounds, whether the video ended in it, its best frame and how that was chosen.

    Inner frames of a window are candidates; their local motion is the mean of the differences to both neighbours. The
    best has the least local motion at or below the threshold; else sharpness less weighted local motion decides.
    """
    rows = members(frames, p)
    each = Window.partitionBy("video_id", "segment")
    rows = rows.withColumn("first", F.min("frame_number").over(each)).withColumn("final", F.max("frame_number").over(each))
    lm = rounded((F.col("motion") + F.col("after")) / 2, 6)
    inner = (F.col("frame_number") > F.col("first")) & (F.col("frame_number") < F.col("final"))
    rows = rows.withColumn("local_motion", F.when(inner, lm))
    calm = F.col("local_motion") <= p.candidate_motion
    found = F.struct("frame_number", "local_motion", "sharpness", *[c for c in ("hash",) if c in frames.columns])
    best = F.min_by(F.when(calm, found), F.when(calm, F.struct(F.col("local_motion"), -F.col("sharpness"), F.col("frame_number"))))
    rest = F.struct(rounded(-(F.col("sharpness") - p.fallback_weight * F.col("local_motion")), 6), F.col("local_motion"), -F.col("sharpness"), F.col("frame_number"))
    other = F.min_by(F.when(inner, found), F.when(inner, rest))
    out = rows.groupBy("video_id", "segment").agg(F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("final_frame"), F.count("*").alias("frames"), (F.max("frame_number") == F.max("last_frame")).alias("eof"), best.alias("best"), other.alias("other"))
    out = out.withColumn("fallback", F.col("best").isNull() & F.col("other").isNotNull()).withColumn("chosen", F.coalesce("best", "other"))
    return out.select("video_id", "segment", "first_frame", "final_frame", "frames", "eof", "fallback", "chosen.*")


def judged(found: DataFrame, p: Segmentation = Segmentation()) -> DataFrame:
    """candidates with decision (null while a duplicate check is due), needs_review and extraction_confidence."""
    short, blurry = F.col("frames") < p.min_frames, F.col("sharpness") < p.blur
    decision = F.when(short | F.col("frame_number").isNull(), "rejected_short_stable").when(blurry, "rejected_blur")
    review = (F.col("frames") < max(p.low_confidence_frames, p.min_frames)) | F.col("eof") | F.col("fallback") | F.coalesce(blurry, F.lit(False))
    return found.withColumn("decision", decision).withColumn("needs_review", review).withColumn("extraction_confidence", F.when(review, "low").otherwise("high"))


def _in_order(frames: DataFrame, key: str, order: str, columns: list[str], visit: Callable, schema: str) -> DataFrame:
    """``visit(key)`` makes a pair of functions for each key: one takes its rows one by one, in order, the other ends it; both
    give rows. Rows come sorted and are read as a stream, so a key of any length is never held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, current, step, end = to_arrow_schema(struct_of(schema)), None, None, None
        for b in batches:
            out: list[dict] = []
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if step is None or k != current:
                    out += end() if end else []
                    current, (step, end) = k, visit(k)
                out += step(*row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=to)
        if end and (out := list(end())):
            yield pa.RecordBatch.from_pylist(out, schema=to)

    return frames.repartition(F.col(key)).sortWithinPartitions(key, order).select(key, *columns).mapInArrow(run, schema)


def without_repeats(rows: DataFrame, key: str, order: str, distance: int) -> DataFrame:
    """rows (key, order, hash) with accepted, sequence_index and the distance to the last accepted row before.

    A row is a repeat if its hash is nearer than ``distance`` to the last accepted one, which only accepted rows move. A null
    hash is at no distance and accepted.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def visit(k):
        last, n = None, 0

        def step(o, bits):
            nonlocal last, n
            d = None if last is None or bits is None else ((last ^ bits) & (1 << 64) - 1).bit_count()
            ok = d is None or d >= distance
            if ok:
                last, n = bits, n + 1
            return [{key: k, order: o, "accepted": ok, "sequence_index": n if ok else None, "duplicate_distance": d}]

        return step, lambda: []

    return _in_order(rows, key, order, [order, "hash"], visit, f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean, sequence_index int, duplicate_distance int")


def decisions(frames: DataFrame, p: Segmentation = Segmentation()) -> DataFrame:
    """The decision log of all windows of frames (video_id, frame_number, motion, sharpness, hash)."""
    rows = judged(candidates(frames, p), p)
    kept = without_repeats(rows.where("decision is null").select("video_id", F.col("segment").cast("int").alias("segment"), "hash"), "video_id", "segment", p.duplicate_distance)
    kept = kept.withColumnsRenamed({"video_id": "__v", "segment": "__s"})
    out = rows.join(kept, (F.col("video_id") == F.col("__v")) & (F.col("segment") == F.col("__s")), "left")
    final = F.coalesce("decision", F.when(F.col("accepted"), "accepted").otherwise("rejected_dedup"))
    return out.withColumn("decision", final).drop("__v", "__s", "accepted")


WINDOWS = "segment int, first_frame int, final_frame int, frames int, eof boolean, fallback boolean, frame_number int, local_motion double, sharpness double, hash long"
LOGGED = f"{WINDOWS}, decision string, sequence_index int, needs_review boolean, extraction_confidence string, duplicate_distance int, duplicate_of_frame_number int"


def tracked(frames: DataFrame, p: Segmentation = Segmentation(), backstop: Backstop | None = None) -> DataFrame:
    """Windows by the state machine with their decisions, with the backstop if asked for.

    frames: video_id, frame_number, motion, sharpness, and if there are such hash and cells (array<double>).
    """
    for name, kind in (("hash", "long"), ("cells", "array<double>")):
        if name not in frames.columns:
            frames = frames.withColumn(name, F.lit(None).cast(kind))

    def visit(video):
        machine, log = Tracker(p, backstop), Log(p)

        def step(*row):
            return [{"video_id": video} | log.decided(w) for w in machine.push(*row)]

        return step, lambda: [{"video_id": video} | log.decided(w) for w in machine.finish()]

    kind = frames.schema["video_id"].dataType.simpleString()
    return _in_order(frames, "video_id", "frame_number", ["frame_number", "motion", "sharpness", "hash", "cells"], visit, f"video_id {kind}, {LOGGED}")
