"""Best-fit packing of tokenized documents into sequences, as a tree of partial packings.

Each task encodes its documents, cuts long ones and packs the pieces by best fit, longest first. Bins that are nearly
full are done. The others become items themselves, as long as they are full, and meet the bins of other tasks in
further rounds of best fit, each over groups of bounded size that are dealt anew, until one group holds all that is
left or a round no longer helps. A piece's place is its place in its first bin plus the places of the bins that hold it.

Cases: texts of any length are encoded whole; pieces of equal length keep their order; a null text counts as empty and yields one piece that holds only the end token; null ids, repeated ids and
repeated rows are separate documents, each with its own pieces; an empty table gives an empty result; other columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .tokenizer import encoder

#: Pieces that a task packs together, and unfilled bins that a later round packs together.
TOGETHER, GROUP = 100_000, 200_000
#: A bin within this share of the limit is nearly full.
NEARLY = 1 / 128
#: A round must save this share of the open bins to be followed by another.
GAIN = 0.002

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first. Gives each item's bin (from 0) and place in it, and each bin's fill.

    Open bins are kept by the room they have, with a bit for each room that some bin has, so finding the tightest
    bin that fits takes a shift and a look at the lowest bit.
    """
    bins, places, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    rooms: list[list[int]] = [[] for _ in range(limit + 1)]
    some = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            room, b = limit, len(fills)
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += n
        if left := room - n:
            rooms[left].append(b)
            some |= 1 << left
    return bins, places, np.asarray(fills, np.int64)


def pieces_of(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, and what is left over at the front."""
    first = length % limit or min(length, limit)
    return [(0, first), *((s, limit) for s in range(first, length, limit))]


def _pack_locally(path: str, limit: int, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, made, rows = encoder(path).ids, TaskContext.get().partitionId() << 40, []

        def packed() -> pa.RecordBatch:
            nonlocal made
            lengths = np.asarray([r[3] for r in rows], np.int64)
            bins, places, fills = best_fit(lengths, limit)
            cols = [pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([])] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            out = [c.cast(t) for c, t in zip(cols, types, strict=True)] + [pa.array(bins + made), pa.array(places), pa.array(fills[bins] if len(bins) else bins)]
            made += len(fills)
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "fill"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = ids(text.as_py() or "")
                if end is not None:
                    got = np.append(got, np.uint32(end))
                got = got.astype("<u4", copy=False)
                for k, (s, n) in enumerate(pieces_of(len(got), limit)):
                    if n:
                        rows.append((doc_id, k, s, n, zlib.crc32(got[s : s + n])))
            if len(rows) >= TOGETHER:
                yield packed()
        if rows:
            yield packed()

    return run


def _pack_bins(limit: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        ids, fills = t.column("bin").to_numpy(), t.column("fill").to_numpy()
        order = np.argsort(ids, kind="stable")  # the same result however the rows arrive
        ids, fills = ids[order], fills[order]
        bins, places, full = best_fit(fills, limit)
        made = (level << 60) + (TaskContext.get().partitionId() << 40)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bins + made), pa.array(places), pa.array(full[bins])], names=["bin", "into", "shift", "fill"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 1024, end: int | None = 2, rounds: int = 6) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    first = cut(light.mapInArrow(_pack_locally(tokenizer_path, limit, end), PIECES), "pack-pieces")
    done_at = limit - int(limit * NEARLY)
    open_bins = cut(first.where(F.col("fill") < done_at).select("bin", "fill").distinct(), "pack-open")
    way = open_bins.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("shift"))
    n = open_bins.count()
    for level in range(1, rounds + 1):
        if n < 2:
            break
        groups = -(-n // GROUP)
        dealt = open_bins.repartition(groups, F.xxhash64("bin", F.lit(level)))
        step = cut(dealt.mapInArrow(_pack_bins(limit, level), "bin long, into long, shift long, fill long"), f"pack-round{level}")
        link = step.select(F.col("bin").alias("from"), F.col("into").alias("next"), F.col("shift").alias("more"))
        way = way.join(link, F.col("into") == F.col("from"), "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        open_bins = step.where(F.col("fill") < done_at).select(F.col("into").alias("bin"), "fill").distinct()
        left, made = step.agg(F.count_distinct(F.when(F.col("fill") < done_at, F.col("into"))), F.count_distinct("into")).first()
        if groups == 1 or made > (1 - GAIN) * n:
            break
        n = left
    way = way.select(F.col("bin").alias("open"), "into", "shift")
    moved = first.where(F.col("fill") < done_at).join(way, F.col("bin") == F.col("open")).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("into").alias("sequence_id"), (F.col("place") + F.col("shift")).alias("offset"))
    stayed = first.where(F.col("fill") >= done_at).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    return stayed.unionByName(moved)
