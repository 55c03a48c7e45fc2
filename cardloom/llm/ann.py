"""Approximate nearest neighbours by largest inner product, with adaptive dimension scans of inverted lists.

Nearness becomes distance in one more dimension: each vector is lengthened to the largest norm, so the nearest by
distance is the one of largest inner product. A bounded sample gives a random rotation, centroids, and the number of
lists to probe: the least one at which the sample's own queries find the target recall. Every row is put into the list
of its nearest centroid; a query whose lists hold few rows probes further ones. Lists are cut into chunks and the queries
that probe a list into blocks, so every task holds one chunk and one block, whatever the sizes. Within them columns of
rotated vectors are read in blocks; a hypothesis test on the partial distance abandons a candidate as soon as its whole
distance is unlikely to beat the query's present k-th nearest; the present k nearest stay. What survives is scored
exactly, in double precision on the original vectors. Queries that still have fewer than k rows, although there are more
candidates, are run over all lists, so a query gets fewer than k only where there are no more.

Cases: vectors that are null, empty, zero, of another length than the first usual one, or hold null or non-finite
components take no part, neither as candidate nor as query; null ids take no part; rows with one id are one candidate
each, and as queries each has a list of its own; a query leaves out all rows with its own id; finite vectors of any length are
found, though products of huge ones may be infinite; equal scores go to the smaller id; with few rows each query
gets all of them; an empty table gives an empty result; other columns of the input, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let
from .shared import cut

#: Vectors of the sample; rows of a list, of a chunk, and queries of a block; lists at most.
SAMPLE, LIST_ROWS, CHUNK, QUERIES, MOST_LISTS = 20_000, 4000, 16_384, 2048, 4096
#: Rows that a query's lists hold at least, as a multiple of k.
ENOUGH = 4
#: Columns of a block; strictness of the test (larger: fewer false abandonments); recall aimed at on the sample.
COLUMNS, STRICT, TARGET = 16, 2.1, 0.985


@dataclass
class Plan:
    """What tasks need of the index: bounded by MOST_LISTS and the square of the dimension."""

    rotation: np.ndarray
    centroids: np.ndarray
    longest: float
    probes: int
    scale: float = 1.0  # what vectors are divided by, so that their squares can't overflow


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component, so that all have the norm ``longest``."""
    return np.c_[x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)


def centroids_of(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from random rows."""
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([_distances(x[i : i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=n)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def planned(sample: np.ndarray, longest: float, rows: int, k: int) -> Plan:
    """Rotation, centroids and number of probes, from the sample and the number of all rows."""
    rng = np.random.default_rng(7)
    dims = sample.shape[1] + 1
    rotation, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    x = lengthened(sample, longest) @ rotation
    n = int(np.clip(rows // LIST_ROWS, 1, min(MOST_LISTS, max(1, len(x) // 8))))
    c = centroids_of(x, n, rng)
    if n == 1:
        return Plan(rotation, c, longest, 1)
    own = np.concatenate([_distances(x[i : i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)])
    tried = rng.choice(len(x), min(300, len(x)), replace=False)
    q = np.c_[sample[tried], np.zeros(len(tried))] @ rotation
    near = np.argsort(_distances(q, x), axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort(_distances(q, c), axis=1), axis=1)  # of each list among a query's lists
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return Plan(rotation, c, longest, int(needed[int(np.ceil(TARGET * len(needed))) - 1]) + 1)


def _list_of(batches: Iterator[pa.RecordBatch], plan: Plan, dims: int, lists: int, query: bool, sizes: np.ndarray | None = None, enough: int = 0) -> Iterator[pa.RecordBatch]:
    """Each vector's nearest lists: as many as ``lists``, or more until their ``sizes`` add up to ``enough``."""
    for b in batches:
        if not b.num_rows:
            continue
        names = [c for c in ("asked",) if c in b.schema.names]
        x = np.asarray(b.column(1).flatten(), float).reshape(-1, dims) / plan.scale
        turned = (np.c_[x, np.zeros(len(x))] if query else lengthened(x, plan.longest)) @ plan.rotation
        near: list[np.ndarray] = []
        for i in range(0, len(turned), 1024):
            order = np.argsort(_distances(turned[i : i + 1024], plan.centroids), axis=1, kind="stable").astype(np.int32)
            if sizes is None:
                near += list(order[:, :lists])
            else:
                most = np.maximum(lists, (np.cumsum(sizes[order], axis=1) < enough).sum(axis=1) + 1)
                near += [row[:m] for row, m in zip(order, most.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[b.column(c) for c in names], pa.array(near, pa.list_(pa.int32()))], names=["vec_id", "embedding", *names, "lists"])


def _stacked(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float)


def scan(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, plan: Plan) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places in x of its k nearest and their scores; ``own`` forbids pairs (True).

    While many candidates of a block of queries are left, columns are read for all of them at once; else for those left.
    """
    turned_x, turned_q = lengthened(x / plan.scale, plan.longest) @ plan.rotation, np.c_[q / plan.scale, np.zeros(len(q))] @ plan.rotation
    dims, least = turned_x.shape[1], min(k, len(x)) - 1
    apart, alive, far = np.zeros((len(q), len(x))), ~own, np.full((len(q), 1), np.inf)
    stay = np.zeros_like(alive)
    for at in range(0, dims, COLUMNS):
        end = min(at + COLUMNS, dims)
        a, b = turned_q[:, at:end], turned_x[:, at:end]
        if at == 0 or alive.mean() > 0.25:
            apart += _distances(a, b)
        else:
            i, j = np.nonzero(alive)
            apart[i, j] += ((a[i] - b[j]) ** 2).sum(axis=1)
        apart[~alive] = np.inf
        if at == 0 and len(x) > 2 * k:  # whole distances to what looks near so far give the distance to beat
            near = np.argpartition(apart, 2 * k - 1, axis=1)[:, : 2 * k]
            whole = ((turned_x[near] - turned_q[:, None]) ** 2).sum(axis=2) + np.where(np.take_along_axis(alive, near, axis=1), 0, np.inf)
            far = np.partition(whole, k - 1, axis=1)[:, k - 1 : k]
            np.put_along_axis(stay, near, (whole <= far) & np.isfinite(whole), axis=1)
        ratio = dims / end * (1 + STRICT / np.sqrt(end)) ** -2 if end < dims else 1.0
        alive &= stay | (apart * ratio <= far * (1 + 1e-9) + 1e-12)
    apart[~alive] = np.inf
    edge = np.partition(apart, least, axis=1)[:, least] if len(x) else far[:, 0]
    out = []
    for i in range(len(q)):  # with all that tie at the edge, which ids decide
        left = np.flatnonzero(alive[i] & (apart[i] <= edge[i] * (1 + 1e-9) + 1e-9))
        out.append((left, np.einsum("ij,j->i", x[left], q[i])))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, *, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k nearest rows found.

    Both tables have vec_id and embedding (array of float or double).
    """
    def sound(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & good)

    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = sound(vectors), sound(queries)
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not usual:
        return empty
    dims = usual["d"]
    rows, asked = rows.where(F.size("embedding") == dims), asked.where(F.size("embedding") == dims)
    # each query row stands for itself, whatever its id
    asked = cut(asked.withColumn("asked", F.monotonically_increasing_id()), "ann-queries")
    largest = F.array_max(F.transform("embedding", lambda c: F.abs(c)))
    norm = let(largest, lambda m: m * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, c: s + (c / m) * (c / m))))
    n, most = rows.agg(F.count("*"), F.max(F.least(norm, F.lit(1.7e308)))).first()
    # the sample: rows whose hash falls under a share that gives about half of what may come, then that bound
    share = min(1.0, 0.9 * sample / n)
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample).select("vec_id", "embedding").toPandas().sort_values("vec_id", kind="stable")
    if not len(some):
        some = rows.orderBy("vec_id").limit(1).toPandas()
    plan = planned(_stacked(some["embedding"]) / most, 1.0, n, k)
    plan.scale = float(most)
    held = vectors.sparkSession.sparkContext.broadcast(plan)
    schema = "vec_id long, embedding array<double>, lists array<int>"
    listed = rows.mapInArrow(lambda b: _list_of(b, held.value, dims, 1, False), schema)
    listed = cut(listed.select("vec_id", "embedding", F.col("lists")[0].alias("list")), "ann-lists")
    counts = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # MOST_LISTS rows at most
    held_by = np.asarray([counts.get(i, 0) for i in range(len(plan.centroids))], np.int64)
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    key = ["list", "chunk", "block"]

    def compare(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"asked": [], "query_id": [], "vec_id": [], "score": []}).astype({"asked": "int64", "query_id": "int64", "vec_id": "int64"})
        ids, asks, rows_asked, vx, vq, parts = x["vec_id"].to_numpy(), q["vec_id"].to_numpy(), q["asked"].to_numpy(), _stacked(x["embedding"]), _stacked(q["embedding"]), []
        for i in range(0, len(asks), 256):
            a = asks[i : i + 256]
            for row, one, (places, scores) in zip(rows_asked[i : i + 256], a, scan(vq[i : i + 256], vx, a[:, None] == ids, k, held.value), strict=True):
                order = np.lexsort((ids[places], -scores))[:k]
                parts.append((np.full(len(order), row), np.full(len(order), one), ids[places][order], scores[order]))
        return pd.DataFrame({c: np.concatenate([p[j] for p in parts]) for j, c in enumerate(("asked", "query_id", "vec_id", "score"))})

    def found(asked: DataFrame, lists: int, name: str) -> DataFrame:
        """The k nearest rows to each query of those in its nearest lists, written."""
        probing = asked.mapInArrow(lambda b: _list_of(b, held.value, dims, lists, True, held_by, ENOUGH * k), "vec_id long, embedding array<double>, asked long, lists array<int>")
        probing = cut(probing.select("vec_id", "embedding", "asked", F.explode("lists").alias("list")), f"ann-probes{name}")
        blocks = probing.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
        grid = F.broadcast(cut(sizes.join(blocks, "list"), f"ann-grid{name}"))  # a row for each list: MOST_LISTS at most
        left = listed.join(grid, "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        right = probing.join(grid, "list").withColumn("block", F.pmod(F.xxhash64("asked", F.lit(1)), "blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        pairs = left.select(*key, "vec_id", "embedding").groupBy(*key).cogroup(right.select(*key, "vec_id", "embedding", "asked").groupBy(*key)).applyInPandas(compare, "asked long, query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
        return cut(pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("asked", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), f"ann-found{name}")

    out = found(asked, plan.probes, "")
    # queries with fewer rows than there are candidates
    ids = asked.select("asked", "vec_id")
    own = rows.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("own"))
    got = out.groupBy("asked").agg(F.count("*").alias("got"))
    few = ids.join(own, "vec_id", "left").join(got, "asked", "left").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), n - F.coalesce("own", F.lit(0))))
    few = cut(few.select("asked"), "ann-few")
    if few.isEmpty():
        return out.drop("asked")
    again = found(asked.join(few, "asked", "left_semi").select("vec_id", "embedding", "asked"), len(plan.centroids), "-again")
    return out.join(few, "asked", "left_anti").unionByName(again).drop("asked")
