"""Near-duplicate groups by a chosen-path set similarity join.

A document is its set of distinct word shingles. Documents with the same set (by a digest of 128 bits) are one class, named
by a number (the ``rep`` of all tables here) that no other class has; one of each class goes on. Each
set has K minwise tokens. In each of several independent trees a document starts at the node that one of its minwise
tokens names; a node with more than SMALL rows sends each of its rows on along BRANCHES of its minwise tokens, which
the node's path picks, so that similar sets likely share a path. Small nodes are compared exhaustively by their
minwise tokens, which leaves candidate pairs; these are confirmed on full sets, and confirmed links make components.

With similarity s a pair shares a given path token with probability s. At s = 0.8 a tree of one level finds it with
0.8, a tree of any depth with at least 0.75 (the fixed point of q = 1 - (1 - 0.8 q)^2, times 0.8), so eight trees miss
1.5e-5 of such pairs at most, and far fewer above. The comparison in a node drops a pair only if its estimate over K
tokens is more than four standard deviations under the threshold.

So that a group of many near copies doesn't turn into all its pairs, a first pass sorts the rows of each first node under a
few leaders, which stand in the middle of what is alike; a row that resembles a leader is linked to it. Large nodes do so in
blocks, which differ from tree to tree. Then the trees are followed as above, but only nodes that hold several of the
components so far go on, only pairs across them are compared, and of those only enough to join what belongs together
are kept. This makes families, which hold every likely pair. In each family the links to leaders are confirmed on full sets,
and then all likely pairs across what these leave apart: no link that would join two components is lost to the
short cut, and a group that is one component already costs nothing more. A node or family of any size is compared in
cells: its main component is dealt into blocks and its other rows into groups, each bounded in rows and shingles, and every
pair of a group with a block or a group is a cell of its own. What is alike without being linked still costs the square of
its rows, dealt over as many tasks.

Cases: texts of any length are compared by their whole sets; a null text, or one without words, has an empty set and is linked with nothing; fewer words than a shingle make
the whole sequence one shingle; a null id can't name a group, so such a row is returned alone with a null component and
kept; rows with one id share a component, whatever their texts; an empty table
gives an empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .shared import cut, row_key

#: Minwise tokens of a set; trees; rows of a small node; tokens that a larger node goes on with; levels at most.
K, TREES, SMALL, BRANCHES, DEPTH = 64, 8, 1024, 2, 6
#: Shingles of a block at most, on average.
HEAVY = 2_000_000
#: Leaders of a node in the first pass.
LEADERS = 8
#: Distinct words whose hashes a task remembers.
REMEMBERED = 500_000
#: Links that a task connects at once.
CHUNK = 200_000

_ODD = np.random.default_rng(20_240_117).integers(1, 2**63, size=(2, K), dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, words_each: int, known: _WordHashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(words_each, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """K minwise tokens: the smallest value under each of K hash functions, shortened to 31 bits."""
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(hashes), 2048):
        part = (hashes[s : s + 2048, None] * _ODD[0]) ^ _ODD[1]
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, part.min(axis=0), out=low)
    low ^= low >> np.uint64(32)
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int32)


def _signatures(words_each: int):
    """The first column holds texts; the others are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in batches:
            sizes, digests, tokens = [], [], []
            for text in b.column(0):
                h = shingle_hashes(text.as_py(), words_each, known)
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                tokens.append(minwise(h) if len(h) else None)
            made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *made], names=[*b.schema.names[1:], "n_shingles", "set_digest", "tokens"])

    return run


def _sets(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in batches:
            sets = [shingle_hashes(t.as_py(), words_each, known) for t in b.column(0)]
            digests = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["set_digest", "shingles"])

    return run


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole nodes, from rows that arrive sorted by path (and block)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        path = b.column("path").to_numpy()
        new = np.flatnonzero(path[1:] != path[:-1])
        if held and held[-1].column("path")[-1].as_py() != path[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, b.slice(0, new[-1] + 1)])
            held = [b.slice(new[-1] + 1)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    path, rep, n = (t.column(c).to_numpy() for c in ("path", "rep", "n"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(rep), K)
    starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    return rep, n, sig, starts, np.r_[starts[1:], len(rep)]


def _likely(sig: np.ndarray, n: np.ndarray, one: np.ndarray, its: int, threshold: float, least: int) -> np.ndarray:
    return ((sig == one).sum(axis=1) >= least) & (np.minimum(n, its) >= threshold * np.maximum(n, its))


def _least(threshold: float) -> int:
    return int(K * max(0.0, threshold - 4.4 * (threshold * (1 - threshold) / K) ** 0.5))


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if a:
        both = np.unique(np.sort(np.c_[np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def _center(sig: np.ndarray) -> int:
    """The row that agrees most with the commonest value of each place: near the middle of a large group of copies."""
    if len(sig) < 8:
        return 0
    counts = np.bincount((sig + np.arange(K, dtype=np.int64) * 256).ravel(), minlength=K * 256).reshape(K, 256)
    return int((sig == counts.argmax(axis=1).astype(np.uint8)).sum(axis=1).argmax())


def _under_leaders(threshold: float):
    """Links of each row of a node to the leader it resembles; rows that resemble none of LEADERS stay unlinked."""
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _nodes(batches):
            rep, n, sig, starts, ends = _columns(t)
            a, b = [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                rows = np.arange(s, e)
                for _ in range(LEADERS):
                    if len(rows) < 2:
                        break
                    at = _center(sig[rows])
                    one, rows = rows[at], np.delete(rows, at)
                    like = _likely(sig[rows], n[rows], sig[one], n[one], threshold, least)
                    if like.any():
                        a.append(np.full(int(like.sum()), rep[one]))
                        b.append(rep[rows[like]])
                        rows = rows[~like]
            yield from _pairs(a, b)

    return run


def _joined(label: np.ndarray, i: int, found: np.ndarray) -> np.ndarray:
    """Of the rows found to belong with row i, one for each label that isn't i's yet; all those labels become i's."""
    labels, first = np.unique(label[found], return_index=True)
    label[np.isin(label, labels)] = label[i]
    return found[first]


#: Which side of a cell each side meets: 1 meets itself, 0 and 2 meet each other.
_MEETS = (2, 1, 0)


class _Sets:
    """Sizes of intersections in a cell. Few are counted one by one; where many are asked for, all at once: shingles of
    many rows by a product of matrices, others by counting their pairs."""

    def __init__(self, offsets: np.ndarray, values: np.ndarray):
        self.offsets, self.values, self.asked, self.all = offsets, values, 0, None

    def with_row(self, i: int, rest: np.ndarray) -> np.ndarray:
        if self.all is not None:
            return self.all[i, rest]
        mine = self.values[self.offsets[i] : self.offsets[i + 1]]
        sizes = self.offsets[rest + 1] - self.offsets[rest]
        self.asked += int(sizes.sum())
        if self.asked > 8 * len(self.values):
            self.all = self.counted()
            return self.all[i, rest]
        theirs = np.concatenate([self.values[self.offsets[r] : self.offsets[r + 1]] for r in rest.tolist()])
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        return np.add.reduceat((mine[at] == theirs).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])

    def counted(self, often: int = 48, at_once: int = 2048) -> np.ndarray:
        rows = len(self.offsets) - 1
        row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(self.offsets))
        order = np.argsort(self.values, kind="stable")
        value, row = self.values[order], row[order]
        starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        n = np.diff(np.r_[starts, len(value)])
        out = np.zeros((rows, rows), np.int64)
        many = starts[n >= often]
        for k in range(0, len(many), at_once):
            part = np.zeros((rows, min(at_once, len(many) - k)), np.float32)
            for j, s in enumerate(many[k : k + at_once].tolist()):
                e = np.searchsorted(value, value[s], side="right")
                part[row[s:e], j] = 1
            out += (part @ part.T).astype(np.int64)
        for size in np.unique(n[(n > 1) & (n < often)]).tolist():  # shingles of equally many rows together
            held = row[starts[n == size][:, None] + np.arange(size)]
            for k in range(0, len(held), max(1, 4_000_000 // size**2)):
                some = held[k : k + max(1, 4_000_000 // size**2)]
                out += np.bincount((some[:, :, None] * rows + some[:, None, :]).ravel(), minlength=rows * rows).reshape(rows, rows)
        return out


def _across(threshold: float, percent: int | None = None):
    """Links that join components of a cell: likely ones, or with ``percent`` those confirmed on the rows' full sets.

    Rows come by size, so a row looks no further than the largest set that can be like its own. A link makes one
    component of two at once, so a cell yields fewer links than it has rows.
    """
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _nodes(batches):
            rep, n, sig, starts, ends = _columns(t)
            side = t.column("side").to_numpy()
            _, label = np.unique(t.column("comp").to_numpy(), return_inverse=True)
            if percent is not None:
                sets = t.column("shingles").combine_chunks()
                offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)  # in the order they were sorted in
            a, b = [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                label_here, side_here, sig_here = label[s:e], side[s:e], sig[s:e]
                upto = np.searchsorted(n[s:e], n[s:e] / threshold + 1e-9, side="right")
                held = _Sets(offsets[s : e + 1] - offsets[s], values[offsets[s] : offsets[e]]) if percent is not None else None
                for i in range(e - s - 1):
                    if upto[i] <= i + 1:
                        continue
                    rest = np.arange(i + 1, upto[i])
                    rest = rest[(side_here[rest] == _MEETS[side_here[i]]) & (label_here[rest] != label_here[i])]
                    if len(rest):
                        rest = rest[(sig_here[rest] == sig_here[i]).sum(axis=1) >= least]
                    if len(rest) and held:
                        both = held.with_row(i, rest)
                        rest = rest[100 * both >= percent * (n[s + i] + n[s + rest] - both)]
                    if len(rest):
                        ends_of = _joined(label_here, i, rest)
                        a.append(np.full(len(ends_of), rep[s + i]))
                        b.append(rep[s + ends_of])
            yield from _pairs(a, b)

    return run


def roots(reps: DataFrame) -> DataFrame:
    """(path, rep, rows) of the first nodes of all trees that hold more than one row."""
    tree = F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "token")
    rows = reps.select("rep", tree).select("rep", F.xxhash64("tree", "token").alias("path"))
    counts = rows.groupBy("path").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    return rows.join(counts, "path")


def mixed(rows: DataFrame, key: str) -> DataFrame:
    """Of rows (key, rep, comp, mass) those of nodes that hold several components, with rows and mass of the node, its main
    component and what isn't part of that."""
    shares = rows.groupBy(key, "comp").agg(F.count("*").alias("n"), F.sum("mass").alias("m"))
    nodes = shares.groupBy(key).agg(F.sum("n").alias("rows"), F.sum("m").alias("node_mass"), F.max(F.struct("n", "comp", "m")).alias("most"), F.count("*").alias("comps")).where(F.col("comps") > 1)
    nodes = nodes.select(key, "rows", "node_mass", F.col("most.comp").alias("main"), (F.col("rows") - F.col("most.n")).alias("others"), (F.col("node_mass") - F.col("most.m")).alias("other_mass"))
    return rows.select(key, "rep", "comp").join(nodes, key)


def blocked(rows: DataFrame, key: str) -> DataFrame:
    """(path, rep, comp, side) of the cells of nodes from mixed(). A small node is one cell, in which all meet. Of a larger one
    the main component is dealt into blocks and the others into groups; each group meets each block, each other group,
    and itself."""
    dealt = lambda n, mass: F.greatest(F.ceil(n / SMALL), F.ceil(mass / HEAVY), F.lit(1)).cast("long")
    blocks, groups = dealt(F.col("rows") - F.col("others"), F.col("node_mass") - F.col("other_mass")), dealt(F.col("others"), F.col("other_mass"))
    whole, main = dealt(F.col("rows"), F.col("node_mass")) == 1, F.col("comp") == F.col("main")
    out = rows.select(key, "rep", "comp", whole.alias("whole"), main.alias("is_main"), blocks.alias("blocks"), groups.alias("groups"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("blocks")).otherwise(F.col("groups")))
    out = out.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"))
    zero, o = F.lit(0).cast("long"), F.col("own")
    in_blocks = F.transform(upto(F.col("groups")), lambda g: cell(0, g, o, F.lit(0)))
    with_blocks = F.transform(upto(F.col("blocks")), lambda b: cell(0, o, b, F.lit(2)))
    with_groups = F.transform(upto(F.col("groups")), lambda g: cell(1, F.least(g, o), F.greatest(g, o), F.when(g == o, 1).when(g < o, 2).otherwise(0)))
    cells = F.when(F.col("whole"), F.array(cell(2, zero, zero, F.lit(1)))).when(F.col("is_main"), in_blocks).otherwise(F.concat(with_blocks, with_groups))
    out = out.select(key, "rep", "comp", F.explode(cells).alias("c"))
    return out.select(F.xxhash64(key, "c.kind", "c.a", "c.b").alias("path"), "rep", "comp", "c.side")


def ends(rows: DataFrame, reps: DataFrame, comps: DataFrame) -> DataFrame:
    """(path, rep, comp, side) of cells to compare.

    A node with more rows than SMALL goes on along BRANCHES of each row's tokens, unless nearly all of it is one component
    or it is of the last level.
    """
    done, comps = [], comps.withColumnRenamed("rep", "r")
    rows = rows.select("path", "rep").join(comps, F.col("rep") == F.col("r"), "left").select("path", "rep", F.coalesce("comp", "rep").alias("comp"), F.lit(0).cast("long").alias("mass"))
    for level in range(1, DEPTH + 1):
        now = cut(mixed(rows, "path"), f"near-mixed{level}")
        ready = (F.col("rows") <= SMALL) | (F.col("others") <= SMALL) | F.lit(level == DEPTH)
        done.append(blocked(now.where(ready), "path"))
        if level == DEPTH or now.where(~ready).isEmpty():
            break
        picks = [(F.pmod(F.xxhash64("path", F.lit(k)), F.lit(K)) + 1).cast("int") for k in range(BRANCHES)]
        large = now.where(~ready).select("rep", "comp", "path").join(reps.select("rep", "tokens"), "rep").select("rep", "comp", "path", "tokens", F.explode(F.array_distinct(F.array(*picks))).alias("pick"))
        rows = large.select("rep", "comp", F.xxhash64("path", "pick", F.element_at("tokens", F.col("pick"))).alias("path"), F.lit(0).cast("long").alias("mass"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either"))
    return joined.where(100 * F.col("both") >= percent * F.col("either")).select("a", "b")


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The first two columns, in pieces of about ``most`` rows."""
    held, rows = [], 0
    for b in batches:
        for k in range(0, b.num_rows, most):
            held.append(b.slice(k, most))
            rows += held[-1].num_rows
            if rows >= most:
                t, held, rows = pa.Table.from_batches(held), [], 0
                yield t.column(0).to_numpy(), t.column(1).to_numpy()
    if rows:
        t = pa.Table.from_batches(held)
        yield t.column(0).to_numpy(), t.column(1).to_numpy()


def _stars(order_by: int, chunk: int):
    """(rep, root) for each end of the links of a chunk: equal roots for what the chunk's links connect.

    The root is the smallest end, or with ``order_by`` the first in an order by chance, which each number makes anew: of
    a chain whose links all lie in chunks of their own a third of the ends are then expected to be no root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _chunks(batches, chunk):
            reps, at = np.unique(np.r_[a, b], return_inverse=True)
            if order_by:
                mixed = (reps.view(np.uint64) ^ np.uint64(order_by)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                order = np.argsort(mixed ^ (mixed >> np.uint64(29)), kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                reps, at = reps[order], place[at]
            x, y, root = at[: len(a)], at[len(a) :], np.arange(len(reps))
            while len(x):
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # x and y are roots
                while (root[root] != root).any():
                    root = root[root]
                x, y = root[x], root[y]
                x, y = x[x != y], y[x != y]
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(reps[root])], names=["rep", "root"])

    return run


def components(links: DataFrame, name: str = "components", rounds: int = 59) -> DataFrame:
    """(rep, comp) for each end of a link (a, b): comp is the smallest rep that can be reached.

    The first round connects the links that a task reads, chunk by chunk, and sums up in a row for each end and chunk. Ends then
    stand for themselves by one of their roots, and only links between roots of one end go on to the next round, which
    deals them into as many tasks as they make chunks. What fits in one chunk is done with it; a chain dealt over any number
    of chunks takes about log n rounds. What isn't done after ``rounds`` is an error.
    """
    tables, links, chunks, chance = [], links.select("a", "b").where("a <> b"), 0, False
    for level in range(1, rounds + 1):
        chance |= chunks > 1
        stars = (links.coalesce(chunks) if chunks else links).mapInArrow(_stars(level if chunks > 1 else 0, CHUNK), "rep long, root long")
        ends = stars.groupBy("rep").agg(F.min("root").alias("comp"), F.collect_set("root").alias("roots"))
        tables.append(cut(ends.select("rep", "comp", F.when(F.size("roots") > 1, F.col("roots")).alias("roots")), f"{name}-{level}"))
        links = tables[-1].where("roots IS NOT NULL").select(F.explode("roots").alias("a"), F.col("comp").alias("b")).where("a <> b")
        chunks = -(-links.count() // CHUNK)
        if not chunks:
            break
    else:
        raise RuntimeError(f"{name}: links were left after {rounds} rounds, labels still moved")

    def followed(table: DataFrame, labels: DataFrame) -> DataFrame:
        over = labels.select(F.col("rep").alias("via"), F.col("comp").alias("further"))
        return table.join(over, F.col("comp") == F.col("via"), "left").select("rep", F.coalesce("further", "comp").alias("comp"))

    labels = tables.pop().select("rep", "comp")
    if not tables:
        return labels
    for table in reversed(tables[1:]):
        labels = followed(table, labels)
    if chance:  # the smallest of a component, a root of the first round, is an end in the second, whatever its root there
        labels = labels.join(labels.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select("rep", F.col("least").alias("comp"))
    return cut(followed(tables[0], labels), name)


def short_name(digest: Column) -> Column:
    return F.xxhash64(digest)


def namer(digests: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Gives tables with set_digest their rep: a 64-bit hash of the digest, but another one where two digests share it."""
    clash = digests.where("set_digest is not null").groupBy(short_name(F.col("set_digest")).alias("h")).agg(F.min("set_digest").alias("first"), F.max("set_digest").alias("last")).where("first <> last").select("h", "first")
    clash = cut(clash, "near-clashes")
    if clash.isEmpty():
        return lambda df: df.withColumn("rep", short_name(F.col("set_digest")))
    other = F.xxhash64("set_digest", F.lit("again"))
    if not digests.join(clash, short_name(F.col("set_digest")) == F.col("h")).where("set_digest <> first").select("set_digest").distinct().groupBy(other.alias("o")).count().where("count > 1").isEmpty():
        raise RuntimeError("sets whose names clash twice")

    def name(df: DataFrame) -> DataFrame:
        cols = df.columns
        out = df.join(F.broadcast(clash), short_name(F.col("set_digest")) == F.col("h"), "left")  # a row or so for 2^64 pairs of sets
        return out.select(*cols, F.when(F.col("first") != F.col("set_digest"), other).otherwise(short_name(F.col("set_digest"))).alias("rep"))

    return name


def linked(rows: DataFrame, words_each: int, percent: int, part: str = "true") -> DataFrame:
    """rows without their text, with n_shingles and comp: equal for rows of one component, null for empty sets.

    Rows that don't meet the condition ``part`` link nothing.
    """
    spark, threshold = rows.sparkSession, percent / 100
    others = [c for c in rows.columns if c != "text"]
    schema = StructType([*(rows.schema[c] for c in others), StructField("text_key", StringType()), StructField("n_shingles", LongType()), StructField("set_digest", BinaryType()), StructField("tokens", ArrayType(IntegerType()))])
    keyed = rows.select("text", *others, F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    light = cut(keyed.mapInArrow(_signatures(words_each), schema), "near-signatures")
    named = namer(light)
    light = named(light)
    short = F.transform("tokens", lambda t: F.substring(F.hex(t.bitwiseAND(255) + 256), 2, 2))
    known = light.where(F.col("rep").isNotNull()).where(part)
    reps = known.select("rep", F.col("n_shingles").alias("n"), "tokens", F.unhex(F.array_join(short, "")).alias("sig")).dropDuplicates(["rep"])
    reps = cut(reps, "near-reps")
    nodes = cut(roots(reps), "near-nodes")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = reps.select("rep", "n", "sig")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "path").sortWithinPartitions("path", "n", "rep")

    # first pass: rows of a large node meet in blocks of about SMALL, which differ from tree to tree
    first = nodes.select("rep", F.xxhash64("path", F.pmod(F.xxhash64("rep", "path"), F.ceil(F.col("rows") / SMALL))).alias("path"))
    found = cut(dealt(first.join(marks, "rep")).mapInArrow(_under_leaders(threshold), "a long, b long").distinct(), "near-found")

    # second pass, still on minwise tokens: what else may belong together, as links that join what the first found
    likely = components(found, "near-likely")
    more = cut(dealt(ends(nodes, reps, likely).join(marks, "rep")).mapInArrow(_across(threshold), "a long, b long"), "near-more")

    # the full sets of all that may have a partner: one text of each
    family = cut(components(found.unionByName(more), "near-families").withColumnRenamed("comp", "family"), "near-family")
    shown = known.groupBy("rep").agg(F.min("text_key").alias("text_key")).join(family.select("rep"), "rep", "left_semi").select("text_key")
    texts = rows.select(F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), "text").join(shown, "text_key", "left_semi").dropDuplicates(["text_key"])
    sets = cut(named(texts.select("text").mapInArrow(_sets(words_each), "set_digest binary, shingles array<long>")).select("rep", "shingles"), "near-sets")

    # confirmation: links to leaders first, then within each family all likely pairs across what these leave apart
    links = cut(confirmed(found, sets, percent), "near-links")
    comp = components(links, "near-first").withColumnRenamed("rep", "r")
    rows_ = family.join(comp, F.col("rep") == F.col("r"), "left").select("family", "rep", F.coalesce("comp", "rep").alias("comp"))
    rows_ = rows_.join(reps.select("rep", F.col("n").alias("mass")), "rep")
    cells = blocked(mixed(rows_, "family"), "family").join(marks, "rep").join(sets, "rep")
    links = links.unionByName(cut(dealt(cells).mapInArrow(_across(threshold, percent), "a long, b long"), "near-links2"))
    comp = components(links, "near-all")
    placed = light.join(comp.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"), "left")
    return placed.select(*others, "n_shingles", F.coalesce("comp", "rep").alias("comp"))


def near_duplicates(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept (component_id = doc_id)."""
    placed = cut(linked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words_each, percent, "doc_id is not null"), "near-placed")
    # an id that stands for several sets joins their classes
    named = placed.where("doc_id is not null and comp is not null")
    ids = named.groupBy("doc_id").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).where("a <> z")
    pairs = cut(ids.join(named, "doc_id").select("a", F.col("comp").alias("b")).where("a <> b").distinct(), "near-ids")
    if not pairs.isEmpty():
        joined = components(pairs, "near-joined").select(F.col("rep").alias("r"), F.col("comp").alias("c"))
        placed = placed.join(joined, F.col("comp") == F.col("r"), "left").select("doc_id", "n_shingles", F.coalesce("c", "comp").alias("comp"))
    least = placed.where("doc_id is not null and comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("comp", "c")
    out = placed.join(least, F.col("comp") == F.col("c"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: the one of the smallest id (null last), and of these the smallest row key.

    Rows are told apart by all of their columns, so rows that share an id stand for themselves, and of equal rows one stays.
    Rows without words are in no group and stay as they are.
    """
    key = row_key(docs)
    light = docs.select(key.alias("row_key"), "doc_id", "text")
    placed = linked(light, words_each, percent).where("comp is not null")
    best = placed.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))["row_key"].alias("row_key"))
    best = cut(best.select("row_key").distinct(), "near-kept")
    has_words = F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(key.alias("row_key"), F.struct(*docs.columns).alias("row"))
    kept = rows.where(has_words).join(best, "row_key", "left_semi").dropDuplicates(["row_key"])
    return kept.select("row.*").unionByName(rows.where(~has_words).select("row.*"))
