"""The prefix trie of conversations, with what sharing its nodes would save.

Conversations are rebuilt on a common opening first (``rebuilt``). Each prefix has a digest of 128 bits: the running XOR of
the digests of (depth, role, text). The least conversation that holds a prefix owns its node; since it also is the least of
whatever longer prefixes it owns, a conversation owns its turns from some first depth on: a chain. That depth is found by
binary search, all conversations at once, one join of (conversation, depth probed) with the owners of prefix digests for each
halving. A chain hangs on the node before its first, and chains are summed up from the outermost inwards, one join
for each level of chains.

No key is ever held whole: runs within a conversation are taken in stretches of 1,024 places and then over the stretches'
totals, minima and counts are partial aggregates, owners are probed by conversation and depth, so that a first turn
which a third of all conversations share is no hot key, and ids that end at one node are joined in chunks of 4,096 before one
task takes their digest chunk by chunk, as SHA-256 of a list can only be taken in order.

Cases: null roles and texts count as empty; turns are ordered by number, null first, ties by role and then text; repeated rows
are turns of their own; rows without conv_id belong to no conversation and are left out; texts of any length are read whole
and leave with their digest; an empty table has no nodes, not even a root; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut

#: A conversation's opening is that of the first of so many ids, and has fewer than OPENINGS turns.
FAMILY, OPENINGS = 20, 4
#: Stretches of 2 ** STRETCH places, chunks of 2 ** CHUNK ids.
STRETCH, CHUNK = 10, 12
#: Halvings of the binary search between two written tables.
HALVINGS = 6

NODE = ["depth", "d1", "d2"]


def _running(df: DataFrame, key: str, stretch: Column, order: list[Column], how: Callable, values: list[str], back: bool = False) -> DataFrame:
    """``df`` with each of ``values`` replaced by its running total (``how``: sum or XOR) along ``order`` within ``key``.

    ``stretch`` must rise with the order; its groups are run through apart from each other.
    """
    df = df.withColumn("__stretch", stretch)
    rows = Window.partitionBy(key, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key).orderBy(F.desc("__stretch") if back else F.asc("__stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, "__stretch").agg(*(how(v).alias(v) for v in values))
    before = totals.select(F.col(key).alias("__key"), F.col("__stretch").alias("__at"), *(how(v).over(earlier).alias(f"__{v}") for v in values)).where(F.col(f"__{values[0]}").isNotNull())
    run = df.withColumns({v: how(v).over(rows) for v in values}).join(before, (F.col(key) == F.col("__key")) & (F.col("__stretch") == F.col("__at")), "left")
    added = {v: F.col(v) + F.coalesce(f"__{v}", F.lit(0)) if how is F.sum else F.col(v).bitwiseXOR(F.coalesce(f"__{v}", F.lit(0))) for v in values}
    return run.withColumns(added).drop("__key", "__at", "__stretch", *(f"__{v}" for v in values))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), two digests of role and text, and the words of the text, for each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.lit(1).cast("long").alias("place"))
    stretch = F.coalesce(F.shiftright("turn", STRETCH), F.lit(-(1 << 60)))
    placed = _running(turns, "conv_id", stretch, [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], F.sum, ["place"])
    return placed.select("conv_id", "place", F.xxhash64(F.lit(1), "role", "text").alias("c1"), F.xxhash64(F.lit(2), "role", "text").alias("c2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, depth, c1, c2, words) on their family's opening.

    The first h turns of a conversation c are those of conversation c - c % family, h being crc32 of c as text modulo ``openings``.
    """
    own_opening = F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("place") < openings))
    heads = first.groupBy(F.col("conv_id").alias("head_id")).agg(F.sort_array(F.collect_list(F.struct("place", "c1", "c2", "words"))).alias("head"))  # at most openings - 1 turns
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", own_opening)
    convs = convs.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("head_id"), "left")
    convs = convs.withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast(heads.schema["head"].dataType)))
    convs = cut(convs.select("conv_id", "h", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length")), "trie-conversations")
    short = convs.where(F.size("head") < F.col("h")).select(F.col("conv_id").alias("short_id"), F.size("head").cast("long").alias("k"))
    opening = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.c1", "t.c2", "t.words")
    rest = turns.where(F.col("place") > own_opening).join(short, F.col("conv_id") == F.col("short_id"), "left")
    rest = rest.select("conv_id", (F.col("place") - F.when(F.col("k").isNotNull(), own_opening - F.col("k")).otherwise(0)).alias("depth"), "c1", "c2", "words")
    return convs.select("conv_id", "length"), opening.unionByName(rest)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest (d1, d2) of the first ``depth`` turns, and words of the last of them; depth 0 for all."""
    turns = turns.select("conv_id", "depth", F.xxhash64("depth", "c1").alias("d1"), F.xxhash64("depth", "c2").alias("d2"), "words")
    run = _running(turns, "conv_id", F.shiftright("depth", STRETCH), [F.asc("depth")], F.bit_xor, ["d1", "d2"])
    zero = F.lit(0).cast("long")
    return run.unionByName(convs.select("conv_id", zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), zero.alias("words")))


def first_owned(convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, length, first: the least depth whose node the conversation owns, length + 1 if it owns none.

    Owning is monotone in depth, so each round halves what is left for every conversation.
    """
    found = convs.select("conv_id", "length", F.lit(0).cast("long").alias("first"), (F.col("length") + 1).alias("last"))
    owned = nodes.select(F.col("owner"), F.col("depth").alias("owned"))
    longest = convs.agg(F.max("length")).first()[0] or 0
    for n in range((longest + 1).bit_length()):
        mid = F.expr("(first + last) div 2")
        open_ = F.col("first") < F.col("last")
        probed = found.withColumn("mid", F.when(open_, mid)).join(owned, (F.col("conv_id") == F.col("owner")) & (F.col("mid") == F.col("owned")), "left")
        hit = F.col("owned").isNotNull()
        found = probed.select("conv_id", "length", F.when(open_ & ~hit, F.col("mid") + 1).otherwise(F.col("first")).alias("first"), F.when(open_ & hit, F.col("mid")).otherwise(F.col("last")).alias("last"))
        if n % HALVINGS == HALVINGS - 1:
            found = cut(found, "trie-search")
    return found.select("conv_id", "length", "first")


def chains(found: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, length, first and, where it isn't the root's, parent and at: the node on which the chain hangs."""
    chain = found.where("first <= length")
    before = paths.select(F.col("conv_id").alias("c"), F.col("depth").alias("at"), "d1", "d2")
    holder = nodes.select(F.col("owner").alias("parent"), F.col("depth").alias("d"), F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    hung = chain.where("first > 0").join(before, (F.col("conv_id") == F.col("c")) & (F.col("first") - 1 == F.col("at")))
    hung = hung.join(holder, (F.col("at") == F.col("d")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).select("conv_id", "length", "first", "parent", "at")
    return hung.unionByName(chain.where("first = 0"), allowMissingColumns=True)


def summed_up(chain: DataFrame, nodes: DataFrame) -> DataFrame:
    """parent, at, kids, leaves, saved: what the chains that hang on a node hold with all that hangs on them.

    A chain is summed once all chains on it are; each round takes those that have become so.
    """
    own = nodes.groupBy("owner").agg(F.sum("saved").alias("saved"))
    kids = chain.where("parent IS NOT NULL").groupBy("parent", "at").agg(F.count("*").alias("n"))
    on = kids.groupBy(F.col("parent").alias("on")).agg(F.sum("n").alias("waiting"), F.max("at").alias("last"))
    left = chain.join(own, F.col("conv_id") == F.col("owner")).join(on, F.col("conv_id") == F.col("on"), "left")
    leaf = (F.col("last").isNull() | (F.col("last") < F.col("length"))).cast("long")
    left = cut(left.select("conv_id", "parent", "at", "saved", leaf.alias("leaves"), F.coalesce("waiting", F.lit(0)).alias("waiting")), "trie-chains")
    done = []
    while not left.isEmpty():
        ready = left.where("waiting = 0")
        done.append(ready.where("parent IS NOT NULL").groupBy("parent", "at").agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        given = ready.groupBy(F.col("parent").alias("on")).agg(F.count("*").alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        rest = left.where("waiting > 0").join(given, F.col("conv_id") == F.col("on"), "left")
        more = {"saved": "s", "leaves": "l"}
        left = cut(rest.select("conv_id", "parent", "at", *((F.col(k) + F.coalesce(v, F.lit(0))).alias(k) for k, v in more.items()), (F.col("waiting") - F.coalesce("n", F.lit(0))).alias("waiting")), "trie-chains")
    out = chain.sparkSession.createDataFrame([], "parent long, at long, kids long, leaves long, saved long")
    for d in done:
        out = out.unionByName(d)
    return out.groupBy("parent", "at").agg(*(F.sum(c).alias(c) for c in ("kids", "leaves", "saved")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of each key, which come sorted; only the running digest is held."""
    key, sha = None, hashlib.sha256()
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3])], names=["at", "e1", "e2", "ends_sha256"])

    for b in batches:
        for *this, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if this != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = this, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if len(out) >= 10_000:
            yield flushed()
    if key is not None:
        out.append((*key, sha.hexdigest()))
    if out:
        yield flushed()


def ends(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """Of each node at which conversations end: SHA-256 of their ids in order, joined by commas."""
    last = paths.join(convs.select(F.col("conv_id").alias("c"), "length"), (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("length")))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = last.groupBy(*NODE, F.shiftright("conv_id", CHUNK).alias("chunk")).agg(ids.alias("ids"))
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids").mapInArrow(_digests, "at long, e1 long, e2 long, ends_sha256 string")


def trie(conversations: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> DataFrame:
    """One row for each node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = cut(numbered(conversations), "trie-turns")
    convs, own = rebuilt(turns, family, openings)
    paths = cut(prefixes(convs, own), "trie-prefixes")
    nodes = paths.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    nodes = cut(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie-nodes")
    chain = cut(chains(first_owned(convs, nodes), paths, nodes), "trie-owned")
    hung = summed_up(chain, nodes).select("parent", F.col("at").alias("hung_at"), "kids", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    of = chain.select(F.col("conv_id").alias("chain_id"), "length", "first", F.col("parent").alias("hangs_on"))
    own_nodes = nodes.join(of, F.col("owner") == F.col("chain_id")).join(hung, (F.col("owner") == F.col("parent")) & (F.col("depth") == F.col("hung_at")), "left")
    tail = (F.col("depth") == F.col("length")) & F.col("kids").isNull()
    full = own_nodes.select(
        *NODE, "owner", "n_convs",
        F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("hangs_on")).alias("parent_conv_id"),
        (F.coalesce("kids", F.lit(0)) + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"),
        (F.coalesce("more_leaves", F.lit(0)) + tail.cast("long")).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
    )
    sums = _running(full, "owner", F.shiftright("depth", STRETCH), [F.desc("depth")], F.sum, ["n_leaves", "saved_tokens"], back=True)
    out = sums.join(ends(convs, paths), (F.col("depth") == F.col("at")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
