"""Mixing sources to target weights with a low-discrepancy schedule.

Slot n of the mix lies at the point frac((n + 1/2) * golden ratio) of the unit interval; the cumulative shares of the
sources' targets map it to a source, and its rank among that source's slots names the block it takes. A source's
documents stand in a shuffled order that depends on their content only, and are cut into blocks of equally many words
(the last of a pass may be shorter); rank k takes block k modulo the blocks of a pass, so a source that must repeat
starts again from its first block. Slots beyond a source's quota are left out and, where the finite sequence gave a
source too few, its last slots follow at the end; so each source yields its target to the word.

Cases: a null text has size 0 and is never taken; texts of any length count whole; ties of the shuffle key go by id, size and row; a null source is a source of its own, last in order; equal ids or
rows are separate documents; sources without words have target 0; an empty table gives an empty result; other columns
of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut, row_key

WEIGHTS = (5, 2, 1)
GOLDEN = 0.6180339887498949
#: Words of a block, and documents of one shuffle bucket on average.
BLOCK, BUCKET = 4096, 20_000
#: Slots that are ranked together.
STRETCH = 1 << 14


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """source, source_size, weight, target for ``sizes`` (source, source_size): one row for each source.

    Sources are ordered by code point, null last, and weighed in turn. Targets share the sum of all sizes; each stops
    at ``cap`` times its source's size, and what is over is shared again by weight. The closed form: sources fill up in
    the order of cap * size / weight, and the level of the others follows from what is then left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    out = sizes.select("source", "source_size").withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    filling = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(filling), F.lit(0.0))
    waiting = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))
    out = out.withColumn("level", left / waiting).withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    # the level of the first source that doesn't fill up holds for all after it
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return out.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * rest))).select("source", "source_size", "weight", "target")


def positions(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (key, source, size) with start: the words of the source that stand before it in its shuffled order.

    Ranges of the shuffle key are summed first, so a source with a third of all rows is dealt over many tasks.
    """
    wide = docs.withColumn("bucket", F.shiftrightunsigned("key", 33) % buckets)
    sums = wide.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *[c for c in ("row",) if c in docs.columns]).rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return wide.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("base") + F.col("ahead")).drop("s", "b", "base", "ahead", "bucket")


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix in order: slot, source, rank, pass, block, words. ``plan`` has source, source_size, target."""
    plan = plan.where(F.col("source_size") > 0).withColumn("words", F.round("target").cast("long")).where(F.col("words") > 0)
    size, words = F.col("source_size"), F.col("words")
    plan = plan.withColumn("blocks", F.ceil(size / block)).withColumn("quota", F.floor(words / size) * F.col("blocks") + F.ceil((words % size) / block))
    total = Window.partitionBy()
    low = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("low", F.coalesce(F.sum("quota").over(low), F.lit(0)) / F.sum("quota").over(total)).withColumn("high", F.col("low") + F.col("quota") / F.sum("quota").over(total)).withColumn("slots", F.sum("quota").over(total))
    plan = cut(plan.select("source", "source_size", "words", "blocks", "quota", "low", "high", "slots"), "mix-plan")
    spark, n = plan.sparkSession, (plan.agg(F.max("slots")).first()[0] or 0)
    point = (F.col("slot") + 0.5) * F.lit(GOLDEN)
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point - F.floor(point))
    # the points are cut into cells, each listed with the sources that it meets, so finding a source is an equality join
    cells = 4096
    met = plan.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    slots = slots.withColumn("cell", F.least(F.floor(F.col("point") * cells), F.lit(cells - 1))).withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    dealt = slots.join(met.select("cell", "source", "low", "high"), "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "stretch", "source")
    counts = dealt.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    along = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("stretch").alias("t"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("source")).alias("got"))
    counts = cut(counts, "mix-counts")
    rank = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1
    ranked = dealt.withColumn("place", rank).join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t"))).select("slot", "source", (F.col("base") + F.col("place")).alias("rank"))
    got = counts.groupBy("s").agg(F.max("got").alias("got"))
    late = plan.join(got, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col("got") < F.col("quota"))
    late = late.select(F.col("slots").alias("slot"), "source", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("rank"))
    ranked = ranked.select("slot", "source", F.col("rank").cast("long").alias("rank")).unionByName(late.select("slot", "source", F.col("rank").cast("long").alias("rank")))
    p = plan.select(F.col("source").alias("s"), "source_size", "words", "blocks", "quota")
    out = ranked.join(p, F.col("source").eqNullSafe(F.col("s"))).where(F.col("rank") < F.col("quota"))
    out = out.withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    partly = F.col("words") - F.col("pass") * F.col("source_size") - F.col("block") * block
    return out.select("slot", "source", "rank", "pass", "block", F.least(whole, partly).cast("long").alias("words"))


def shuffle_key() -> Column:
    """What a document's place in its source's shuffled order comes from."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = 3.0, block: int = BLOCK, row: Column | None = None) -> DataFrame:
    """One row for each document: doc_id, size, source, source_size, target, start, taken; with ``row`` also its value as row.

    Sources are ranked in one task, so there may be some millions of them, not as many as documents.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    more = [] if row is None else [row.alias("row")]
    light = cut(docs.select("doc_id", "source", size.alias("size"), shuffle_key().alias("key"), *more), "mix-sizes")
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sizes = cut(sizes, "mix-sources")
    n = sizes.agg(F.sum("docs")).first()[0] or 0
    plan = cut(targets(sizes, weights, cap), "mix-targets")
    placed = cut(positions(light, max(1, -(-n // BUCKET))), "mix-places")
    slots = schedule(plan, block).groupBy("source", "block").agg(F.collect_list("words").alias("takes"))  # as many as passes
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    slots = slots.select(F.col("source").alias("s"), F.col("block").alias("b"), "takes")
    pieces = pieces.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    at, end = F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    words = F.aggregate("takes", F.lit(0).cast("long"), lambda got, take: got + F.greatest(F.least(end, take) - at, F.lit(0)))
    # a start belongs to one document with words only
    taken = pieces.withColumn("words", words).groupBy(F.col("source").alias("s"), F.col("start").alias("at")).agg(F.sum("words").alias("taken"))
    out = placed.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left").drop("s", "at")
    plan = plan.select(F.col("source").alias("s"), "source_size", "target")
    out = out.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source", "source_size", "target", "start", *([] if row is None else ["row"]), F.coalesce("taken", F.lit(0)).alias("taken"))


def repeated(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """docs as rows of the mix: each document as often as it is taken, to the nearest whole number.

    Rows are told apart by all of their columns. Rows that are equal in all of them are taken together, so what one of them is
    short of a whole number another may make up.
    """
    mixed = mix(docs, weights, cap, row=row_key(docs)).where("taken > 0").groupBy("row").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    times = cut(mixed.select("row", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0"), "mix-times")
    rows = docs.select(row_key(docs).alias("row"), F.struct(*docs.columns).alias("doc")).join(times, "row").dropDuplicates(["row"])
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("doc.*")
