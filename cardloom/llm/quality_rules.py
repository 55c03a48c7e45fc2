"""Quality rules with thresholds that adapt to each language and source, in DataFrame expressions only.

Each text is measured; measures become whole numbers (thousandths, tenths of a character) of at most ten significant bits, so
that a group's histogram over them is a quantile sketch of bounded size on an open scale: its relative error is 1/512, sketches
merge by adding counts, and the result doesn't depend on the order of merging. Sketches are kept per language and source and
merged into one per language and one of all texts. A group is judged by its own sketch with its language's mixed in, which weighs
as much as PRIOR texts, whatever the sizes: one rule for all, in which a growing source outweighs its language.

The upper fence lies SPREADS times the distance from the lower quartile to the median above the median, which counts as a 32nd of the median at
least: it is taken from the lower half of a group only, so high junk in up to nearly half of it, in one source or in all of them at once, can't lift it beyond
what the clean texts' own spread allows. The lower fence mirrors this. A text is rejected if it lies beyond a fence by more than a
few single events (symbols, repeated windows, lines) or standard errors are worth in a text of its size. Texts join their fences.

Cases: texts of any length are measured whole, each in its row; a null text has no words; texts without words fail the base rules and are no part of any sketch; null languages
and sources are groups of their own; null or repeated ids and repeated rows each keep their row; an empty table gives
an empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let
from .shared import WHITE, cut

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Texts that a language's sketch weighs as in that of a source; distances from quartile to median from median to fence.
PRIOR, SPREADS = 20, 9
#: A distance counts as this part of the median at least.
LEAST = 32
#: Measure: whether low values are rejected too.
MEASURES = {"symbols": False, "repeats": False, "lines": False, "length": True}
#: What a text may be beyond a fence: events times the unit of the scale over its size, for length standard errors of mean word length.
SLACK = {"symbols": "floor(5000 / word_chars)", "repeats": "floor(48000 / n_words)", "lines": "floor(3000 / n_lines)", "length": "floor(90 / sqrt(n_words))"}
#: Significant bits of a value.
BITS = 10


def words_of(text: Column) -> Column:
    """Runs without ASCII white space, as an array."""
    plain = F.translate(text, WHITE[1:], " " * (len(WHITE) - 1))
    return F.array_remove(F.split(plain, " ", -1), "")


def _follow(hashes: Column, step: int) -> Column:
    """Hashes of runs twice as long: each one joined with the one ``step`` further on."""
    n = F.size(hashes) - step
    ahead = F.slice(hashes, step + 1, F.greatest(n, F.lit(0)))
    return F.zip_with(F.slice(hashes, 1, F.greatest(n, F.lit(0))), ahead, lambda a, b: F.xxhash64(a, b))


def _gaps(places: Column) -> Column:
    """Words that windows at these places (sorted) cover: each adds what the next doesn't cover."""
    n = F.size(places)
    gaps = F.zip_with(F.slice(places, 1, F.greatest(n - 1, F.lit(0))), F.slice(places, 2, n), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda s, g: s + g))


def _repeated(pairs: Column) -> Column:
    """Places of hashes that occur more than once, from struct<h, i> sorted by hash."""
    same = F.zip_with(pairs, F.slice(pairs, 2, F.size(pairs)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))  # as the next one
    either = let(same, lambda s: F.zip_with(s, F.concat(F.array(F.lit(False)), F.slice(s, 1, F.size(s) - 1)), lambda a, b: a | b))
    return F.filter(F.zip_with(pairs, either, lambda p, e: F.when(e, p["i"])), lambda i: i.isNotNull())


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs again."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(F.sort_array(let(pairs, _repeated)), _gaps)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    out = docs.select(
        "doc_id", "lang", "source",
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("h1"),
    )
    out = out.select("doc_id", "lang", "source", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("h1").cast("long").alias("n_words"), _follow(F.col("h1"), 1).alias("h2"))
    out = out.withColumn("h4", _follow(F.col("h2"), 2)).drop("h2").withColumn("h8", _follow(F.col("h4"), 4)).drop("h4")
    out = out.withColumn("again", F.size("h8") > F.size(F.array_distinct("h8")))
    return out.withColumn("n_repeat_words", F.when(F.col("again"), _covered(F.col("h8"))).otherwise(F.lit(0)).cast("long")).drop("h8", "again")


def rounded(value: Column) -> Column:
    """A whole number rounded down to BITS significant bits."""
    shift = lambda v, k: F.call_function("shiftleft", F.call_function("shiftright", v, k), k)
    return let(value, lambda v: let(F.greatest(F.length(F.bin(v)) - BITS, F.lit(0)), lambda k: shift(v, k)))


def scales() -> dict[str, Column]:
    """The measures of a text on their scales, as whole numbers."""
    values = {
        "symbols": F.col("n_symbols") * 1000 / F.col("word_chars"),
        "repeats": F.col("n_repeat_words") * 1000 / F.col("n_words"),
        "lines": F.col("n_dup_lines") * 1000 / F.col("n_lines"),
        "length": F.col("word_chars") * 10 / F.col("n_words"),
    }
    return {k: rounded(F.floor(v).cast("long")) for k, v in values.items()}


def sketches(texts: DataFrame) -> DataFrame:
    """lang, source, measure, value, n: the histogram of each group."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in MEASURES]))
    return texts.where("n_words > 0").select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.measure", "p.value").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "measure", "value").agg(F.sum("n").alias("n"))


def mixed_in(sketch: DataFrame) -> DataFrame:
    """lang, source, measure, value, n: each group's sketch with its language's, which counts as PRIOR texts. Counts are
    multiplied by the language's total, so that they stay whole."""
    wide = merged(sketch, "lang").withColumn("all", F.sum("n").over(Window.partitionBy("lang", "measure")))
    groups = sketch.select("lang", "source", "measure").distinct().withColumnsRenamed({"lang": "l", "measure": "m"})
    same = F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))
    prior = wide.join(groups, same).select("lang", "source", "measure", "value", (F.col("n") * PRIOR).cast("decimal(38,0)").alias("n"))
    total = wide.select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.col("all")).distinct()
    own = sketch.join(total, same).select("lang", "source", "measure", "value", (F.col("n").cast("decimal(19,0)") * F.col("all").cast("decimal(19,0)")).cast("decimal(38,0)").alias("n"))
    return merged(own.unionByName(prior), "lang", "source")


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """by, measure, q25, q50, q75: the values at which these shares of a group are reached."""
    group = Window.partitionBy(*by, "measure")
    up = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    out = sketch.select(*by, "measure", "value", up.alias("up"), F.sum("n").over(group).alias("total"))
    reached = lambda q: F.min(F.when(F.col("up") * 100 >= F.col("total") * q, F.col("value"))).alias(f"q{q}")
    return out.groupBy(*by, "measure").agg(*[reached(q) for q in (25, 50, 75)])


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and for each measure its lower and upper fence: one row for each group."""
    own = quantiles(mixed_in(sketch), "lang", "source")
    least = F.floor(F.col("q50") / LEAST)
    high = F.col("q50") + SPREADS * F.greatest(F.col("q50") - F.col("q25"), least)
    low = F.col("q50") - SPREADS * F.greatest(F.col("q75") - F.col("q50"), least)
    cases = []
    for k, below in MEASURES.items():
        cases.append(F.max(F.when(F.col("measure") == k, high)).alias(f"{k}_high"))
        if below:
            cases.append(F.max(F.when(F.col("measure") == k, low)).alias(f"{k}_low"))
    return own.groupBy("lang", "source").agg(*cases)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the measures."""
    texts = measured(docs)
    for k, v in scales().items():
        texts = texts.withColumn(k, F.when(F.col("n_words") > 0, v))
    texts = cut(texts, "rules-measures")
    limits = fences(sketches(texts)).withColumnsRenamed({"lang": "l", "source": "s"})
    out = texts.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    beyond = F.lit(False)
    for k, below in MEASURES.items():
        slack = F.expr(SLACK[k])
        beyond = beyond | F.coalesce(F.col(k) > F.col(f"{k}_high") + slack, F.lit(False))
        if below:
            beyond = beyond | F.coalesce(F.col(k) < F.col(f"{k}_low") - slack, F.lit(False))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.when(F.col("n_words") > 0, beyond).otherwise(False)).alias("kept"), *MEASURES)
