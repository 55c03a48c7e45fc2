r"""Personal data by base patterns and by bootstrapped contexts, in DataFrame expressions only.

Base: for each kind the leftmost matches that don't overlap, checked (parts of an address, Luhn sums, digits of a number)
and dropped if they fail. The expressions below match the same spans as the plain patterns they stand for, but look at
each character a bounded number of times: a match can only start where a run of its first class starts, or right
after the last match, and runs never give characters back.

Beyond base: the tokens that hold a digit or an at sign, and runs of such tokens, are instances; the words around an instance
are patterns, whatever its shape. Instances that hold a base span whole are seeds of its kind. In each round a pattern's
confidence in a kind is the share of its distinct instances that are seeds or were found before, which must be enough; an
instance's is the largest of its confident patterns, weighted by how like the kind's seeds it looks (digits, letters, at sign).
Instances that end above the threshold and hold no base span are further spans, and support their other patterns in the
next round. Both spans and counts of patterns stay distributed; each text counts once, copies share results. The words
around an instance are whole words, whatever their length and distance; the mark ^ stands where there is none.

Positions are running sums, made by doubling (see scanned), so a text costs its length times the logarithm of its matches.
Texts with many base spans meet their tokens in a join by stretches of the text, others inside their row.

Cases: a null text counts as empty; null or repeated ids and repeated rows each keep their row; texts of any length are
matched whole; an empty table gives an empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let
from .shared import WHITE, cut

KINDS = ("email", "ip", "card", "phone")
#: As stated in the module's text; quantifiers with a second + never give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++"
#: Rounds; confidence of a pattern and of a span; distinct seeds behind a pattern.
ROUNDS, SURE, SEEDS = 3, 0.9, 5
#: Base spans of a text that are looked through for each of its tokens; code points of a stretch or chunk of a text.
FEW, STRETCH = 64, 1024


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    back = F.reverse(number)
    value = lambda i: F.substring(back, i, 1).cast("int")
    add = lambda s, i: s + F.when(i % 2 == 1, value(i)).otherwise(2 * value(i) - 9 * (value(i) > 4).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    n = F.length(digits(match))
    if kind == "phone":
        return n.between(10, 15)
    return F.when(n.between(14, 19), luhn(digits(match))).otherwise(F.lit(False))


def scanned(values: Column, step: Callable[[Column, Column], Column] = Column.__add__) -> Column:
    """Running totals of whole numbers from 0 on, under + or greatest. Each pass joins every total with the one that
    lies twice as far back as in the pass before."""

    def passes(v: Column) -> Column:
        n = F.size(v)
        turns = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

        def once(got: Column, k: Column) -> Column:
            back = F.least(F.call_function("shiftleft", F.lit(1), k), n)
            return F.zip_with(got, F.concat(F.array_repeat(F.lit(0), back), F.slice(got, 1, n - back)), lambda a, b: step(a, b))

        return F.aggregate(turns, v, once)

    return let(values, passes)


def placed(text: Column, pattern: str) -> Column:
    """struct<gaps, hits: array<struct<start, end, match>>>: code points at which the pattern matches, and what stands between."""

    def spans(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["hits"])), x["hits"], lambda g, h: F.length(g) + F.length(h))
        hits = F.zip_with(scanned(steps), x["hits"], lambda end, h: F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("match")))
        return F.struct(x["gaps"].alias("gaps"), hits.alias("hits"))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), spans)


SPAN = "array<struct<start:int,kind:int,end:int>>"


def base_spans(text: Column, kind: str, digits: Column) -> Column:
    """array<struct<start, kind, end>> of a kind's valid matches. digits: whether the text has a digit."""
    number = KINDS.index(kind)
    hits = F.filter(placed(text, PATTERNS[kind])["hits"], lambda x: valid(kind, x["match"]))
    spans = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))
    some = text.contains(HINTS[kind]) if HINTS[kind] else F.lit(True)
    return F.when(some & (digits if kind != "email" else F.lit(True)), spans).otherwise(F.array().cast(SPAN))


def tokens_with_context(text: Column) -> Column:
    """array<struct<start, end, token, before, after>> of the tokens that hold a digit or an at sign."""
    near = lambda w: F.coalesce(F.regexp_replace(F.lower(w), "[0-9]", "9"), F.lit("^"))
    plain = lambda gap: F.trim(F.translate(gap, WHITE[1:], " " * 5))
    word = lambda gap, which, other: near(F.coalesce(F.nullif(F.substring_index(plain(gap), " ", which), F.lit("")), other))

    def around(x: Column) -> Column:
        gaps, hits, n = x["gaps"], x["hits"], F.size(x["hits"])
        rest, none = F.greatest(n - 1, F.lit(0)), F.slice(F.array(F.lit(None).cast("string")), 1, F.least(n, F.lit(1)))
        words = F.transform(hits, lambda h: h["match"])
        # a token's neighbour is the last or first word of the gap, or else the next token
        before = F.zip_with(F.slice(gaps, 1, n), F.concat(none, F.slice(words, 1, rest)), lambda g, t: word(g, -1, t))
        after = F.zip_with(F.slice(gaps, 2, n), F.concat(F.slice(words, 2, rest), none), lambda g, t: word(g, 1, t))
        return F.struct(hits.alias("hits"), before.alias("before"), after.alias("after"))

    def tokens(x: Column) -> Column:
        return F.transform(x["hits"], lambda h, i: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["match"].alias("token"), F.get(x["before"], i).alias("before"), F.get(x["after"], i).alias("after")))

    return let(let(placed(text, TOKEN), around), tokens)


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, key, base (sorted spans), tokens: one light row for each document. key names the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("text"), text.rlike("[0-9]").alias("digits"))
    parts = [base_spans(F.col("text"), k, F.col("digits")).alias(f"b{i}") for i, k in enumerate(KINDS)]
    some = F.col("digits") | F.col("text").contains("@")
    empty = F.array().cast("array<struct<start:int,end:int,token:string,before:string,after:string>>")
    out = out.select("doc_id", text_key(F.col("text")).alias("key"), *parts, F.when(some, tokens_with_context(F.col("text"))).otherwise(empty).alias("tokens"))
    return out.select("doc_id", "key", F.array_sort(F.concat("b0", "b1", "b2", "b3")).alias("base"), "tokens")


def runs(tokens: Column) -> Column:
    """Of tokens (see tokens_with_context) the runs of two and more with one character between them, as one instance each."""

    def ends(t: Column) -> Column:
        places = F.when(F.size(t) > 1, F.sequence(F.lit(1), F.size(t))).otherwise(F.array().cast("array<int>"))
        apart = lambda i, j: F.coalesce(F.get(t, j - 1)["start"] > F.get(t, i - 1)["end"] + 1, F.lit(True))
        firsts = F.filter(places, lambda i: (i == 1) | apart(i - 1, i))
        lasts = F.filter(places, lambda i: (i == F.size(t)) | apart(i, i + 1))
        return F.filter(F.zip_with(firsts, lasts, lambda i, j: F.struct(i.alias("i"), j.alias("j"))), lambda e: e["i"] < e["j"])

    def run(e: Column) -> Column:
        first, last = F.element_at(tokens, e["i"]), F.element_at(tokens, e["j"])
        words = F.transform(F.slice(tokens, e["i"], e["j"] - e["i"] + 1), lambda x: x["token"])
        return F.struct(first["start"].alias("start"), last["end"].alias("end"), F.array_join(words, " ").alias("token"), first["before"].alias("before"), last["after"].alias("after"))

    return F.transform(ends(tokens), run)


def looks(token: Column) -> list[Column]:
    """What of an instance's shape counts: its digits, whether it holds letters, whether it holds an at sign."""
    return [F.length(digits(token)).alias("digits"), token.rlike(r"\p{L}").cast("double").alias("letters"), token.contains("@").cast("double").alias("at")]


def likeness() -> Column:
    """From 0 to 1: how like (digits, letters, at) the seeds of a kind (low, high, p_letters, p_at) are."""
    n = F.col("digits") + 1
    near = F.least(F.lit(1.0), n / (F.col("low") + 1), (F.col("high") + 1) / n)
    out = (3 + near) / 4
    for has in ("letters", "at"):
        p = F.col(f"p_{has}")
        out = out * (1 + F.least(F.lit(1.0), F.when(F.col(has) > 0, p).otherwise(1 - p) / F.greatest(p, 1 - p))) / 2
    return out


def with_kinds(texts: DataFrame) -> DataFrame:
    """Tokens and runs of texts (key, base, tokens): key, start, end, token, before, after, the kinds of base spans that a
    token meets, and whether one of these sticks out of it."""
    every = F.explode(F.concat("tokens", runs(F.col("tokens")))).alias("t")
    meets = lambda b: (b["start"] < F.col("t.end")) & (b["end"] > F.col("t.start"))
    out_of = lambda b: (b["start"] < F.col("t.start")) | (b["end"] > F.col("t.end"))
    few = texts.where(F.size("base") <= FEW).select("key", "base", every).withColumn("inside", F.filter("base", meets))
    few = few.select("key", "t.*", F.array_distinct(F.transform("inside", lambda b: b["kind"])).alias("kinds"), F.exists("inside", out_of).alias("partly"))
    # many spans: both sides by the stretches of the text that they lie in
    many = texts.where(F.size("base") > FEW)
    stretches = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}.start") / STRETCH), F.floor((F.col(f"{c}.end") - 1) / STRETCH)))
    tokens = many.select("key", every)
    spans = many.select("key", F.explode("base").alias("b")).select(F.col("key").alias("k"), "b", stretches("b").alias("s"))
    met = tokens.select("key", F.struct("t.start", "t.end").alias("t"), stretches("t").alias("stretch")).join(spans, (F.col("key") == F.col("k")) & (F.col("stretch") == F.col("s"))).where(meets(F.col("b")))
    met = met.groupBy(F.col("key").alias("k"), F.col("t.start").alias("from"), F.col("t.end").alias("to")).agg(F.collect_set("b.kind").alias("kinds"), F.max(out_of(F.col("b"))).alias("partly"))
    many = tokens.join(met, (F.col("key") == F.col("k")) & (F.col("t.start") == F.col("from")) & (F.col("t.end") == F.col("to")), "left")
    many = many.select("key", "t.*", F.coalesce("kinds", F.array().cast("array<int>")).alias("kinds"), F.coalesce("partly", F.lit(False)).alias("partly"))
    return few.unionByName(many)


def discovered(found: DataFrame, rounds: int = ROUNDS, sure: float = SURE, seeds: int = SEEDS) -> DataFrame:
    """key, start, kind, end of the spans that contexts reveal in ``found`` (see detected)."""
    one = found.where(F.size("tokens") > 0).select("key", "base", "tokens").dropDuplicates(["key"])
    rows = with_kinds(one)
    # parts of a base span, and instances of several kinds, are neither seeds nor candidates
    rows = rows.withColumn("other", F.col("partly") | (F.size("kinds") > 1))
    rows = cut(rows.withColumn("seed", F.when(~F.col("other") & (F.size("kinds") == 1), F.col("kinds")[0])).drop("kinds", "partly"), "pii-tokens")
    context = F.explode(F.array(F.concat(F.lit("before "), "before"), F.concat(F.lit("after "), "after"), F.concat("before", F.lit(" _ "), "after")))
    # distinct instances of each context
    graph = cut(rows.where(~F.col("other")).select("token", "seed", context.alias("context")).groupBy("context", "token").agg(F.min("seed").alias("seed")), "pii-graph")
    sizes = cut(graph.groupBy("context").agg(F.count("*").alias("n")), "pii-contexts")
    shown = graph.where("seed is not null").select(F.col("seed").alias("kind"), "token").distinct().select("kind", *looks(F.col("token")))
    shown = cut(shown.groupBy("kind").agg(F.min("digits").alias("low"), F.max("digits").alias("high"), F.avg("letters").alias("p_letters"), F.avg("at").alias("p_at")), "pii-kinds")  # a row for each kind
    told = graph.where("seed is not null").select("context", F.col("seed").alias("kind"))
    open_, members = graph.where("seed is null").select("context", "token"), told
    for step in range(rounds):
        # what earlier rounds are sure of supports its contexts as seeds do
        patterns = members.groupBy("context", "kind").agg(F.count("*").alias("support")).where(F.col("support") >= seeds)
        patterns = patterns.join(sizes, "context").select("context", "kind", (F.col("support") / F.col("n")).alias("confidence"))
        patterns = cut(patterns.where(F.col("confidence") >= sure), f"pii-patterns{step}")
        reached = open_.join(patterns, "context").groupBy("token", "kind").agg(F.max("confidence").alias("confidence"))
        reached = reached.select("token", "kind", "confidence", *looks(F.col("token"))).join(F.broadcast(shown), "kind").select("token", "kind", (F.col("confidence") * likeness()).alias("level"))
        reached = cut(reached.where(F.col("level") >= sure), f"pii-reached{step}")
        members = told.unionByName(open_.join(reached, "token").select("context", "kind"))
    best = reached.groupBy("token").agg(F.max(F.struct("level", "kind"))["kind"].alias("kind"))
    return rows.where(F.col("seed").isNull() & ~F.col("other")).join(best, "token").select("key", "start", "kind", "end")


def outermost(spans: DataFrame) -> DataFrame:
    """key, more: the spans (key, start, kind, end) of each text that don't lie inside a longer one, sorted."""
    ahead = Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    rest = spans.withColumn("reach", F.max("end").over(ahead)).where(F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    return rest.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("more"))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, key, base and spans: arrays of struct<start, kind, end> by start, then kind; spans holds base and more."""
    found = cut(detected(docs), "pii-found")
    more = outermost(discovered(found)).withColumnRenamed("key", "k")
    out = found.join(more, F.col("key") == F.col("k"), "left")
    return out.select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))


def counted(found: DataFrame) -> DataFrame:
    """doc_id, a count for each kind of base span, the digest of base spans, and all spans as text."""
    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    n = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (sorted) replaced by its kind in brackets; a span that starts inside an earlier one goes with it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def parts(x: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:  # of the text, from chunks, so that nothing is counted from its beginning
            first = F.floor(a / STRETCH).cast("int")
            held = F.array_join(F.slice(x["chunks"], first + 1, F.greatest(F.ceil(b / STRETCH).cast("int") - first, F.lit(0))), "")
            return F.substring(held, a - first * STRETCH + 1, b - a)

        cut_out = F.transform(spans, lambda s, i: let(F.get(x["reach"], i), lambda at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise("")))
        return F.concat(F.array_join(cut_out, ""), piece(F.element_at(x["reach"], -1), F.length(text)))

    # code points that are done with before each span, and at the end
    reach = F.concat(F.array(F.lit(0)), scanned(F.transform(spans, lambda s: s["end"]), F.greatest))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    return let(F.struct(chunks.alias("chunks"), reach.alias("reach")), parts)


def blanked(docs: DataFrame) -> DataFrame:
    """docs with the spans of all texts replaced by their kinds; null texts stay null.

    Base spans are found where the text is, so no text is moved for them; the few further spans, a written table whose
    size Spark knows, are joined to their texts.
    """
    found = cut(detected(docs), "pii-found")
    more = cut(outermost(discovered(found)).select(F.col("key").alias("k"), "more"), "pii-more")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    out = docs.select(F.struct(*docs.columns).alias("row"))
    out = out.withColumn("digits", text.rlike("[0-9]")).withColumn("base", F.concat(*[base_spans(text, k, F.col("digits")) for k in KINDS]))
    out = out.join(more, text_key(text) == F.col("k"), "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))))
    blank = F.when(F.size("spans") > 0, redacted(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    return out.select(*[blank.alias(c) if c == "text" else F.col(f"row.{c}") for c in docs.columns])
