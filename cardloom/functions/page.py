"""A page's words with boxes as column expressions: lines, anchors, bands, regions. words: array<struct<text, confidence, bbox>>.

Boxes are [x1, y1, x2, y2]. Functions of a page look at nothing but its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

FAR = 1_000_000_000


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or it's empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def shown(words: Column) -> Column:
    """Words that aren't blank."""
    return F.filter(words, lambda w: F.trim(w["text"]) != "")


def joined(words: Column) -> Column:
    return F.trim(F.array_join(F.transform(words, lambda w: w["text"]), " "))


def width(words: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(words, lambda w: w["bbox"][2])), F.lit(0))


def top(words: Column) -> Column:
    return F.array_min(F.transform(words, lambda w: w["bbox"][1]))


def bottom(words: Column) -> Column:
    return F.array_max(F.transform(words, lambda w: w["bbox"][3]))


def share(size: Column, part: float) -> Column:
    """A whole number of pixels."""
    return F.floor(size * F.lit(part)).cast("int")


def boxes(words: Column) -> Column:
    return F.coalesce(F.transform(words, lambda w: w["bbox"]), F.array().cast("array<array<int>>"))


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern is in a text, or in it with all but letters and digits as spaces, so that ``Sex_M`` holds ``sex``."""
    return text.rlike(f"(?i){pattern}") | F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ").rlike(f"(?i){pattern}")


def anchor(words: Column, pattern: str) -> Column:
    """Box of the first word that matches, null if none does."""
    return F.try_element_at(F.filter(words, lambda w: matches(w["text"], pattern)), F.lit(1))["bbox"]


def nearest(words: Column, pattern: str, y: Column, most: int) -> Column:
    """Box of the matching word whose middle is nearest to a height, the first on ties."""
    near = F.transform(words, lambda w, i: F.struct(F.abs(F.floor((w["bbox"][1] + w["bbox"][3]) / 2) - y).alias("d"), i.alias("i"), w["text"].alias("t"), w["bbox"].alias("b")))
    return F.array_min(F.filter(near, lambda k: (k["d"] <= most) & k["t"].rlike(f"(?i){pattern}")))["b"]


def band(words: Column, y0: Column, y1: Column) -> Column:
    """Words that overlap a band of heights, from left to right."""
    inside = F.filter(words, lambda w: ~((w["bbox"][3] < y0) | (w["bbox"][1] > y1)) & (F.trim(w["text"]) != ""))
    return left_to_right(inside)


def right_of(words: Column, box: Column, pad: int, slack: int, xmax: Column | int = FAR) -> Column:
    """Words that begin at least ``pad`` right of a box and at ``xmax`` at most, and overlap its heights widened by ``slack``."""
    most = F.lit(xmax) if isinstance(xmax, int) else xmax
    inside = F.filter(words, lambda w: (w["bbox"][0] >= box[2] + pad) & (w["bbox"][0] <= most) & ~((w["bbox"][3] < box[1] - slack) | (w["bbox"][1] > box[3] + slack)) & (F.trim(w["text"]) != ""))
    return F.when(box.isNotNull(), left_to_right(inside))


def left_to_right(words: Column) -> Column:
    placed = F.transform(words, lambda w, i: F.struct(w["bbox"][0].alias("x"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(placed), lambda k: k["w"])


#: Line numbers that are gathered before they're put by, so that what is copied for a run doesn't grow with the page.
_CHUNK = 128


def _runs(qs: Column) -> Column:
    """array<struct<y, c, at, n>>: stretches of words, in order, that have the same upper and lower edge: that upper edge, their
    middle, where they begin (from 1) and how many they are."""

    def begins(q: Column, i: Column) -> Column:
        before = F.get(qs, i - 1)
        same = q["y"].eqNullSafe(before["y"]) & q["w"]["bbox"][3].eqNullSafe(before["w"]["bbox"][3])
        return F.when((i == 0) | ~same, i)

    def run(starts: Column) -> Column:
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(qs))
        middle = lambda q: (q["y"] + q["w"]["bbox"][3]) / F.lit(2.0)
        return F.transform(starts, lambda a, k: F.struct(qs[a]["y"].alias("y"), middle(qs[a]).alias("c"), (a + 1).alias("at"), (end(k) - a).alias("n")))

    return let(F.filter(F.transform(qs, begins), lambda a: a.isNotNull()), run)


def lines(words: Column, tolerance: float) -> Column:
    """array<struct<text, words>>: the page's lines from top to bottom.

    Words are taken by their upper edge; each joins the first line whose mean height is near enough, or begins one. As edges
    only rise, a line that lies ``tolerance`` above the next edge is closed, so a word is compared with the few lines that are
    open, however long the page is. Words of equal edges that follow each other go to one line, as its mean only comes nearer to
    them: the fold takes each such run in one step. It keeps sums and line numbers only; runs are sorted into their lines afterwards.
    """
    line = "struct<id:int,total:double,n:int>"
    queue = F.array_sort(F.transform(shown(words), lambda w, i: F.struct(w["bbox"][1].alias("y"), w["bbox"][0].alias("x"), i.alias("i"), F.struct(w["text"].alias("text"), w["confidence"].cast("int").alias("confidence"), w["bbox"].alias("bbox")).alias("w"))))
    no_lines, numbers = F.array().cast(f"array<{line}>"), F.array().cast("array<int>")

    def step(s: Column, q: Column) -> Column:
        c, open_ = q["c"], s["open"]
        near = lambda k: F.abs(c - k["total"] / k["n"]) <= tolerance
        over = lambda k: k["total"] / k["n"] < q["y"] - tolerance
        at = F.array_position(F.transform(open_, near), F.lit(True)).cast("int")
        joins = F.exists(open_, near)
        number = F.when(joins, open_[at - 1]["id"]).otherwise(s["n"] + 1)
        joined_ = F.transform(open_, lambda k, i: F.when(i == at - 1, F.struct(k["id"].alias("id"), (k["total"] + c * q["n"]).alias("total"), (k["n"] + q["n"]).alias("n"))).otherwise(k))
        begun = F.array_append(F.filter(open_, lambda k: ~over(k)), F.struct((s["n"] + 1).alias("id"), (c * q["n"]).alias("total"), q["n"].alias("n")))
        full = F.size(s["some"]) >= _CHUNK
        return F.struct(
            F.when(joins, joined_).otherwise(begun).alias("open"), F.when(joins, s["n"]).otherwise(s["n"] + 1).alias("n"),
            F.when(full, F.array_append(s["all"], s["some"])).otherwise(s["all"]).alias("all"), F.when(full, F.array(number)).otherwise(F.array_append(s["some"], number)).alias("some"),
        )

    start = F.struct(no_lines.alias("open"), F.lit(0).alias("n"), F.array().cast("array<array<int>>").alias("all"), numbers.alias("some"))
    of_runs = lambda rs: F.aggregate(rs, start, step, lambda s: F.concat(F.flatten(s["all"]), s["some"]))

    def gathered(tagged: Column) -> Column:
        """Each line with its runs, which stand together by its number: struct<y, id, runs>, from top to bottom."""
        begins = F.filter(F.transform(tagged, lambda t, k: F.when((k == 0) | ~t["id"].eqNullSafe(F.get(tagged, k - 1)["id"]), k)), lambda a: a.isNotNull())
        total = lambda rs: F.aggregate(rs, F.lit(0.0), lambda s, r: s + r["c"] * r["n"]) / F.aggregate(rs, F.lit(0), lambda s, r: s + r["n"])
        of = lambda starts: F.transform(starts, lambda a, k: let(F.slice(tagged, a + 1, F.coalesce(F.get(starts, k + 1), F.size(tagged)) - a), lambda rs: F.struct(total(rs).alias("y"), rs[0]["id"].alias("id"), rs.alias("runs"))))
        return F.array_sort(let(begins, of))

    def in_lines(qs: Column, rs: Column, numbers_: Column) -> Column:
        tagged = F.array_sort(F.transform(rs, lambda r, k: F.struct(numbers_[k].alias("id"), k.alias("k"), r["c"].alias("c"), r["at"].alias("at"), r["n"].alias("n"))))
        one = lambda r: F.transform(F.slice(qs, r["at"], r["n"]), lambda q: q["w"])
        placed = lambda r: F.transform(F.slice(qs, r["at"], r["n"]), lambda q: F.struct(q["x"].alias("x"), q["i"].alias("i"), q["w"].alias("w")))
        many = lambda runs: F.transform(F.array_sort(F.flatten(F.transform(runs, placed))), lambda p: p["w"])
        members = lambda runs: F.when(F.size(runs) == 1, one(runs[0])).otherwise(many(runs))
        return F.transform(let(tagged, gathered), lambda k: let(members(k["runs"]), lambda ws: F.struct(joined(ws).alias("text"), ws.alias("words"))))

    return let(queue, lambda qs: let(_runs(qs), lambda rs: let(of_runs(rs), lambda n: in_lines(qs, rs, n))))


def texts(page_lines: Column) -> Column:
    return F.transform(page_lines, lambda k: k["text"])


def first_where(items: Column, test, n: int = 1) -> Column:
    return F.try_element_at(F.filter(items, test), F.lit(n))


def first_value(items: Column, read) -> Column:
    """The first value that isn't null which ``read`` gives of the items."""
    return F.try_element_at(F.filter(F.transform(items, read), lambda v: v.isNotNull()), F.lit(1))


def first_tokens(text: Column, k: int) -> Column:
    """The first ``k`` tokens of a text, null if there are none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    return F.nullif(F.array_join(F.slice(parts, 1, k), " "), F.lit(""))
