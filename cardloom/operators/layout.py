"""Typed fields from a page's words with boxes: by anchors and regions first, then, for damaged pages of the second template, by a
chain of dearer readings of its lines.

``parsed`` works in two steps. All pages are read by their layout. Pages of the second template that lack four of nine keys then
take another way: rows are split, and only those go through the chain.

Cases: pages without words have no fields; blank words are skipped; the first of equally good anchors counts; null texts and boxes
aren't expected in a word; other columns stay, but for names beginning with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import page as P
from ..functions.bind import let
from ..functions.dates import any_form
from ..functions.numbers import money, phone
from ..functions.text import blank_to_null
from ..sources.tables import settled

FIELDS = (
    "owner_name", "owner_address", "care_of", "phone", "date_of_death", "date_of_burial", "date_of_birth", "lot_no", "range", "grave_no", "section_no", "block_side",
    "sex", "age", "type_of_grave", "grave_fee", "undertaker", "svc_no",
)
#: Of these, four missing make a page a damaged one.
WATCHED = ("phone", "date_of_death", "date_of_burial", "date_of_birth", "grave_no", "section_no", "block_side", "sex", "age")
DAMAGED = 4
#: Marks of the second template (fixed values).
MARKS = ("contact information", "sex:", "date of death")
#: Words that recognition puts into the row of the grave's type (fixed values), as letters and digits.
JUNK = ("hoy", "on", "2")
_WORDED, _NUMERIC = r"([A-Za-z]+\.?\s+[0-9]{1,2},\s+[0-9]{4})", r"([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})"
_DEATH, _BURIAL, _BIRTH = r"(?i)\bdate\s+of\s+death\b", r"(?i)\bdate\s+of\s+bur(?:i|ia)l\b", r"(?i)\b(?:d(?:ate)?\s*of|dacof)\s+birth\b"


def written_date(text: Column) -> Column:
    """A date as it stands: one with its month spelled first. Letters and brackets that recognition puts for others are mended."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "Qctober|Oclober|0ctober", "October"), r"([0-9]{3})[\])]", "$11"), r"[_\s]+", " ")
    return let(clean, lambda t: F.coalesce(P.found(t, _WORDED), P.found(t, _NUMERIC)))


def short_hyphens(text: Column) -> Column:
    """``03-20-1994`` as ``3-20-94``; what is no date of hyphens stays."""
    p = r"^([0-9]{1,2})-([0-9]{1,2})-(?:[0-9]{2})?([0-9]{2})$"
    bare = F.regexp_replace(text, "[^0-9-]", "")
    short = let(bare, lambda b: F.when(b.rlike(p), F.concat_ws("-", F.regexp_extract(b, p, 1).cast("int").cast("string"), F.regexp_extract(b, p, 2).cast("int").cast("string"), F.regexp_extract(b, p, 3))))
    return F.when(F.contains(text, F.lit("-")), F.coalesce(short, text)).otherwise(text)


def mended_hyphens(text: Column) -> Column:
    """A date of hyphens of which one was lost: ``35-2094`` is 3-20-94. Null if it is none."""
    p = r"^([0-9])[0-9]-([0-9]{2})([0-9]{2})$"

    def read(b: Column) -> Column:
        month, day = F.regexp_extract(b, p, 1), F.regexp_extract(b, p, 2)
        lost = F.when(b.rlike(p) & month.between("1", "9") & day.between("01", "31"), F.concat_ws("-", month, day.cast("int").cast("string"), F.regexp_extract(b, p, 3)))
        return F.when(b.rlike(r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}$"), short_hyphens(b)).otherwise(lost)

    return let(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[^0-9-]", ""), "-+", "-"), "^-|-$", ""), read)


def header(words: Column, texts: Column, w: Column) -> Column:
    """struct<name, address>: of the first line, cut at its first number, or a name if it has a comma; else the words of two
    regions of the page's head."""
    ends = lambda c: F.nullif(F.regexp_replace(c, r"^[ \-_,]+|[ \-_,]+$", ""), F.lit(""))
    number = r"^(.*?)(\b[0-9]{1,6}\b.*)$"
    head = P.left_to_right(F.filter(words, lambda x: x["bbox"][1] <= P.top(words) + 40))
    region = lambda a, b: blank_to_null(P.joined(F.filter(head, lambda x: (x["bbox"][0] >= w * a) & (x["bbox"][0] < w * b))))

    def read(first: Column) -> Column:
        cut = F.struct(ends(F.regexp_extract(first, number, 1)).alias("name"), ends(F.regexp_extract(first, number, 2)).alias("address"))
        name = F.struct(blank_to_null(first).alias("name"), F.lit(None).cast("string").alias("address"))
        regions = F.struct(region(-1.0, 0.38).alias("name"), region(0.38, 0.92).alias("address"))
        return F.when(first.rlike(number), cut).when(F.contains(first, F.lit(",")), name).otherwise(regions)

    return let(F.trim(F.regexp_replace(F.coalesce(F.try_element_at(texts, F.lit(1)), F.lit("")), r"\s+", " ")), read)


def _sides(block: Column, side: Column) -> Column:
    """``Block 2 Northside``; an @ is a two."""
    return F.when(block.isNotNull(), F.concat_ws(" ", F.lit("Block"), F.translate(block, "@", "2"), side))


def compact_location(text: Column) -> Column:
    """Lot, range, grave, section and block of one line of description."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[~_]+", " "), r"\s*-\s*", " - "), r"\s+", " ")
    block = r"(?i)\bBlock\b\s*#?\s*([0-9@]{1,3})\s*([A-Za-z]{1,12})?\b"
    part = lambda word, kind: P.found(t, rf"(?i)\b{word}\b\s*#?\s*({kind})\b")
    return F.struct(part("Lot", "[0-9]{1,4}").alias("lot_no"), part("Range", "[A-Za-z0-9]{1,3}").alias("range"), part("Grave", "[0-9]{1,4}").alias("grave_no"), part("Section", "[0-9]{1,3}").alias("section_no"), _sides(P.found(t, block), P.found(t, block, 2)).alias("block_side"))


def row_of_text(texts: Column) -> Column:
    """struct<sex, age, type_of_grave, grave_fee> of the first line that names sex and age."""
    row = P.first_where(texts, lambda t: t.rlike(r"(?i)\bSex\b") & t.rlike(r"(?i)\bAge\b"))

    def read(t: Column) -> Column:
        kind = P.found(t, r"(?i)\bType\s+of\s+Grave\b\s*(.*?)(?=\bGrave\s*Fee\b|$)")
        label = F.lower(P.first_tokens(kind, 2)).isin("grave", "type")
        cents = r"(?i)\bGrave\s*F\w*\$?\s*([0-9]{2,4})\s*[-.]\s*([0-9]{2})\b"
        fee = F.coalesce(F.concat(P.found(t, cents), F.lit("."), P.found(t, cents, 2)), P.found(t, r"\$\s*([0-9]{2,4})"))
        return F.struct(F.upper(P.found(t, r"(?i)\bSex\b\s*([MF])\b")).alias("sex"), P.found(t, r"(?i)\bAge\b\s*([0-9]{1,3})\b").alias("age"), F.when(~label, P.first_tokens(kind, 4)).alias("type_of_grave"), fee.alias("grave_fee"))

    return let(F.trim(F.regexp_replace(row, r"[_\s]+", " ")), read)


def row_words(words: Column) -> Column:
    """The words of the row of sex, age, type and fee, found by the first of these labels that the page has."""
    at = F.coalesce(*[P.anchor(words, p) for p in (r"\bsex\b", r"\bage\b", r"\btype\b", r"\bfe\b|\bfee\b")])
    return let(at, lambda a: F.when(a.isNotNull(), P.band(words, a[1] - 25, a[3] + 25)))


def row_of_layout(row: Column) -> Column:
    """struct<sex, age, type_of_grave, grave_fee> of the words of that row."""
    token = lambda w: F.regexp_replace(F.lower(w["text"]), "[^a-z0-9]+", "")
    text = P.joined(row)
    plain = F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))
    grave = F.array_position(F.transform(row, lambda w: token(w) == "grave"), F.lit(True)).cast("int")
    fee = F.array_position(F.transform(row, lambda w: (token(w) == "fee") | (F.lower(F.trim(w["text"])) == "fe$")), F.lit(True)).cast("int")

    def kind(at: Column) -> Column:
        between = F.slice(row, at["grave"] + 1, F.greatest(F.when(at["fee"] > at["grave"] + 1, at["fee"] - 1).otherwise(F.size(row)) - at["grave"], F.lit(0)))
        value = P.first_tokens(P.joined(F.filter(between, lambda w: ~token(w).isin(*JUNK))), 2)
        low = F.lower(value)
        return F.when((at["grave"] > 0) & ~F.contains(low, F.lit("fee")) & ~low.isin("grave", "type", "type of", "type of grave"), value)

    both = let(F.struct(grave.alias("grave"), fee.alias("fee")), kind)
    return F.when(row.isNotNull(), F.struct(F.upper(P.found(plain, r"(?i)\bsex\s*([MF])\b")).alias("sex"), P.found(plain, r"(?i)\bage\s*([0-9]{1,3})\b").alias("age"), both.alias("type_of_grave"), money(text).alias("grave_fee")))


_THOUSANDS, _DIGITS = r"\b([0-9]{1,3}(?:,[0-9]{3})+)\b", r"\b([0-9]{4,7})\b"


def service_of_text(texts: Column) -> Column:
    def read(t: Column) -> Column:
        digits = F.regexp_replace(F.translate(P.found(t, r"\b([0-9GOIl]{4,7})\b"), "OoGIl", "00811"), "[^0-9]", "")
        return F.when(t.rlike(r"(?i)\bSVC\b"), F.coalesce(P.found(t, _THOUSANDS), F.when(F.length(digits) >= 4, digits)))

    return P.first_value(texts, read)


def service_anchor(words: Column, w: Column) -> Column:
    """Box of the best of the words that name the service number: one whose row has a ``No``, low and left, from the left part
    of the page if that has any; the first of equally good ones."""
    named = F.filter(words, lambda x: F.lower(F.trim(x["text"])).rlike(r"\bsvc\b"))
    left = F.filter(named, lambda x: x["bbox"][0] < P.share(w, 0.45))

    def score(x: Column, i: Column) -> Column:
        b = x["bbox"]
        has_no = P.joined(P.band(words, b[1] - 16, b[3] + 16)).rlike(r"(?i)\bN[O0]\b")
        return F.struct((F.when(has_no, 100).otherwise(0) + F.floor((b[1] + b[3]) / 2) + w - b[0]).alias("score"), (-i).alias("i"), b.alias("b"))

    return F.array_max(F.transform(F.when(F.size(left) > 0, left).otherwise(named), score))["b"]


def service_of_layout(words: Column, w: Column) -> Column:
    def read(a: Column) -> Column:
        line = P.joined(P.band(words, a[1] - 18, a[3] + 18))
        beside = P.joined(P.right_of(words, a, 6, 20, P.share(w, 0.60)))
        return F.when(a.isNotNull(), F.coalesce(*[P.found(t, p) for t in (line, beside) for p in (_THOUSANDS, _DIGITS)]))

    return let(service_anchor(words, w), read)


def damaged_template(texts: Column) -> Column:
    low = F.lower(F.array_join(texts, "\n"))
    return F.contains(low, F.lit(MARKS[0])) | F.contains(low, F.lit(MARKS[1])) | F.contains(low, F.lit(MARKS[2]))


def by_layout(pages: DataFrame, words: str = "words") -> DataFrame:
    """pages with __texts, __w, the fields as ``__<field>`` and the words they were read from as ``__<part>_words``."""
    ws = F.col(words)
    out = pages.withColumn("__texts", P.texts(P.lines(ws, 10.0))).withColumn("__w", P.width(ws))
    w, texts = F.col("__w"), F.col("__texts")
    places = {"estate": r"\bestate\b", "death": r"\bdeath\b", "burial": r"\b(?:burial|buriat|buriai|buria1)\b", "dob": r"\bdob\b", "lot": r"\blot#\b|\blot\b", "section": r"\bsection\b", "description": r"\bdescription\b", "undertaker": r"\bundertaker\b"}
    out = out.withColumns({f"__a_{k}": P.anchor(ws, p) for k, p in places.items()})
    a = {k: F.col(f"__a_{k}") for k in places}
    row = lambda k, above, below: F.when(a[k].isNotNull(), P.band(ws, a[k][1] - above, a[k][1 if k != "description" else 3] + below))
    out = out.withColumns({
        "__care_words": P.right_of(ws, a["estate"], 8, 12, w), "__death_words": P.right_of(ws, a["death"], 8, 14, P.share(w, 0.60)), "__burial_words": P.right_of(ws, a["burial"], 8, 24, w),
        "__birth_words": P.right_of(ws, a["dob"], 8, 14), "__lot_words": row("lot", 18, 18), "__section_words": row("section", 18, 18), "__description_words": row("description", 18, 28),
        "__undertaker_words": P.right_of(ws, a["undertaker"], 8, 10, P.share(w, 0.60)), "__head": header(ws, texts, w), "__row": row_of_text(texts),
    })
    said = lambda k: P.joined(F.col(f"__{k}_words"))
    lot, section = said("lot"), said("section")
    out = out.withColumns({
        "__lot_no": P.found(lot, r"(?i)LOT#\s*([0-9]+)"), "__range": P.found(lot, r"(?i)\bRange\s*([A-Za-z0-9]+)\b"), "__grave_no": P.found(lot, r"(?i)Grave#\s*([0-9]+)"),
        "__section_no": P.found(section, r"(?i)\bSection\s*([0-9]+)"), "__block_side": blank_to_null(P.found(section, r"(?i)\bSection\s*[0-9]+\s*(.*)$")),
        "__compact": compact_location(said("description")), "__row_words": F.when(F.exists(F.array("__row.sex", "__row.age", "__row.type_of_grave", "__row.grave_fee"), lambda x: x.isNull()) | F.col("__row").isNull(), row_words(ws)),
    })
    out = out.withColumn("__placed", row_of_layout(F.col("__row_words")))
    some = lambda k: F.coalesce(F.col(f"__{k}"), F.col(f"__compact.{k}"))
    either = lambda k: F.coalesce(F.col(f"__row.{k}"), F.col(f"__placed.{k}"))
    birth = said("birth")
    values = {
        "owner_name": F.col("__head.name"), "owner_address": F.col("__head.address"), "care_of": blank_to_null(said("care")), "phone": phone(F.array_join(texts, " ")),
        "date_of_death": any_form(short_hyphens(written_date(said("death")))), "date_of_burial": any_form(F.coalesce(short_hyphens(written_date(said("burial"))), mended_hyphens(said("burial")))),
        "date_of_birth": any_form(F.coalesce(written_date(birth), blank_to_null(birth))), **{k: some(k) for k in ("lot_no", "range", "grave_no", "section_no", "block_side")},
        **{k: either(k) for k in ("sex", "age", "type_of_grave", "grave_fee")}, "undertaker": P.first_tokens(said("undertaker"), 1), "svc_no": F.coalesce(service_of_text(texts), service_of_layout(ws, w)),
    }
    return out.withColumns({f"__{k}": v for k, v in values.items()}).drop("__head", "__row", "__placed", "__compact", *(f"__a_{k}" for k in places))


def is_damaged() -> Column:
    """Of ``by_layout``'s rows: pages of the second template that lack so many of the keys."""
    lacking = sum((blank_to_null(F.col(f"__{k}")).isNull().cast("int") for k in WATCHED[1:]), blank_to_null(F.col(f"__{WATCHED[0]}")).isNull().cast("int"))
    return damaged_template(F.col("__texts")) & (lacking >= DAMAGED)


def _loose(text: Column) -> Column:
    """The text with what recognition confuses in dates mended."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)\b[Q0]ctober\b", "October"), r"(?i)\b0ct\b", "Oct"), r"[^\w\s,/-]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(clean, r",\s*([0-9]{4})\b", ", $1"), r"\s+", " "))


_M, _N = r"\b([A-Za-z]+)\s+([0-9]{1,2}),\s*([0-9]{4})\b", r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})\b"


def _said(t: Column) -> Column:
    """One written date, its day and month without zeros before them."""
    whole = lambda c: c.cast("int").cast("string")
    spelled = F.concat(P.found(t, _M), F.lit(" "), whole(P.found(t, _M, 2)), F.lit(", "), P.found(t, _M, 3))
    return F.coalesce(spelled, F.concat_ws("/", whole(P.found(t, _N)), whole(P.found(t, _N, 2)), F.when(t.rlike(_N), P.found(t, _N, 3))))


def loose_dates(text: Column) -> Column:
    """All dates of a line with their month spelled, or else all in numbers, in order."""

    def read(t: Column) -> Column:
        spelled, numeric = (F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (_M, _N))
        return F.transform(F.when(F.size(spelled) > 0, spelled).otherwise(numeric), _said)

    return let(_loose(F.coalesce(text, F.lit(""))), read)


def dates_of_lines(texts: Column, label: str) -> Column:
    """The date on the first line with a label that has one on it or on the two lines below."""
    near = F.transform(texts, lambda t, i: F.struct(t.alias("t"), F.slice(texts, i + 1, 3).alias("ts")))
    return P.first_value(F.filter(near, lambda k: k["t"].rlike(label)), lambda k: P.first_value(k["ts"], lambda t: F.try_element_at(loose_dates(t), F.lit(1))))


def location_of_lines(texts: Column) -> Column:
    """Lot, range and grave of the line of the description; section and block also of the two lines below, the last that has them."""
    at = F.array_position(F.transform(texts, lambda t: t.rlike(r"(?i)\bdescription\b")), F.lit(True)).cast("int")
    three = F.when(at > 0, F.slice(texts, at, 3)).otherwise(F.array().cast("array<string>"))
    block, side, rest = r"(?i)\bBlock\s*#?\s*([0-9@]{1,3})\b", r"(?i)\b(Northside|Southside|Eastside|Westside)\b", r"(?i)\bBlock\s*[0-9@]{1,3}\s+([A-Za-z]{4,12})\b"

    def step(s: Column, t: Column) -> Column:
        here = F.coalesce(_sides(P.found(t, block), F.initcap(P.found(t, side))), s["block"])
        more = F.when(~here.rlike("Northside|Southside"), P.found(t, rest))
        return F.struct(F.coalesce(P.found(t, r"(?i)\bSection\s*#?\s*([0-9]{1,3})\b"), s["section"]).alias("section"), F.when(more.isNotNull(), F.concat_ws(" ", here, more)).otherwise(here).alias("block"))

    def read(ts: Column) -> Column:
        first = F.try_element_at(ts, F.lit(1))
        empty = F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("block"))
        return let(F.aggregate(ts, empty, step), lambda s: F.struct(
            P.found(first, r"(?i)\bLot\s*#?\s*([0-9]{1,4})\b").alias("lot_no"), P.found(first, r"(?i)\bRange\s*([A-Za-z0-9]{1,3})\b").alias("range"),
            P.found(first, r"(?i)\b(?:Grave|Gave)\s*#?\s*([0-9]{1,4})\b").alias("grave_no"), s["section"].alias("section_no"), s["block"].alias("block_side"),
        ))

    return let(three, read)


def row_of_colons(texts: Column) -> Column:
    """struct<sex, age, type_of_grave, grave_fee> of the first line that has ``Sex:`` and ``Age:``; a bracket in an age is a one."""
    row = P.first_where(texts, lambda t: t.rlike(r"(?i)\bsex\s*:") & t.rlike(r"(?i)\bage\s*:"))

    def read(t: Column) -> Column:
        age = F.translate(P.found(t, r"(?i)\bAge\s*:\s*([0-9)(]{1,3})\b"), ")(", "11")
        kind = P.first_tokens(P.found(t, r"(?i)\bType\s+of\s+Grave\s*:\s*(.*?)(?=\bGrave\s*Fee\s*:|$)"), 3)
        return F.struct(F.upper(P.found(t, r"(?i)\bSex\s*:\s*([MF])\b")).alias("sex"), age.alias("age"), kind.alias("type_of_grave"), money(P.found(t, r"(?i)\bGrave\s*Fee\s*:\s*([$0-9][0-9,.\- ]{0,15})")).alias("grave_fee"))

    return let(F.trim(F.regexp_replace(row, r"[_\s]+", " ")), read)


def header_of_lines(texts: Column) -> Column:
    """struct<name, address> of the first line, cut at its first number; what stands in brackets is no part of the name."""
    first = F.trim(P.first_where(texts, lambda t: F.trim(t) != ""))
    p = r"^(.*?)(\b[0-9]{1,6}\b.*)$"
    name = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(first, p, 1), r"\([^)]*\)", "")), "^[ ,]+|[ ,]+$", "")
    return F.struct(F.nullif(name, F.lit("")).alias("name"), F.nullif(F.regexp_replace(F.trim(F.regexp_extract(first, p, 2)), r"\b([0-9]{3})\s+([0-9]{2})\b", "$1$2"), F.lit("")).alias("address"))


def type_and_fee(words: Column, w: Column) -> Column:
    """struct<type_of_grave, grave_fee>: between a label ``Type``, of the page's lower part if it can be, and the label of the fee
    on the same row; and right of that."""
    low = F.filter(words, lambda x: x["bbox"][1] >= P.share(F.greatest(P.bottom(words), F.lit(1)), 0.55))
    kind = F.coalesce(F.try_element_at(F.filter(low, lambda x: x["text"].rlike(r"(?i)\btype\b")), F.lit(1))["bbox"], P.anchor(words, r"\btype\b"))

    def read(a: Column) -> Column:
        y = F.floor((a[1] + a[3]) / 2)
        fee = F.coalesce(P.nearest(words, r"\bfee\b|\bfec\b|\bfe\b", y, 40), P.nearest(words, r"\bgrave\b", y, 40))

        def both(f: Column) -> Column:
            between = P.joined(P.right_of(words, a, 4, 30, F.coalesce(f[0], w)))
            return F.struct(P.first_tokens(F.regexp_replace(between, r"(?i)\b(?:of|grave)\b", ""), 3).alias("type_of_grave"), money(P.joined(P.right_of(words, f, 4, 40, w))).alias("grave_fee"))

        return F.when(a.isNotNull(), let(fee, both))

    return let(kind, read)


def by_fallbacks(read: DataFrame, words: str = "words") -> DataFrame:
    """``by_layout``'s rows with what is missing filled by the chain of readings."""
    texts, ws, w = F.col("__texts"), F.col(words), F.col("__w")
    both = P.first_where(texts, lambda t: t.rlike(_DEATH) & t.rlike(_BURIAL))
    more = {"__two": loose_dates(both), "__place": location_of_lines(texts), "__colons": row_of_colons(texts), "__split": header_of_lines(texts), "__tf": type_and_fee(ws, w)}
    more |= {"__ld": dates_of_lines(texts, _DEATH), "__lb": dates_of_lines(texts, _BURIAL), "__lc": dates_of_lines(texts, _BIRTH)}
    out = read.withColumns(more)
    pair = lambda n: F.when(F.size("__two") >= 2, F.try_element_at("__two", F.lit(n)))
    old = lambda k: blank_to_null(F.col(f"__{k}"))
    fills = {"date_of_death": (pair(1), F.col("__ld")), "date_of_burial": (pair(2), F.col("__lb")), "date_of_birth": (F.col("__lc"),)}
    fills |= {k: (F.col(f"__place.{k}"),) for k in ("lot_no", "range", "grave_no", "section_no", "block_side")}
    fills |= {k: (F.col(f"__colons.{k}"),) for k in ("sex", "age")} | {k: (F.col(f"__colons.{k}"), F.col(f"__tf.{k}")) for k in ("type_of_grave", "grave_fee")}
    name = F.col("__owner_name")
    values = {k: F.coalesce(old(k), *v, F.col(f"__{k}")) for k, v in fills.items()}
    values["owner_name"] = F.when(name.isNull() | name.rlike("[0-9]"), F.coalesce("__split.name", name)).otherwise(name)
    values["owner_address"] = F.coalesce(old("owner_address"), F.col("__split.address"), F.col("__owner_address"))
    return out.withColumns({f"__{k}": v for k, v in values.items()}).drop(*more)


def _wrapped(pages: DataFrame, keep: list[str], words: str) -> DataFrame:
    """One struct<value, support> for each field; support holds the boxes that the value was looked for in."""
    w, ws = F.col("__w"), F.col(words)
    head = P.left_to_right(F.filter(ws, lambda x: x["bbox"][1] <= P.top(ws) + 40))
    lot, section = (F.coalesce(F.col(f"__{k}_words"), F.when(F.exists(F.array("__lot_no", "__range", "__grave_no", "__section_no", "__block_side"), lambda x: x.isNotNull()), F.col("__description_words"))) for k in ("lot", "section"))
    support = {"owner_name": F.filter(head, lambda x: x["bbox"][0] < w * 0.38), "owner_address": F.filter(head, lambda x: (x["bbox"][0] >= w * 0.38) & (x["bbox"][0] < w * 0.78))}
    support |= {"care_of": F.col("__care_words"), "date_of_death": F.col("__death_words"), "date_of_burial": F.col("__burial_words"), "date_of_birth": F.col("__birth_words"), "undertaker": F.col("__undertaker_words")}
    support |= {k: lot for k in ("lot_no", "range", "grave_no")} | {k: section for k in ("section_no", "block_side")} | {k: F.col("__row_words") for k in ("sex", "age", "type_of_grave", "grave_fee")}
    none = F.array().cast("array<array<int>>")
    return pages.select(*keep, F.struct(*[F.struct(F.col(f"__{k}").alias("value"), (P.boxes(support[k]) if k in support else none).alias("support")).alias(k) for k in FIELDS]).alias("fields"))


def parsed(pages: DataFrame, words: str = "words") -> DataFrame:
    """pages with fields: a struct<value, support> for each of FIELDS.

    What the layout gives is written once, so that the split reads it and no page is parsed twice.
    """
    keep = [c for c in pages.columns]
    read = settled(by_layout(pages, words).withColumn("__damaged", is_damaged()), "layout")
    whole, damaged = read.where("NOT __damaged"), by_fallbacks(read.where("__damaged"), words)
    return _wrapped(whole, keep, words).unionByName(_wrapped(damaged, keep, words))


#: Parts that show that a line is no name (fixed values).
NO_NAME = ("c/o", "estate", "owner", "relation", "contact", "information", "date", "death", "burial", "birth", "description", "undertaker", "svc")


def _untitled(c: Column) -> Column:
    """Without titles in brackets, and without a comma or space at the end."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?i)\(\s*(?:mr|mrs|ms|miss|dr)\.?,?\s*\)", ""), r"\s+", " ")
    return F.trim(F.regexp_replace(F.trim(F.replace(plain, F.lit(" ,"), F.lit(","))), ",+$", ""))


def name_of_words(words: Column) -> Column:
    """struct<value, support>: the owner's name from a page's lines.

    1. Of the first six lines: ``LAST, First`` without a number and without the words of a label, the one with the earliest comma.
    2. Of the first eight: a line that is a last name alone; its first names are up to three words of the line above.
    3. The top line, up to its first number.
    """

    def read(ls: Column) -> Column:
        placed = F.transform(ls, lambda k, i: F.struct(i.alias("i"), k["text"].alias("t"), k["words"].alias("w")))
        named = lambda t: (t != "") & ~F.lower(t).rlike("|".join(NO_NAME))
        plain = lambda t: named(t) & ~t.rlike(r"\b[0-9]{2,5}\b")
        full = F.filter(F.slice(placed, 1, 6), lambda k: plain(k["t"]) & k["t"].rlike(r"^\s*[A-Z][A-Z'\-]{2,},\s*[A-Za-z]."))
        best = F.array_min(F.transform(full, lambda k: F.struct(F.instr(k["t"], ",").alias("c"), k["i"].alias("i"), k["t"].alias("t"), k["w"].alias("w"))))
        last = F.try_element_at(F.filter(F.slice(placed, 1, 8), lambda k: plain(k["t"]) & k["t"].rlike(r"^\s*[A-Z][A-Z'\-]{2,}\s*,?\s*$")), F.lit(1))
        head = F.try_element_at(placed, F.lit(1))
        cut = lambda t: _untitled(F.regexp_extract(F.trim(t), r"^(.*?)(?=\s+[0-9]{2,5}\b|$)", 1))

        def alone(k: Column) -> Column:
            up = F.when(k["i"] > 0, F.try_element_at(placed, k["i"]))
            given = F.when(named(up["t"]), P.first_tokens(cut(up["t"]), 3))
            own = P.found(k["t"], r"^\s*([A-Z][A-Z'\-]{2,})")
            value = F.when(given.isNotNull(), _untitled(F.concat(own, F.lit(", "), given))).otherwise(F.concat(own, F.lit(",")))
            return F.struct(value.alias("value"), P.boxes(F.when(given.isNotNull(), F.concat(up["w"], k["w"])).otherwise(k["w"])).alias("support"))

        first = let(best, lambda k: F.struct(blank_to_null(_untitled(k["t"])).alias("value"), P.boxes(k["w"]).alias("support")))
        third = let(head, lambda k: F.struct(blank_to_null(cut(k["t"])).alias("value"), P.boxes(k["w"]).alias("support")))
        return F.when(F.size(full) > 0, first).when(last.isNotNull(), let(last, alone)).otherwise(third)

    return let(P.lines(words, 12.0), read)
