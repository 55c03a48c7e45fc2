"""Typed fields from the text of a card."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.bind import let
from ..functions.page import first_value, first_where
from ..functions.page import found as found_in
from ..functions.scoring import acceptable
from ..functions.text import blank_to_null, is_label_line, lines, outer_json, standard_name, without_address
from ..params import ALIASES, FIELDS
from . import layout

_DEATH, _BURIAL = r"(?i)date\s+of\s+death", r"(?i)date\s+of\s+burial"
_STOPS = r"\b(?:date\s+of\s+birth|dob|undertaker|svc|description|sex|age)\b"


def labelled(text: Column, label: str) -> Column:
    """What stands behind a label on its line, up to the next label."""
    found = F.regexp_extract(text, rf"(?im)^.*?\b{label}\b\s*[:.\-]?\s*(.*?)\s*(?:\b(?:owner|address|relation|phone|date of|description|sex|age|undertaker|svc|type of|grave fee|board of)\b.*)?$", 1)
    return blank_to_null(found)


def owner_name(text: Column) -> Column:
    """The name on the first line that isn't a label's and looks like ``Last, First``, else the owner label's."""
    first = F.try_element_at(F.filter(lines(text), lambda x: ~is_label_line(x) & x.rlike(r"^[A-Za-z][A-Za-z'.\- ]+,\s*[A-Za-z]")), F.lit(1))
    return standard_name(without_address(F.coalesce(first, labelled(text, "owner"))))


def minimal_fields(text: Column) -> Column:
    """struct<deceased_name, date_of_death>: the date on the label's own line before any other label, else the latest on it and the two
    lines below, else the only date of a text that has no label of a date."""

    def death(x: Column) -> Column:
        own = lambda t: dates.iso_date(F.regexp_replace(F.regexp_extract(t, rf"{_DEATH}(.*)$", 1), r"(?i)\b(?:date\s+of\s+birth|dob|date\s+of\s+burial|burial)\b.*$", ""))
        return F.coalesce(first_value(F.filter(x, lambda t: t.rlike(_DEATH)), own), dates.labelled_date(x, _DEATH, _STOPS))

    only = let(dates.dates_in(text), lambda x: F.when((F.size(x) == 1) & ~text.rlike(r"(?i)\b(?:death|burial|birth|dob)\b"), x[0]))
    return F.struct(owner_name(text).alias("deceased_name"), F.coalesce(let(lines(text), death), only).alias("date_of_death"))


#: Labels that begin or end a value (fixed values).
_LABEL = r"owner|address|relation|phone|ph\s*#|date\s+of|dob|description|direction|sex|age|undertaker|svc\s*no|board\s+of\s+health|type\s+of\s+grave|grave\s+fee|estate|c/o"
_STREET = r"(?i)^\s*[0-9]{1,6}\s+[A-Za-z].*\b(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|place|pl|court|ct|boulevard|blvd|way|terrace|hwy)\b"
_PLACE = r"(?i)\b(?:section|block|lot|range)\s*#?\s*[0-9A-Z]"


def _begins_label(t: Column) -> Column:
    return t.rlike(rf"(?i)^\s*(?:{_LABEL})(?![A-Za-z])")


def _until_label(rows: Column) -> Column:
    """The rows before the first that begins with a label."""
    at = F.array_position(F.transform(rows, _begins_label), F.lit(True)).cast("int")
    return F.slice(rows, 1, F.when(at > 0, at - 1).otherwise(F.size(rows)))


def _about(rows: Column, label: str) -> Column:
    """struct<before, own, after>: the row before the first with a label, what stands behind the label on its row up to another one, and
    the rows below up to one that begins with a label."""
    at = F.array_position(F.transform(rows, lambda t: t.rlike(rf"(?i)\b(?:{label})(?![A-Za-z])")), F.lit(True)).cast("int")

    def read(i: Column) -> Column:
        rest = F.regexp_extract(rows[i - 1], rf"(?i)\b(?:{label})(?![A-Za-z])\s*[:.#\-]*\s*(.*)$", 1)
        own = blank_to_null(F.regexp_replace(rest, rf"(?i)(?:^|\s)(?:{_LABEL})(?![A-Za-z]).*$", ""))
        before = F.when(i > 1, rows[i - 2])
        return F.when(i > 0, F.struct(before.alias("before"), own.alias("own"), _until_label(F.slice(rows, i + 1, F.greatest(F.size(rows) - i, F.lit(0)))).alias("after")))

    return let(at, read)


def _value(rows: Column, label: str, shape: str = ".", behind: bool = False) -> Column:
    """The value of a label, on its row or else on the next, if it has the shape; ``behind``: or else on the row before."""

    def pick(k: Column) -> Column:
        first = F.try_element_at(k["after"], F.lit(1))
        options = [k["own"], first, F.when(~_begins_label(k["before"]), k["before"])] if behind else [k["own"], first]
        return F.coalesce(*[F.when(o.rlike(shape), o) for o in options])

    return let(_about(rows, label), pick)


def _dates(rows: Column, this_year: int) -> Column:
    """struct<death, burial>: of labels, on their row or one of the two below that isn't of the birth. On a row that names both, a date is
    that of the burial, and one below that of the death. Without either label two dates are death and burial, in this order,
    and two equal ones, or one, the burial's."""
    born = lambda t: t.rlike(r"(?i)\b(?:dob|deb|birth)\b")
    iso = lambda t: let(dates.first_date(t), lambda raw: dates.century_fixed(dates.iso_date(raw), raw, this_year))
    below = lambda k: first_value(F.filter(F.slice(k["after"], 1, 2), lambda t: ~born(t)), iso)
    both = F.exists(rows, lambda t: t.rlike(_DEATH) & t.rlike(_BURIAL))
    # a birth's row ends what belongs to a label, but the dates of death stand below it as often: it isn't a label here
    open_rows = F.transform(rows, lambda t: F.regexp_replace(t, r"(?i)^\s*dob\b", "born dob"))

    def labelled_dates(d: Column, b: Column) -> Column:
        burial = F.coalesce(iso(b["own"]), F.when(~both, below(b)))
        death = F.coalesce(iso(d["own"]), F.when(~both | iso(b["own"]).isNotNull(), below(F.when(both, b).otherwise(d))))
        return F.struct(death.alias("death"), burial.alias("burial"))

    def free(found: Column) -> Column:
        two = F.size(found) >= 2
        second = F.try_element_at(found, F.lit(2))
        first = F.try_element_at(found, F.lit(1))
        return F.struct(F.when(two & (first != second), first).alias("death"), F.when(two, second).otherwise(first).alias("burial"))

    named = F.exists(rows, lambda t: t.rlike(_DEATH) | t.rlike(_BURIAL))
    every = F.filter(F.transform(F.filter(rows, lambda t: ~born(t)), iso), lambda d: d.isNotNull())
    return F.when(named, let(F.struct(_about(open_rows, r"date\s+of\s+death").alias("d"), _about(open_rows, r"date\s+of\s+burial").alias("b")), lambda k: labelled_dates(k["d"], k["b"]))).otherwise(let(every, free))


def _description(rows: Column) -> Column:
    """What stands behind the label and below it, else the rows that name a section, block, lot or range."""
    label = let(_about(rows, "description"), lambda k: blank_to_null(F.concat_ws(" ", k["own"], F.array_join(F.filter(k["after"], lambda t: t.rlike(_PLACE)), " "))))
    return F.coalesce(label, blank_to_null(F.array_join(F.filter(rows, lambda t: t.rlike(_PLACE) & ~_begins_label(t)), " ")))


def all_fields(text: Column, this_year: int | None = None) -> Column:
    """struct of the canonical fields that a card's text states.

    Values stand behind their label, on the row below, or, for an undertaker, above. Years of two digits that would lie ahead of
    ``this_year`` (the driver's, if none is given) are of the 1900s.
    """
    year = this_year or datetime.now(timezone.utc).year

    def read(k: Column) -> Column:
        rows, days = k["rows"], k["days"]
        number = r"^#?\s*[0-9]{1,3}(?:,[0-9]{3})+$|^#?\s*[0-9OoGIl]{4,7}$"
        fee_row = let(_about(rows, r"grave\s+fee"), lambda f: first_value(F.slice(f["after"], 1, 2), lambda t: F.when(t.rlike(number), t)))
        found = {
            "deceased_name": owner_name(text),
            "address": F.coalesce(first_where(rows, lambda t: t.rlike(_STREET)), _value(rows, "address", "[A-Za-z]")),
            "owner": _value(rows, "owner", "[A-Za-z]"),
            "relation": _value(rows, "relation", "[A-Za-z]"),
            "phone": numbers.phone(text),
            "date_of_death": days["death"],
            "date_of_burial": days["burial"],
            "description": _description(rows),
            "sex": numbers.sex(text),
            "age": numbers.age(text),
            "grave_type": _value(rows, r"type\s+of\s+grave", "[A-Za-z]"),
            "grave_fee": let(_value(rows, r"grave\s+fee", "[0-9]"), lambda v: F.coalesce(numbers.money(v), found_in(v, r"^\$?\s*([0-9]{2,4}\.[0-9]{2})$"))),
            "undertaker": _value(rows, "undertaker", "^[A-Za-z]", behind=True),
            "board_of_health_no": _value(rows, r"board\s+of\s+health(?:\s*no)?", "[0-9]"),
            "svc_no": F.coalesce(numbers.service_number(text), _value(rows, r"svc\s*no", number), fee_row),
        }
        return F.struct(*[found[f].alias(f) for f in FIELDS])

    return let(lines(text), lambda rows: let(F.struct(rows.alias("rows"), _dates(rows, year).alias("days")), read))


def canonical(fields: Column) -> Column:
    """A map of field values under canonical names: an older name counts only if the canonical one is absent."""
    old = {v: k for k, v in ALIASES.items()}
    pick = lambda f: F.when(F.map_contains_key(fields, F.lit(f)) | F.lit(f not in old), F.try_element_at(fields, F.lit(f))).otherwise(F.try_element_at(fields, F.lit(old.get(f, f))))
    return F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), F.array(*[blank_to_null(pick(f)) for f in FIELDS]))


def merged_missing(fields: Column, more: Column) -> Column:
    """fields, each blank one filled from ``more`` if what that has is acceptable; other keys of ``more`` are left out."""
    fill = lambda k, b: F.when(acceptable(k, b), b)
    return F.transform_values(fields, lambda k, a: F.coalesce(blank_to_null(a), fill(k, F.try_element_at(more, k)), a))


def answer_fields(answer: Column, required: tuple[str, ...]) -> Column:
    """struct<fields, error> of a model's JSON answer: what is no JSON, or lacks a required key, is an error in the data."""
    parsed = F.from_json(outer_json(answer), "map<string,string>")
    lacking = F.filter(F.array(*[F.lit(k) for k in required]), lambda k: ~F.map_contains_key(parsed, k))
    error = F.when(parsed.isNull(), "no JSON").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))
    return F.struct(parsed.alias("fields"), error.alias("error"))


def answer_text(response: Column) -> Column:
    """The joined texts of a provider's response in either of two nestings."""
    a = F.from_json(response, "struct<output:array<struct<content:array<struct<text:string>>>>>")
    b = F.from_json(response, "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>")
    one = F.flatten(F.transform(a["output"], lambda o: F.transform(o["content"], lambda c: c["text"])))
    two = F.flatten(F.transform(b["candidates"], lambda c: F.transform(c["content"]["parts"], lambda p: p["text"])))
    return F.nullif(F.array_join(F.coalesce(one, two), ""), F.lit(""))


def extracted(cards: DataFrame, text: str = "raw_text") -> DataFrame:
    return cards.withColumn("fields", all_fields(F.col(text))).select(*cards.columns, "fields.*")


def of_cards(cards: DataFrame) -> DataFrame:
    """cards with read_from and the canonical fields, each card read from what it has: ``answer`` (map of fields), else ``words``, by
    layout, else ``raw_text``, of which only name and date of death are taken. Cards with nothing have nulls.

    Rows are split by what they have, so that no card is read twice.
    """
    none = F.lit(None).cast("string")
    has = F.when(F.size(F.coalesce("answer", F.create_map().cast("map<string,string>"))) > 0, "fields").when(F.coalesce(F.size("words"), F.lit(0)) > 0, "words")
    cards = cards.withColumn("read_from", F.coalesce(has, F.when(blank_to_null(F.col("raw_text")).isNotNull(), "text"), F.lit("nothing")))
    keep = cards.columns
    given = cards.where("read_from = 'fields'").withColumn("__c", canonical(F.col("answer"))).select(*keep, *[F.col("__c")[f].alias(f) for f in FIELDS])
    text = cards.where("read_from = 'text'").withColumn("__m", minimal_fields(F.col("raw_text"))).select(*keep, *[(F.col(f"__m.{f}") if f in ("deceased_name", "date_of_death") else none).alias(f) for f in FIELDS])
    nothing = cards.where("read_from = 'nothing'").select(*keep, *[none.alias(f) for f in FIELDS])
    laid = layout.parsed(cards.where("read_from = 'words'"))
    value = lambda f: F.col(f"fields.{f}.value")
    same = {ALIASES.get(f, f): value(f) for f in layout.FIELDS}
    placed = laid.select(*keep, *[same.get(f, none).alias(f) for f in FIELDS])
    return given.unionByName(text).unionByName(nothing).unionByName(placed)
