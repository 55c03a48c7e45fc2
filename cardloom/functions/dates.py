"""Dates as they stand on cards, to ISO text. All functions give null where no valid date is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

#: What recognition confuses in months and years (fixed values): pattern, replacement.
CONFUSED = (("[Q0]ctober", "October"), ("[Q0]ct\\.", "Oct"), ("Buriat", "Burial"), ("Buria\\|", "Burial"), ("Dacof", "Date of"), ("(\\d{3})\\]", "$11"), ("(\\d{2})Z(\\d)", "$12$2"))
#: The same in letters of either case and before other characters, and years such as ``202l``: additions of this library.
NOISE = (*CONFUSED, ("(?i)\\b[q0]ctober\\b", "October"), ("(?i)\\b[q0]ct\\b", "Oct"), ("(?i)\\bburiat\\b", "Burial"), ("(?i)\\bdacof\\b", "Date of"), ("\\b20(\\d)[Il]", "20$11"))
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WORDED = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?(?:\s*,\s*|\s+)([0-9]{4}|[0-9]{2})\b"
NUMBERED = r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4}|[0-9]{2})\b"


def denoised(c: Column) -> Column:
    for pattern, right in NOISE:
        c = F.regexp_replace(c, pattern, right)
    return c


def full_year(two_or_four: Column, pivot: int = 50) -> Column:
    """A year of two digits from the pivot on is in the 1900s, else in the 2000s."""
    y = two_or_four.cast("int")
    return F.when(F.length(two_or_four) == 4, y).when(y >= pivot, y + 1900).otherwise(y + 2000)


def _iso(year: Column, month: Column, day: Column) -> Column:
    return let(F.format_string("%04d-%02d-%02d", year, month, day), lambda t: F.when(F.try_to_date(t, "yyyy-MM-dd").isNotNull(), t))


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_date(c: Column) -> Column:
    """The first date in a text as it stands there; one with a month's name goes first."""
    return let(denoised(c), lambda t: F.coalesce(_found(t, WORDED), _found(t, NUMBERED)))


def _read_date(t: Column) -> Column:
    """ISO text of one date as it stands in a text."""
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(_found(t, WORDED, 1), 1, 3))).cast("int")
    worded = let(_found(t, WORDED, 3), lambda y: _iso(full_year(y), month, _found(t, WORDED, 2).cast("int")))
    numbered = let(_found(t, NUMBERED, 3), lambda y: _iso(full_year(y), _found(t, NUMBERED, 1).cast("int"), _found(t, NUMBERED, 2).cast("int")))
    return F.coalesce(worded, numbered)


def iso_date(c: Column) -> Column:
    """``Month D, YYYY``, ``M/D/Y`` or ``M-D-Y`` as ISO text; years have two or four digits."""
    return let(first_date(c), _read_date)


def valid_iso(c: Column) -> Column:
    """The text itself if it is a valid ISO date."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), c)


def normal_date(c: Column) -> Column:
    """For comparison: ISO where it can be made, the empty text for blanks, else null."""
    return let(F.trim(F.coalesce(c, F.lit(""))), lambda t: F.when(t == "", F.lit("")).otherwise(F.coalesce(valid_iso(t), iso_date(t))))


def strict_date(c: Column) -> Column:
    """As normal_date, but what can't be read raises an error."""
    return F.coalesce(normal_date(c), F.raise_error(F.concat(F.lit("not a date: "), c)).cast("string"))


def century_fixed(iso: Column, raw: Column, this_year: int) -> Column:
    """A year that lies ahead by more than one, read from two digits, belongs to the century before."""
    short = raw.rlike(r"(?:^|[^0-9])[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2}\s*$")
    year = F.substring(iso, 1, 4).cast("int")
    return F.when(short & (year > this_year + 1), F.concat(F.lpad((year - 100).cast("string"), 4, "0"), F.substring(iso, 5, 6))).otherwise(iso)


def dates_in(c: Column) -> Column:
    """All dates of a text as ISO, those with a month's name first; none for a null text."""
    every = let(denoised(F.coalesce(c, F.lit(""))), lambda t: F.concat(F.regexp_extract_all(t, F.lit(WORDED), F.lit(0)), F.regexp_extract_all(t, F.lit(NUMBERED), F.lit(0))))
    return F.filter(F.transform(every, lambda t: _read_date(t)), lambda d: d.isNotNull())


def labelled_date(lines: Column, label: str, stops: str) -> Column:
    """The latest date on the line with a label, or on the two lines after it, before any line that matches ``stops``."""

    def latest(near: Column) -> Column:
        first = F.regexp_replace(F.regexp_replace(F.try_element_at(near, F.lit(1)), f"^.*?{label}", ""), f"(?i)({stops}).*$", "")
        rest = F.slice(near, 2, 2)
        at = F.array_position(F.transform(rest, lambda x: x.rlike(f"(?i){stops}")), F.lit(True)).cast("int")
        before = F.slice(rest, 1, F.when(at > 0, at - 1).otherwise(2))
        return F.array_max(F.flatten(F.transform(F.concat(F.array(first), before), lambda x: dates_in(x))))

    at = F.array_position(F.transform(lines, lambda x: x.rlike(label)), F.lit(True)).cast("int")
    return let(let(at, lambda i: F.when(i > 0, F.slice(lines, i, 3)).otherwise(F.array().cast("array<string>"))), latest)


def repaired_compact(c: Column) -> Column:
    """``35-2094``: a numeric date whose first hyphen was lost, month and day of one digit or two."""
    p = r"^([0-9])([0-9]{1,2})-([0-9]{2})([0-9]{2})$"
    return F.when(c.rlike(p), F.concat_ws("-", F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 3), F.regexp_extract(c, p, 4))).otherwise(c)


_NAMES = "january|february|march|april|may|june|july|august|september|october|november|december|" + "|".join(MONTHS)
_SPELLED, _SHORT = rf"(?i)^({_NAMES})\s+([0-9]{{1,2}}),\s+([0-9]{{4}})$", r"^([0-9]{1,2})(?:/([0-9]{1,2})/|-([0-9]{1,2})-)([0-9]{4}|[0-9]{2})$"


def any_form(c: Column) -> Column:
    """A text that is a date as a whole, in numbers or with its month spelled out or cut to three letters, as ISO; other texts
    trimmed, blanks null. Years of two digits from 69 on are in the 1900s."""

    def read(t: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(_found(t, _SPELLED, 1), 1, 3))).cast("int")
        day = F.coalesce(_found(t, _SHORT, 2), _found(t, _SHORT, 3)).cast("int")
        return F.coalesce(_iso(_found(t, _SPELLED, 3).cast("int"), month, _found(t, _SPELLED, 2).cast("int")), let(_found(t, _SHORT, 4), lambda y: _iso(full_year(y, 69), _found(t, _SHORT, 1).cast("int"), day)), t)

    return F.when(F.trim(c) != "", let(F.trim(c), read))
