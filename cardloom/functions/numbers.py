"""Money, phones, identifiers and flags on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three, three and four digits; what stands between them may be missing (fixed value).
PHONE = r"\(?[0-9]{3}\)?\s*[-./]?\s*[0-9]{3}\s*[-./]?\s*[0-9]{4}"


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def rounded(c: Column, places: int) -> Column:
    """``c`` times a power of ten, rounded with halves away from zero, and divided again, all in doubles: halfway cases that only the
    decimal form has (0.6716665 times a million is 671666.4999...) fall as the product does."""
    scale = F.lit(10.0**places)
    return F.round(c * scale) / scale


def fixed(c: Column, places: int) -> Column:
    """A number with so many decimals as C, Python and SQL print it: of the exact binary value, halves to even. ``null`` for a null."""
    return F.coalesce(F.call_function("format_number", c, F.lit("0." + "0" * places)), F.lit("null"))


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def pages(total: Column, size: int, least: int = 1) -> Column:
    """Pages that ``total`` rows fill; listings show one page even if empty, logs none."""
    return F.greatest(F.ceil(total / F.lit(size)), F.lit(least)).cast("long")


def money(c: Column) -> Column:
    """``675.00`` from ``$675.00``, ``675 . 00`` or ``675-00``, else ``675`` from ``$675``; amounts have two to four digits before
    the cents, and letters O are zeros."""
    clean, cents = F.translate(c, "Oo", "00"), r"\$?\s*([0-9]{2,4})\s*[.-]\s*([0-9]{2})\b"
    return F.coalesce(F.concat(_found(clean, cents, 1), F.lit("."), _found(clean, cents, 2)), _found(clean, r"\$\s*([0-9]{2,4})\b", 1))


def phone(c: Column) -> Column:
    return _found(c, PHONE)


def optional_flag(c: Column) -> Column:
    """Three-valued flag of a CSV cell; a cell that says neither is an error."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t == "", F.lit(None).cast("boolean")).when(t.isin("1", "true", "t", "yes", "y"), True).when(t.isin("0", "false", "f", "no", "n"), False).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), t)).cast("boolean"))


def service_digits(c: Column) -> Column:
    """Digits of a service number, with the letters that stand for them."""
    return F.translate(c, "OoGIl", "00811")


def service_number(c: Column) -> Column:
    return _found(service_digits(_found(c, r"(?i)\bs\.?v\.?c\.?\s*(?:no\.?|#)?\s*[:.]?\s*([0-9OoGIl][0-9OoGIl,]*)", 1)), r"^[0-9][0-9,]*$")


def location(c: Column) -> Column:
    """struct<section, lot, block, range, grave> of a location line."""
    part = lambda word: F.upper(_found(F.regexp_replace(c, "@", "2"), rf"(?i)\b{word}\.?\s*(?:no\.?|#)?\s*:?\s*([A-Za-z]?[0-9]+[A-Za-z]?|[A-Z])\b", 1))
    return F.struct(*[part(w).alias(w) for w in ("section", "lot", "block", "range", "grave")])


def sex(c: Column) -> Column:
    x = F.lower(_found(c, r"(?i)\bsex\s*[:.]?\s*(male|female|m|f)\b", 1))
    return F.upper(F.substring(x, 1, 1))


def age(c: Column) -> Column:
    """Years; ``6)`` is 61, a bracket that was a one."""
    return F.regexp_replace(_found(c, r"(?i)\bage\s*[:.]?\s*([0-9]{1,2}\)|[0-9]{1,3})", 1), r"\)", "1")


def size_text(bytes_: Column) -> Column:
    """A file size for people."""
    mb = bytes_ / F.lit(1048576.0)
    return F.when(mb >= 1024, F.concat(F.format_string("%.1f", mb / 1024), F.lit(" GB"))).otherwise(F.concat(F.format_string("%.1f", mb), F.lit(" MB")))


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.concat((F.floor(s / 60)).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def four_cc(code: Column) -> Column:
    """The four letters of a codec number, empty if it isn't positive."""
    part = lambda n: F.chr(F.shiftright(code, n).bitwiseAND(255))
    return F.when(code > 0, F.concat(*[part(n) for n in (0, 8, 16, 24)])).otherwise(F.lit(""))


def resolution(w: Column, h: Column) -> Column:
    return F.when((w > 0) & (h > 0), F.concat_ws("x", w.cast("string"), h.cast("string")))
