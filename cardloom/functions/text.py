"""String functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

#: Titles that are no part of a name, and suffixes that stay (fixed values).
TITLES = ("mr", "mrs", "ms", "miss", "dr", "rev")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
#: Labels whose presence shows that a text is a card's, as words with any white space between them (fixed values).
LABELS = ("date of death", "date of burial", "undertaker", "svc no", "type of grave", "description", "sex", "age", "lot", "section", "block")
#: Parts that make a value look like a label (fixed values).
LABELLIKE = ("date of", "description", "undertaker", "grave fee", "type of grave", "relation", "owner")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal_name(c: Column) -> Column:
    """For comparison: collapsed, lower case, null as the empty text."""
    return F.lower(collapsed(F.coalesce(c, F.lit(""))))


def token(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def name_token(c: Column) -> Column:
    """A part of a name without dots and without what isn't a letter at its ends."""
    return F.regexp_replace(F.regexp_replace(c, r"\.", ""), r"^[^A-Za-z]+|[^A-Za-z]+$", "")


def without_parentheses(c: Column) -> Column:
    return collapsed(F.regexp_replace(c, r"\([^)]*\)", " "))


def _name_parts(c: Column) -> Column:
    clean = F.transform(F.split(collapsed(c), " "), lambda p: name_token(p))
    return F.filter(clean, lambda p: (p != "") & ~F.lower(p).isin(*TITLES))


def _arranged(n: Column) -> Column:
    """n: struct<head, given, suffix> of name parts."""
    head, given = n["head"], n["given"]
    last = F.when(F.size(head) > 0, F.array_join(head, " ")).otherwise(F.try_element_at(given, F.lit(-1)))
    first = F.when(F.size(head) > 0, given).otherwise(F.slice(given, 1, F.greatest(F.size(given) - 1, F.lit(0))))
    more = let(first, lambda f: F.when(F.size(f) > 0, F.concat(F.lit(", "), F.initcap(F.array_join(f, " ")))).otherwise(""))
    end = F.when(F.size(n["suffix"]) > 0, F.concat(F.lit(", "), F.initcap(n["suffix"][0]))).otherwise("")
    return F.concat(F.upper(last), more, end)


def standard_name(c: Column) -> Column:
    """``LAST, First Middle[, Suffix]``; titles go. The last name stands before a comma, or is the last part."""

    def split(plain: Column) -> Column:
        comma = F.instr(plain, ",") > 0
        head = _name_parts(F.when(comma, F.substring_index(plain, ",", 1)).otherwise(F.lit("")))
        tail = _name_parts(F.regexp_replace(F.when(comma, F.substr(plain, F.instr(plain, ",") + 1)).otherwise(plain), ",", " "))
        ends = lambda t, is_: F.filter(t, lambda p: F.lower(p).isin(*SUFFIXES) == is_)
        return let(tail, lambda t: F.struct(head.alias("head"), ends(t, False).alias("given"), ends(t, True).alias("suffix")))

    return let(let(without_parentheses(c), split), _arranged)


def slug(c: Column, most: int) -> Column:
    """For file names: upper case, other characters as single underscores, ``UNKNOWN`` if nothing is left."""
    plain = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", "_")
    return F.substring(F.coalesce(F.nullif(F.regexp_replace(plain, "^_+|_+$", ""), F.lit("")), F.lit("UNKNOWN")), 1, most)


def numbered(c: Column, least: int) -> Column:
    """A whole number as text, with zeros before it up to ``least`` digits; longer numbers stay whole."""
    digits = c.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(least)), F.lit("0"))


def export_name(name: Column, died: Column, sequence: Column, ending: Column) -> Column:
    return F.concat(slug(name, 80), F.lit("_"), slug(died, 20), F.lit("__card_"), numbered(sequence, 3), ending)


def base_name(path: Column) -> Column:
    """What follows the last slash of either kind; ``upload`` if that is empty."""
    return F.coalesce(F.nullif(F.element_at(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "/"), -1), F.lit("")), F.lit("upload"))


def normal_path(path: Column, home: str = "") -> Column:
    """A path without ``.``, doubled slashes and steps back, of which none leads above the root; a leading ``~`` is ``home``."""
    whole = F.when(path.rlike("^~(/|$)"), F.concat(F.lit(home), F.substr(path, F.lit(2)))).otherwise(path)

    def step(done: Column, part: Column) -> Column:
        up = F.when((F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(F.startswith(whole, F.lit("/")), done).otherwise(F.array_append(done, part))
        return F.when(part.isin("", "."), done).when(part == "..", F.when(F.size(done) == 0, F.when(F.startswith(whole, F.lit("/")), done).otherwise(F.array_append(done, part))).otherwise(up)).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(F.startswith(whole, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def media_type(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end == "png", "image/png").when(end == "webp", "image/webp").when(end.isin("tif", "tiff"), "image/tiff").otherwise("image/jpeg")


def label_hits(c: Column) -> Column:
    """How many of the printed labels a text holds."""
    hits = [c.rlike("(?iU)\\b" + x.replace(" ", "\\s+") + "\\b").cast("int") for x in LABELS]
    return sum(hits[1:], hits[0])


def is_label_like(c: Column) -> Column:
    """Whether a value holds a part of a label."""
    return F.lower(c).rlike("|".join(LABELLIKE))


def is_label_line(c: Column) -> Column:
    return F.lower(c).rlike(r"^\s*(owner|address|relation|phone|date of|description|sex|age|undertaker|svc|board of|type of|grave)\b")


def lines(c: Column) -> Column:
    """The collapsed lines of a text that aren't blank."""
    return F.filter(F.transform(F.split(c, "\n"), collapsed), lambda x: x != "")


def without_fences(c: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def outer_json(c: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(without_fences(c), r"(?s)\{.*\}", 0), F.lit(""))


def header_split(c: Column) -> Column:
    """struct<name, address> of a header line, cut at its first number; a split ZIP code is joined."""
    name = F.trim(F.regexp_extract(c, r"^([^0-9]*)", 1))
    rest = F.regexp_replace(F.trim(F.regexp_extract(c, r"^[^0-9]*(.*)$", 1)), r"\b([0-9]{3}) ([0-9]{2})\b", "$1$2")
    return F.struct(F.nullif(name, F.lit("")).alias("name"), F.nullif(rest, F.lit("")).alias("address"))


def city_state(c: Column) -> Column:
    """struct<city, state> of ``City, ST`` with or without a ZIP code behind."""
    p = r"^\s*([A-Za-z .'-]+?),?\s+([A-Z]{2})\.?\s*([0-9]{5})?\s*$"
    return F.struct(F.nullif(F.regexp_extract(c, p, 1), F.lit("")).alias("city"), F.nullif(F.regexp_extract(c, p, 2), F.lit("")).alias("state"))


def without_address(c: Column) -> Column:
    """A name line without the address that follows it."""
    street = r"\s+[0-9]{1,5}\s+.*\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|place|pl|court|ct|boulevard|blvd|way|terrace)\b.*$"
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"(?i){street}", ""), r"\s+[0-9]{5}(-[0-9]{4})?\s*$", ""))


def image_url(path: Column, root: str) -> Column:
    """The address under which a file below ``root`` is served; null for files elsewhere and for paths that climb."""
    below = F.substr(path, F.lit(len(root.rstrip("/")) + 2))
    return F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")) & ~path.rlike(r"(^|/)\.\.(/|$)"), F.concat(F.lit("/static/frames/"), below))
