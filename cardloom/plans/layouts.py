"""Named queries of pages of words with boxes: lines, names, fields by layout, and the choice of what a card is read from.

Pages are made of the documents: each document's own words, or forms of either template filled with values of the document, some of
them damaged as scans are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bind import let
from ..operators import extract, layout, words
from . import analogs as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"WITH words AS ({A.SQL['words']}) SELECT card_id, (row_number() OVER (PARTITION BY card_id ORDER BY y) - 1)::INT AS line_no, string_agg(text, ' ' ORDER BY x) AS text FROM words GROUP BY card_id, y")
def word_lines_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Words grouped to lines again."""
    return words.clustered_lines(A.words(spark, d))


#: Heads of pages: before the document's own lines stand none, a full name, a last name below the first names, a last name alone.
_HEAD = "CASE doc_id % 5 WHEN 0 THEN 'ESTATE' || chr(10) || {n} || ', James Lee (Mr.)' || chr(10) WHEN 1 THEN 'Mary Ann ' || (doc_id % 900 + 100) || ' Elm' || chr(10) || {n} || ',' || chr(10) WHEN 2 THEN 'Owner' || chr(10) || {n} || chr(10) ELSE '' END"
_LAST = "upper(coalesce(nullif(regexp_extract(text, '[A-Za-z]{3,12}', 0), ''), 'none'))"
_BAD = "regexp_matches(lower(t), '" + "|".join(layout.NO_NAME) + "')"
_UNTITLED = r"trim(regexp_replace(trim(replace(regexp_replace(regexp_replace({0}, '\(\s*(mr|mrs|ms|miss|dr)\.?,?\s*\)', '', 'gi'), '\s+', ' ', 'g'), ' ,', ',')), ',+$', ''))"
_CUT = r"regexp_replace(trim({0}), '\s+[0-9]{{2,5}}\b.*$', '')"


@query(rf"""WITH documents AS (SELECT doc_id, {_HEAD.format(n=_LAST)} || text AS text FROM documents), words AS ({A.SQL['words']}),
ls AS (SELECT card_id, y, string_agg(text, ' ' ORDER BY x) AS t, row_number() OVER (PARTITION BY card_id ORDER BY y) - 1 AS i, count(*) AS n FROM words GROUP BY card_id, y),
marked AS (SELECT *, NOT {_BAD} AND NOT regexp_matches(t, '\b[0-9]{{2,5}}\b') AS plain, {_BAD} AS bad, lag(t) OVER w AS up, lag(n) OVER w AS up_n FROM ls WINDOW w AS (PARTITION BY card_id ORDER BY i)),
ranked AS (SELECT *, CASE WHEN i < 6 AND plain AND regexp_matches(t, '^\s*[A-Z][A-Z''\-]{{2,}},\s*[A-Za-z].') THEN 1 WHEN i < 8 AND plain AND regexp_matches(t, '^\s*[A-Z][A-Z''\-]{{2,}}\s*,?\s*$') THEN 2 WHEN i = 0 THEN 3 END AS way FROM marked),
best AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY way, CASE WHEN way = 1 THEN instr(t, ',') END, i) AS r FROM ranked WHERE way IS NOT NULL),
told AS (SELECT *, CASE WHEN way = 2 AND i > 0 AND NOT regexp_matches(lower(up), '{"|".join(layout.NO_NAME)}') THEN nullif(array_to_string(list_filter(string_split_regex({_UNTITLED.format(_CUT.format('up'))}, '\s+'), lambda x: x <> '')[1:3], ' '), '') END AS given, regexp_extract(t, '^\s*([A-Z][A-Z''\-]{{2,}})', 1) AS own FROM best WHERE r = 1)
SELECT card_id, nullif(CASE way WHEN 1 THEN {_UNTITLED.format('t')} WHEN 2 THEN CASE WHEN given IS NULL THEN own || ',' ELSE {_UNTITLED.format("(own || ', ' || given)")} END ELSE {_UNTITLED.format(_CUT.format('t'))} END, '') AS name, (CASE WHEN given IS NULL THEN n ELSE n + up_n END)::INT AS n_boxes FROM told""")
def name_from_words(spark: SparkSession, d: str) -> DataFrame:
    """The owner's name of each page by the three strategies."""
    k, last = F.col("doc_id"), F.upper(F.coalesce(F.nullif(F.regexp_extract("text", "[A-Za-z]{3,12}", 0), F.lit("")), F.lit("none")))
    head = (
        F.when(k % 5 == 0, F.concat(F.lit("ESTATE\n"), last, F.lit(", James Lee (Mr.)\n"))).when(k % 5 == 1, F.concat(F.lit("Mary Ann "), k % 900 + 100, F.lit(" Elm\n"), last, F.lit(",\n")))
        .when(k % 5 == 2, F.concat(F.lit("Owner\n"), last, F.lit("\n"))).otherwise("")
    )
    pages = A.table(spark, d, "documents").select(k.alias("card_id"), A.page_words(F.concat(head, "text")).alias("words")).where(F.size("words") > 0)
    return pages.withColumn("n", layout.name_of_words(F.col("words"))).select("card_id", F.col("n.value").alias("name"), F.size("n.support").alias("n_boxes"))


def _day(n: int) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), ((F.col("doc_id") * n) % 17000).cast("int"))


def _placed(lines: list[Column]) -> Column:
    """Words of lines of a typewriter: ten pixels a letter, sixty a line."""

    def of(tokens: Column, y: int) -> Column:
        x = lambda i: (F.length(F.array_join(F.slice(tokens, 1, i), " ")) + (i > 0).cast("int")) * 10
        bbox = lambda w, i: let(x(i), lambda at: F.array(at, F.lit(60 * y), at + F.length(w) * 10, F.lit(60 * y + 14)))
        every = F.transform(tokens, lambda w, i: F.when(w != "", F.struct(w.alias("text"), F.lit(90).alias("confidence"), bbox(w, i).alias("bbox"))))
        return F.filter(every, lambda w: w.isNotNull())

    return F.flatten(F.array(*[let(F.split(line, " "), lambda t, y=y: of(t, y)) for y, line in enumerate(lines)]))


def forms(spark: SparkSession, d: str) -> DataFrame:
    """Of each document a page: a third each in the first template, in the second (damaged: dates on one line, labels misread), and with
    little on it."""
    k, word = F.col("doc_id"), F.coalesce(F.nullif(F.regexp_extract("text", "[A-Za-z]{3,12}", 0), F.lit("")), F.lit("none"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    last, sex, end = F.upper(word), F.when(k % 2 == 0, "M").otherwise("F"), F.lit(" " * 95 + "x")
    written = lambda n, pattern: F.date_format(_day(n), pattern)
    lot, grave, section, block, age = k % 900 + 1, k % 50 + 1, k % 30 + 1, k % 9 + 1, k % 90 + 10
    letter = F.chr(k % 26 + 65)
    first = [
        say(last, ", James      ", k % 9000 + 100, " Elm Street"), say("ESTATE      c/o Mrs. ", word), say("Phone       (404) 784-", k % 9000 + 1000), say("Date of Death   ", written(1, "MMMM d, yyyy")),
        say("Date of Burial  ", written(3, "MM-dd-yyyy")), say("DOB   ", written(7, "M/d/yyyy")), say("LOT# ", lot, "  Range ", letter, "  Grave# ", grave), say("Section ", section, "   Block ", block, " Northside"),
        say("Sex ", sex, "  Age ", age, "  Type of Grave ", word, " Vault   Grave Fee ", k % 900 + 100, ".00"), say("Undertaker   ", word), say("SVC No   ", k % 9000 + 1000), end,
    ]
    second = [
        say(last, " (Mrs.) Ann  ", k % 9000 + 100, " Elm Street"), F.lit("Contact Information"), F.concat(F.rpad(say("Date of Death Date of Burial  ", written(1, "MMMM d,yyyy")), 60, " "), written(3, "MMMM d, yyyy")),
        F.lit("Dacof Birth"), written(7, "MMMM d,yyyy"), say("Description: Lot #", lot, " Range ", letter, " Gave #", grave), say("Section #", section), say("Block ", block, " eastside"),
        say("Sex: ", sex, "  Age: ", age, "  Type of Grave: ", word, " Vault  Grave Fee: $", k % 900 + 100, ".00"), end,
    ]
    third = [F.concat(F.rpad(say("JOHN ", last), 40, " "), say("near ", word)), F.lit("Sex_M___  61"), say("Undertaker   ", word, " and Sons"), say("SVC   ", F.format_string("%d,%03d", k % 90 + 10, k % 1000)), end]
    page = F.when(k % 3 == 0, _placed(first)).when(k % 3 == 1, _placed(second)).otherwise(_placed(third))
    return A.table(spark, d, "documents").select(k.alias("card_id"), page.alias("words"))


_D = "DATE '1970-01-01' + ((doc_id * {0}) % 17000)::INT"
_ISO = "strftime({0}, '%Y-%m-%d')"
_SPELLED = "strftime({0}, '%B ') || day({0}) || strftime({0}, ', %Y')"
_W = "coalesce(nullif(regexp_extract(text, '[A-Za-z]{3,12}', 0), ''), 'none')"


def _by_form(a: str, b: str, c: str = "NULL") -> str:
    return f"CASE doc_id % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"


_ADDRESS, _SEX, _AGE = "(doc_id % 9000 + 100) || ' Elm Street'", "CASE WHEN doc_id % 2 = 0 THEN 'M' ELSE 'F' END", "(doc_id % 90 + 10)::VARCHAR"
_EXPECTED = {
    "owner_name": _by_form("upper(w) || ', James'", "upper(w) || ' (Mrs.) Ann'", "'JOHN ' || upper(w)"),
    "owner_address": _by_form(_ADDRESS, _ADDRESS, "'near ' || w"),
    "care_of": _by_form("'c/o Mrs. ' || w", "NULL"),
    "phone": _by_form("'(404) 784-' || (doc_id % 9000 + 1000)", "NULL"),
    "date_of_death": _by_form(_ISO.format(_D.format(1)), _SPELLED.format(f"({_D.format(1)})")),
    "date_of_burial": _by_form(_ISO.format(_D.format(3)), _ISO.format(_D.format(3))),
    "date_of_birth": _by_form(_ISO.format(_D.format(7)), _SPELLED.format(f"({_D.format(7)})")),
    "lot_no": _by_form("(doc_id % 900 + 1)::VARCHAR", "(doc_id % 900 + 1)::VARCHAR"),
    "range": _by_form("chr((doc_id % 26 + 65)::INT)", "chr((doc_id % 26 + 65)::INT)"),
    "grave_no": _by_form("(doc_id % 50 + 1)::VARCHAR", "(doc_id % 50 + 1)::VARCHAR"),
    "section_no": _by_form("(doc_id % 30 + 1)::VARCHAR", "(doc_id % 30 + 1)::VARCHAR"),
    "block_side": _by_form("'Block ' || (doc_id % 9 + 1) || ' Northside'", "'Block ' || (doc_id % 9 + 1) || ' Eastside eastside'"),
    "sex": _by_form(_SEX, _SEX, "'M'"),
    "age": _by_form(_AGE, _AGE),
    "type_of_grave": _by_form("w || ' Vault'", "': ' || w || ' Vault'"),
    "grave_fee": _by_form("(doc_id % 900 + 100) || '.00'", "(doc_id % 900 + 100)::VARCHAR"),
    "undertaker": _by_form("w", "NULL", "w"),
    "svc_no": _by_form("(doc_id % 9000 + 1000)::VARCHAR", "NULL", "(doc_id % 90 + 10) || ',' || lpad((doc_id % 1000)::VARCHAR, 3, '0')"),
}


@query(f"SELECT doc_id AS card_id, {', '.join(f'{v} AS {k}' for k, v in _EXPECTED.items())} FROM (SELECT doc_id, {_W} AS w FROM documents)")
def layout_fields(spark: SparkSession, d: str) -> DataFrame:
    """All fields of the forms, of which a third go through the chain for damaged pages."""
    out = layout.parsed(forms(spark, d))
    return out.select("card_id", *[F.col(f"fields.{f}.value").alias(f) for f in layout.FIELDS])


@query(f"SELECT doc_id AS card_id, CASE doc_id % 4 WHEN 0 THEN 'fields' WHEN 1 THEN 'text' WHEN 2 THEN 'words' ELSE 'nothing' END AS read_from, CASE doc_id % 4 WHEN 0 THEN 'GIVEN, Ann' WHEN 1 THEN upper(w) || ', Carl' WHEN 2 THEN {_EXPECTED['owner_name']} END AS deceased_name, CASE doc_id % 4 WHEN 0 THEN '2001-02-03' WHEN 1 THEN {_ISO.format(_D.format(1))} WHEN 2 THEN {_EXPECTED['date_of_death']} END AS date_of_death FROM (SELECT doc_id, {_W} AS w FROM documents)")
def card_source(spark: SparkSession, d: str) -> DataFrame:
    """Each card read from what it came with: fields of the answer, else words, else its text."""
    k, word = F.col("doc_id"), F.coalesce(F.nullif(F.regexp_extract("text", "[A-Za-z]{3,12}", 0), F.lit("")), F.lit("none"))
    docs = A.table(spark, d, "documents").select(k.alias("id"), F.when(k % 4 == 1, F.concat(F.upper(word), F.lit(", Carl\nDate of Death "), F.date_format(_day(1), "M/d/yyyy"))).alias("raw_text"), F.when(k % 4 == 0, F.create_map(F.lit("owner_name"), F.lit("GIVEN, Ann"), F.lit("date_of_death"), F.lit("2001-02-03"))).alias("answer"))
    pages = docs.join(forms(spark, d), F.col("id") == F.col("card_id")).withColumn("words", F.when(F.col("card_id") % 4 == 2, F.col("words")))
    return extract.of_cards(pages).select("card_id", "read_from", "deceased_name", "date_of_death")
