"""SQL for DuckDB of the corpus operators that SQL can express whole."""

from __future__ import annotations

from .quality_rules import BITS, LEAST, MEASURES, PRIOR, SLACK, SPREADS

_SPLIT = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT d, b FROM reach JOIN links ON c = a),
least AS (SELECT d, min(c) AS component_id FROM reach GROUP BY d)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least ON d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_SCALES = {"symbols": "n_symbols * 1000 / word_chars", "repeats": "n_repeat_words * 1000 / n_words", "lines": "n_dup_lines * 1000 / n_lines", "length": "word_chars * 10 / n_words"}


def _beyond() -> str:
    tests = []
    for k, below in MEASURES.items():
        tests.append(f"(l.measure = '{k}' AND l.value > q50 + {SPREADS} * greatest(q50 - q25, q50 // {LEAST}) + {SLACK[k]})")
        if below:
            tests.append(f"(l.measure = '{k}' AND l.value < q50 - {SPREADS} * greatest(q75 - q50, q50 // {LEAST}) - {SLACK[k]})")
    return " OR ".join(tests)


def _quantiles(source: str, by: str) -> str:
    reached = lambda q: f"min(CASE WHEN up * 100 >= total * {q} THEN value END) AS q{q}"
    return f"SELECT {by}measure, {', '.join(map(reached, (25, 50, 75)))} FROM (SELECT {by}measure, value, sum(n) OVER (PARTITION BY {by}measure ORDER BY value) AS up, sum(n) OVER (PARTITION BY {by}measure) AS total FROM {source}) GROUP BY ALL"


QUALITY_RULES = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_SPLIT.format("coalesce(text, '')")} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS win FROM w WHERE len(ws) > 7),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(8) t(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
raw AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, n_words, word_chars, n_lines, '{k}' AS measure, floor({v})::BIGINT AS v FROM m WHERE n_words > 0" for k, v in _SCALES.items())}),
long AS (SELECT *, (v >> greatest(length(bin(v)) - {BITS}, 0)::INT) << greatest(length(bin(v)) - {BITS}, 0)::INT AS value FROM raw),
sketch AS (SELECT lang, source, measure, value, count(*)::HUGEINT AS n FROM long GROUP BY ALL),
wide AS (SELECT *, sum(n) OVER (PARTITION BY lang, measure) AS total FROM (SELECT lang, measure, value, sum(n)::HUGEINT AS n FROM sketch GROUP BY ALL)),
mixed AS (SELECT lang, source, measure, value, sum(n) AS n FROM (
  SELECT s.lang, s.source, s.measure, s.value, n * total AS n FROM sketch s JOIN (SELECT DISTINCT lang, measure, total FROM wide) w ON s.lang IS NOT DISTINCT FROM w.lang AND s.measure = w.measure
  UNION ALL SELECT w.lang, g.source, w.measure, w.value, n * {PRIOR} FROM wide w JOIN (SELECT DISTINCT lang, source, measure FROM sketch) g ON g.lang IS NOT DISTINCT FROM w.lang AND g.measure = w.measure) GROUP BY ALL),
own AS ({_quantiles("mixed", "lang, source, ")}),
bad AS (SELECT DISTINCT doc_id FROM long l JOIN own f ON l.lang IS NOT DISTINCT FROM f.lang AND l.source IS NOT DISTINCT FROM f.source AND l.measure = f.measure WHERE {_beyond()})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""

# CRC-32 of the id's digits, bit by bit: a step is a character, or -1 for a shift
_CRC = "xor(list_reduce([4294967295] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"

PREFIX_TRIE = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place > h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, sha256(sha256(role) || text) AS digest, len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM parts),
paths AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS words FROM c UNION ALL SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth), words FROM turns),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY depth, path),
children AS (SELECT left(path, -64) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children k ON k.path = n.path),
sums AS (SELECT path, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT left(path, 64 * unnest(range(depth + 1))) AS path, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * words AS saved FROM own) GROUP BY path),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, path FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY path)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM own o JOIN sums s ON s.path = o.path LEFT JOIN nodes p ON o.depth > 0 AND p.path = left(o.path, -64) LEFT JOIN ends e ON e.path = o.path
"""
