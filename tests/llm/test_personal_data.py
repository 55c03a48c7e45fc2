"""Discovered personal data against the method in plain Python; long texts."""

import re

import pytest
from cardloom.llm import pii
from pyspark.sql import functions as F
from test_texts import plain_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"
MARK = "^"


def tokens_and_runs(text):
    """(start, end, token, before, after) of words with a digit or at sign, and of runs of them one character apart."""
    near = lambda w: re.sub("[0-9]", "9", w.lower())
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(WORD, text)]
    out = []
    for k, (a, b, w) in enumerate(words):
        if re.search("[0-9@]", w):
            out.append((a, b, w, near(words[k - 1][2]) if k else MARK, near(words[k + 1][2]) if k + 1 < len(words) else MARK))
    held = []
    for t in [*out, None]:
        if held and (t is None or t[0] > held[-1][1] + 1):
            if len(held) > 1:
                out.append((held[0][0], held[-1][1], " ".join(h[2] for h in held), held[0][3], held[-1][4]))
            held = []
        if t:
            held.append(t)
    return out


def contexts(t):
    return ("before " + t[3], "after " + t[4], f"{t[3]} _ {t[4]}")


def looks(token):
    return sum(c in "0123456789" for c in token), float(bool(re.search(r"[^\W\d_]", token))), float("@" in token)


def plain_discovered(texts):
    """{text: [(start, kind, end)]}: seeds make patterns, patterns find instances, in rounds."""
    rows = []
    for text in sorted(set(texts)):
        base = plain_spans(text)
        for t in tokens_and_runs(text):
            inside = [b for b in base if b[0] < t[1] and b[2] > t[0]]
            kinds = {b[1] for b in inside}
            other = len(kinds) > 1 or any(b[0] < t[0] or b[2] > t[1] for b in inside)
            rows.append((text, t, min(kinds) if len(kinds) == 1 and not other else None, other))
    graph = {}
    for _, t, seed, other in rows:
        if not other:
            for c in contexts(t):
                old = graph.setdefault(c, {}).get(t[2])
                graph[c][t[2]] = seed if old is None else old if seed is None else min(old, seed)
    shown = {}
    for got in graph.values():
        for token, seed in got.items():
            if seed is not None:
                shown.setdefault(seed, set()).add(token)
    shape = {}
    for kind, tokens in shown.items():
        ls = [looks(x) for x in tokens]
        shape[kind] = (min(x[0] for x in ls), max(x[0] for x in ls), sum(x[1] for x in ls) / len(ls), sum(x[2] for x in ls) / len(ls))

    def likeness(token, kind):
        digits, letters, at = looks(token)
        low, high, p_letters, p_at = shape[kind]
        out = (3 + min(1.0, (digits + 1) / (low + 1), (high + 1) / (digits + 1))) / 4
        for has, p in ((letters, p_letters), (at, p_at)):
            out *= (1 + min(1.0, (p if has else 1 - p) / max(p, 1 - p))) / 2
        return out

    reached = {}
    for _ in range(pii.ROUNDS):
        patterns = {}
        for c, got in graph.items():
            counts = {}
            for token, seed in got.items():
                for kind in {seed} if seed is not None else reached.get(token, {}):
                    counts[kind] = counts.get(kind, 0) + 1
            for kind, n in counts.items():
                if n >= pii.SEEDS and n / len(got) >= pii.SURE:
                    patterns[c, kind] = n / len(got)
        level = {}
        for (c, kind), confidence in patterns.items():
            for token, seed in graph[c].items():
                if seed is None:
                    level[token, kind] = max(level.get((token, kind), 0), confidence * likeness(token, kind))
        reached = {}
        for (token, kind), x in level.items():
            if x >= pii.SURE:
                reached.setdefault(token, {})[kind] = x
    out = {}
    for text, t, seed, other in rows:
        if seed is None and not other and t[2] in reached:
            kind = max((x, k) for k, x in reached[t[2]].items())[1]
            out.setdefault(text, []).append((t[0], kind, t[1]))
    return {k: sorted(s for s in v if not any(o[0] <= s[0] and o[2] >= s[2] and o != s for o in v)) for k, v in out.items()}


def made_up():
    seeds = [f"Phone: +1555{n:07d} office" for n in range(400)]
    others = [f"Phone: 555-123-45{n} office" for n in range(10, 40)]
    led = [f"fon= 555-123-45{n} here and mail a{n}@b.co or 10.0.0.{n} end" for n in range(10, 40)] + ["fon= 555_123_4599 here", "fon= 12 13 14 here"]
    apart = [f"call{' ' * 200}+4930{n:07d}{chr(10) * 90}now" for n in range(20)] + ["call +49 30 1234567x now", f"call{' ' * 120}0049301234567 now", f"{'x' * 300} 4930123 {'y' * 300}"]
    return [*seeds, *others, *led, *apart, "Room 2019 is shut", "", "+1 (826) 555-4081 190.137.2.9 Phone: 1 office"]


@pytest.mark.parametrize("few", [64, 0])
def test_discovered_spans_are_those_of_the_plain_method(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "FEW", few)
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [*made_up(), *real]
    want = plain_discovered([t or "" for t in texts])
    assert sum(map(len, want.values())) > 50
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    for r in pii.personal_data(df).select("doc_id", "base", "spans").collect():
        text = texts[r["doc_id"]] or ""
        assert [tuple(s) for s in r["base"]] == plain_spans(text)
        assert sorted(tuple(s) for s in r["spans"]) == sorted([*plain_spans(text), *want.get(text, [])]), text


def test_a_hundred_thousand_tokens_in_one_text(spark):
    n = 100_000
    text = "".join(f"10.0.{i % 250}.{i % 200} é{i} x\n" for i in range(n))
    df = spark.createDataFrame([(1, text, "en", "a", 0)], DOCS)
    r = pii.counted(pii.personal_data(df)).first()
    assert r["n_ip"] == n and r["spans"].count("ip:") == n
    assert pii.blanked(df).first()["text"] == "".join(f"[IP] é{i} x\n" for i in range(n))


def test_running_totals(spark):
    for values in ([], [3], [3, 0, 5, 1, 1, 1, 7]):
        df = spark.createDataFrame([(values,)], "v array<int>")
        sums, tops = df.select(pii.scanned(F.col("v")), pii.scanned(F.col("v"), F.greatest)).first()
        assert sums == [sum(values[: i + 1]) for i in range(len(values))] and tops == [max(values[: i + 1]) for i in range(len(values))]


def test_redaction_of_spans_that_overlap(spark):
    text = "ab😀" * 1500
    spans = [(0, 0, 5), (3, 1, 4), (4, 2, 1030), (1030, 3, 1031), (2047, 0, 2050), (4000, 1, 4400)]
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:int,kind:int,end:int>>")
    got = df.select(pii.redacted(F.col("text"), F.col("spans"))).first()[0]
    assert got == "[EMAIL]" + "[PHONE]" + text[1031:2047] + "[EMAIL]" + text[2050:4000] + "[IP]" + text[4400:]


def test_columns_with_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "a@b.co", "x", "y", "z")], "doc_id long, text string, base string, `row` string, spans string")
    assert tuple(pii.blanked(df).first()) == (1, "[EMAIL]", "x", "y", "z")
