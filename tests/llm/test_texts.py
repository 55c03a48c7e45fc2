"""Personal data, quality rules, token counts: against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from cardloom.llm import packing, pii, quality_rules, token_counts
from cardloom.llm.queries import tokenizer_file
from cardloom.llm.shared import table_path
from cardloom.llm.tokenizer import Encoder
from pyspark.sql import functions as F

PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(s):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c+d@e.f x@y a.b@c.d.e. @q.r", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 256.1.1.1 0001.02.3.4", "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 5 5 5",
    "+1 (017) 555-7713 +12 +1(((((( 5555555555 ++49 30 1234567", "é😀 é@x.de mail: a_b%c@sub-domain.example.org, ip 10.0.0.255 end", "0" * 300 + "." + "a" * 3000 + "@", "", "+1 (826) 555-4081 190.137.2.9",
]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(TRICKY)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in pii.counted(pii.personal_data(df)).collect()}
    for i, t in enumerate(TRICKY):
        want = plain_spans(t)
        shown = ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k, _ in PLAIN] == [sum(x[1] == n for x in want) for n in range(4)]
        assert set(shown.split(",")) <= set(got[i]["spans"].split(","))


def test_contexts_reveal_what_patterns_miss(spark):
    good = [f"{n:016d}" for n in range(4000_0000_0000_0000, 4000_0000_0000_0200) if luhn(f"{n:016d}")][:12]
    known = [(i, f"words {i} before ticket: {c} words after", "en", "a", 0) for i, c in enumerate(good)]
    # right words around it, right shape, wrong check digit; and the same number in other company
    rows = [*known, (50, "words before ticket: 4999999999999999 words after", "en", "a", 0), (51, "a year like 4999999999999998 in a novel", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: ([tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in pii.personal_data(df).select("doc_id", "base", "spans").collect()}
    assert got[50] == ([], [(21, 2, 37)]) and got[51] == ([], [])
    assert all(got[i][0] == got[i][1] and len(got[i][0]) == 1 for i in range(12))


def test_contexts_reveal_other_shapes_and_lead_on(spark):
    seeds = [f"Phone: +1555{n:07d} office" for n in range(400)]
    # other shapes, one of several words, in the trusted context; these lead to a context without base matches
    others = ["(555) 123 4568", *(f"555-123-45{n}" for n in range(10, 40))]
    found = [f"Phone: {x} office" for x in others]
    led = [*(f"fon= {x} here" for x in others), "fon= 555_123_4599 here"]
    plain = ["Room 2019 is shut", "Phone: 12 office", "a novel of 5551230000 pages"]
    texts = [*seeds, *found, *led, *plain]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.personal_data(df).select("doc_id", "spans").collect()}
    for i, t in enumerate(texts):
        number = t.split(" ", 1)[1].rsplit(" ", 1)[0]
        at = t.index(number)
        assert got[i] == ([] if t in plain else [(at, 3, at + len(number))]), t


def test_redaction_keeps_what_is_not_personal(spark):
    df = spark.createDataFrame([(1, "😀 a@b.co or 10.0.0.1!", "en", "a", 0), (2, None, "en", "a", 0), (3, "clean", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in pii.blanked(df).collect()}
    assert got == {1: "😀 [EMAIL] or [IP]!", 2: None, 3: "clean"}
    assert pii.blanked(df).columns == df.columns


def test_personal_data_of_odd_rows(odd, no_docs):
    assert pii.counted(pii.personal_data(odd)).count() == odd.count()
    assert pii.blanked(odd).count() == odd.count()
    assert pii.counted(pii.personal_data(no_docs)).count() == 0


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_measure_what_plain_code_measures(spark, odd):
    texts = ["a b c d e f g h " * 3 + "x y", "p q\np q\n \n", "w " * 40, "one\x0btwo\x0cthree # | <", "a b c d e f g h i a b c d e f g h j", None]
    df = odd.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(100 + i, t, "en", "z") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    want = sorted((str(r["doc_id"]), *plain_rules(r["text"])) for r in df.collect())
    out = quality_rules.judged(df)
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out.collect()) == want
    assert not out.where("base_failed and kept").count()


def test_rules_adapt_to_a_source(spark):
    clean = [(i, "plain words of some length stand here " * 4 + str(i), "en", "prose", 0) for i in range(120)]
    tables = [(1000 + i, "cell | cell | other | words of some length " * 3 + f"a{i} b{i} c{i}", "en", "tables", 0) for i in range(120)]
    rows = [*clean, *tables, (5000, "cell | cell | other | words of some length " * 3 + "q r s", "en", "prose", 0)]
    df = spark.createDataFrame([(i, " ".join(f"{w}{k}" if w != "|" else w for k, w in enumerate(t.split())), la, s, n) for i, t, la, s, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(df).collect()}
    assert all(kept[i] for i, *_ in clean) and all(kept[i] for i, *_ in tables) and not kept[5000]


def texts_of(rate, n, first, source, words=60):
    return [(first + i, " ".join(f"word{i}x{k}" + "#" * (k < rate) for k in range(words)), "en", source, 0) for i in range(n)]


def judged(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"]: r["kept"] for r in quality_rules.judged(df).collect()}


def test_a_source_that_is_a_third_junk_loses_it(spark):
    rows = [*texts_of(0, 140, 0, "mixed"), *texts_of(55, 70, 1000, "mixed"), *texts_of(0, 1000, 2000, "clean"), *texts_of(20, 60, 9000, "tables")]
    kept = judged(spark, rows)
    assert not any(kept[i] for i in range(1000, 1070)) and all(v for i, v in kept.items() if not 1000 <= i < 1070)


@pytest.mark.parametrize("share", [5, 12, 20, 30, 45])
def test_junk_in_all_sources_at_once_goes(spark, share):
    n = 200
    rows = [r for k in range(4) for r in (*texts_of(0, n - n * share // 100, 1000 * k, f"s{k}"), *texts_of(30, n * share // 100, 1000 * k + 500, f"s{k}"))]
    kept = judged(spark, rows)
    junk = [v for i, v in kept.items() if i % 1000 >= 500]
    clean = [v for i, v in kept.items() if i % 1000 < 500]
    assert sum(junk) <= 0.05 * len(junk) and sum(clean) >= 0.98 * len(clean)


def test_fences_where_quartiles_coincide(spark):
    # all but a few texts have no symbol at all: one or two symbols are no reason to go, many are
    kept = judged(spark, [*texts_of(0, 200, 0, "a"), *texts_of(2, 2, 500, "a"), *texts_of(12, 3, 600, "a")])
    assert all(v for i, v in kept.items() if i < 600) and not any(kept[i] for i in (600, 601, 602))


def test_no_switch_at_a_size(spark):
    df = lambda n: quality_rules.measured(spark.createDataFrame([*texts_of(8, n, 0, "small"), *texts_of(0, 400, 5000, "large")], "doc_id long, text string, lang string, source string, n_chars long"))
    highs = []
    for n in (1, 80, 99, 100, 101, 200):
        texts = df(n)
        for k, v in quality_rules.scales().items():
            texts = texts.withColumn(k, v)
        highs.append(quality_rules.fences(quality_rules.sketches(texts)).where("source = 'small'").first()["symbols_high"])
    assert highs[2] == highs[3] == highs[4] == 14 and highs[0] == 0
    assert highs[5] == 13  # texts of longer words hold the quartile and the median then: symbols are a smaller share of them


def test_values_keep_ten_bits(spark):
    got = spark.range(5000).select("id", quality_rules.rounded(F.col("id")).alias("v")).collect()
    assert all(r["v"] <= r["id"] <= r["v"] * (1 + 1 / 512) for r in got) and all(r["v"] == r["id"] for r in got[:1024])


def test_rules_of_no_rows(no_docs):
    assert quality_rules.judged(no_docs).count() == 0


@pytest.fixture(scope="module")
def path():
    return tokenizer_file("byte_bpe_50k.json")


def test_ids_are_those_of_the_file_s_own_library(path):
    e = Encoder(path)
    rng = np.random.default_rng(3)
    letters = [*"ab'st  \n\r\t.,!0१é́‍😀", "'s", "'ll", "<|endoftext|>", " ", " ", "\x1c", "Ⅷ", "中", "\x00"]
    for _ in range(3000):
        t = "".join(rng.choice(letters, rng.integers(0, 14)))
        assert e.ids(t).tolist() == e._own.encode(t, add_special_tokens=False).ids


def test_other_tokenizer_files_work(path):
    assert len(Encoder(tokenizer_file("piece_bpe_32k.model")).ids("some words")) > 1
    other = Encoder(tokenizer_file("word_bpe_49k.json"))
    assert other._fast is None and len(other.ids("some words")) == 2


def test_counts_with_a_cache_that_stays(spark, odd, path):
    cache, e = table_path(spark, "cache"), Encoder(path)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(e.ids(r["text"] or "")), len(e.ids(r["text"] or "")) > 512) for r in odd.collect())
    rows = lambda: sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(odd, path, cache).collect())
    assert rows() == want
    stored = spark.read.parquet(cache).count()
    assert stored == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert rows() == want and spark.read.parquet(cache).count() == stored


def test_counts_of_no_rows(spark, no_docs, path):
    assert token_counts.count_tokens(no_docs, path, table_path(spark, "cache")).count() == 0


def test_packing_round_trip(spark, odd, path):
    e = Encoder(path)
    rows = packing.pack(odd, path, limit=64, end=2).collect()
    docs = {}
    for r in odd.collect():
        docs.setdefault(r["doc_id"], []).append(np.append(e.ids(r["text"] or ""), 2).astype("<u4"))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert any(zlib.crc32(d[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for d in docs[r["doc_id"]])
    for parts in by.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 64
    assert sum(r["length"] for r in rows) == sum(len(d) for ds in docs.values() for d in ds)
    for r in rows:
        assert r["length"] == 64 or r["piece"] == 0
    assert len(by) == -(-sum(r["length"] for r in rows) // 64)


def test_packing_of_no_rows(no_docs, path):
    assert packing.pack(no_docs, path).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, places, fills = packing.best_fit(np.asarray([5, 3, 6, 4, 2]), 10)
    assert len(fills) == 2 and fills.tolist() == [10, 10]
    assert packing.pieces_of(0, 10) == [(0, 0)] and packing.pieces_of(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.pieces_of(20, 10) == [(0, 10), (10, 10)]
