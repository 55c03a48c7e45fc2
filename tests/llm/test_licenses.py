"""The licence scan against a plain reading of its rules, without an index."""

import math
import re

import pytest
from cardloom.llm import licenses
from cardloom.llm.licenses import DRIFT, LEAST, RARE, Template

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(texts):
    """Rows by trying every start of every template."""
    docs = [words(t) for t in texts]
    phrases = [(label, words(p)) for p, label in licenses.PHRASES.items()]
    notices = [(label, words(t), [words(k) for k in keys]) for label, t, keys in licenses.NOTICES]
    every = {w for _, p in phrases for w in p} | {w for _, t, _ in notices for w in t}
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) for w in every}
    rank = lambda w: (-idf[w], w.encode())
    out = []
    for d in docs:
        places = [(i, label) for label, p in phrases for i in range(len(d)) if d[i : i + len(p)] == p]
        labels, score = {x[1] for x in places}, 1.0 if places else 0.0
        for label, t, keys in notices:
            m, lead = len(t), min({w for k in keys for w in k}, key=rank)
            rare = sorted({w for w in t if w in d}, key=rank)[:RARE]
            about = lambda w, at: w in d[max(0, at - DRIFT) : max(0, at + DRIFT + 1)]  # noqa: B023, E731
            for s in range(-m, len(d)):
                if not (0 <= s + t.index(lead) < len(d) and d[s + t.index(lead)] == lead):
                    continue
                window = d[max(0, s - DRIFT) : s + m + DRIFT]
                if not all(any(window[i : i + len(k)] == k for i in range(len(window))) for k in keys):
                    continue
                if 2 * sum(any(about(w, s + q) for q in range(m) if t[q] == w) for w in rare) < len(rare):
                    continue
                cover = sum(about(w, s + q) for q, w in enumerate(t)) / m
                if cover >= LEAST:
                    labels.add(label)
                    score = max(score, cover)
        starts = [i for i, _ in places]
        out.append((len(d), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[1] for x in places})), ",".join(sorted(labels)), score))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    notices = [t for _, t, _ in licenses.NOTICES]
    made = [
        None, "", "CC BY", "cc, by; cc-by CC\nBY", "cc xby", "All  RIGHTS\treserved. all rights reserved", "some rights reserved", "É cc by Ünï", "licensed under cc by-nc 4.0 and by cc by-nc-sa",
        "general public licence", "gnu general general public license version two", "version 3 of the license is general and public", "mit " * 2000 + "license", "a license by the mit " * 500,
        *notices, *(f"prose before it\n{t.upper()}\nprose after" for t in notices), *(" ".join(w for i, w in enumerate(t.split()) if i % 7 != 5) for t in notices),
        *(" ".join(x for i, w in enumerate(t.split()) for x in ([w, "odd"] if i % 6 == 3 else [w])) for t in notices), *(" ".join(reversed(t.split())) for t in notices), " ".join(notices),
    ]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(80)
    return [*made, *(r[0] for r in docs.collect())]


def test_rows_are_those_of_every_start(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:8] for r in licenses.scan(df).collect()}
    for k, want in enumerate(plain(texts)):
        assert got[k] == pytest.approx(want), texts[k]


def test_notices_are_found_and_prose_is_not(spark):
    named = [(k, f"Some words.\n{t}\nMore words.") for k, (_, t, _) in enumerate(licenses.NOTICES)]
    clean = [(100, "a general licence to print, by version 3 of the public work"), (101, "permission to use the software of the author, reserved"), (102, "the license of a source form")]
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(named + clean, "doc_id long, text string")).collect()}
    for k, (label, text, _) in enumerate(licenses.NOTICES):
        assert label in rows[k]["labels"].split(","), text
        assert any(m["label"] == label and m["start"] == 2 and m["coverage"] == 1 for m in rows[k]["matches"])
    assert all(rows[k]["labels"] == "" and rows[k]["score"] == 0 for k in (100, 101, 102))


def test_own_templates(spark):
    known = [Template.of("own", "house rules apply"), Template.of("long", "these are the rules of the house and they apply to all", ("rules of the house",))]
    df = spark.createDataFrame([(1, "House rules apply. House rules apply"), (2, "these are rules of the house and do apply to all"), (3, "rules of the house")], "doc_id long, text string")
    assert [(r["n_base"], r["labels"]) for r in licenses.scan(df, known).orderBy("doc_id").collect()] == [(2, "own"), (0, "long"), (0, "")]


def test_odd_rows_and_no_rows(odd, no_docs):
    got = licenses.scan(odd.withColumnRenamed("path", "matches"))
    assert got.count() == odd.count() and got.where("score <> 0").count() == 0
    assert licenses.scan(no_docs).count() == 0
