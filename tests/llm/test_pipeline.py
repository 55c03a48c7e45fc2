"""The pipeline's rows on a small corpus, stage by stage, against brute force on each stage's own input; and its stages on odd rows."""

import re
import subprocess
import sys
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from cardloom.llm import mixing, toxicity
from cardloom.llm.queries import tokenizer_file
from cardloom.llm.shared import cut, fold
from cardloom.llm.tokenizer import Encoder
from pyspark.sql import functions as F
from test_corpus import groups, plain_targets
from test_personal_data import plain_discovered
from test_texts import PLAIN, plain_spans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name: (input, output), each written and read again."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        got = cut(stage(spark, docs, DATA), f"test-{name}")
        out[name] = (docs, got)
        docs = got
    return out


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"], r["text"] or ""))


def test_toxic_documents_go(spark, stages):
    docs, out = stages["toxicity"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).collect()}
    assert rows_of(out) == [r for r in rows_of(docs) if scored[r["doc_id"]] < 0.5] and out.count() < docs.count()


def test_one_of_each_group_of_all_pairs_stays(stages):
    docs, out = stages["near_dedup"]
    group = groups([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert rows_of(out) == [r for r in rows_of(docs) if group[r["doc_id"]][1] == r["doc_id"]] and out.count() < docs.count()


def test_personal_data_is_blanked(stages):
    docs, out = stages["pii"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    more, changed = plain_discovered([t or "" for t in texts.values()]), 0
    for r in out.collect():
        text = texts[r["doc_id"]]
        parts, at = [], 0
        for start, kind, end in sorted([*plain_spans(text or ""), *more.get(text, [])]):
            if start >= at:
                parts += [text[at:start], f"[{PLAIN[kind][0].upper()}]"]
            at = max(at, end)
        want = text and "".join(parts) + text[at:]
        assert r["text"] == want and r["n_chars"] == len(want or "")
        changed += want != text
    assert changed and out.count() == docs.count()


def test_the_mix_takes_what_a_walk_takes(stages):
    docs, out = stages["mixing"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    keyed = sorted(docs.withColumn("key", mixing.shuffle_key()).collect(), key=lambda r: (r["key"], r["doc_id"]))
    sizes = Counter()
    for r in keyed:
        sizes[r["source"]] += size(r["text"])
    want, start, got = plain_targets(sizes), Counter(), Counter(r["doc_id"] for r in out.collect())
    for r in keyed:
        n, s = size(r["text"]), r["source"]
        if n:
            passes, rest = divmod(round(want[s]), sizes[s])
            taken = passes * n + max(0, min(n, rest - start[s]))
            assert abs(got[r["doc_id"]] - taken / n) <= 0.5 + 1 / n
            start[s] += n
    assert set(got) <= {r["doc_id"] for r in keyed} and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}


def test_packed_pieces_are_the_documents_ids(stages):
    docs, out = stages["packing"]
    ids = Encoder(tokenizer_file("byte_bpe_50k.json")).ids
    want, total = Counter(), 0
    for r in docs.collect():
        got = np.append(ids(r["text"] or ""), 2).astype("<u4")
        total += len(got)
        first = len(got) % 1024 or min(len(got), 1024)
        for k, (a, b) in enumerate([(0, first), *((x, x + 1024) for x in range(first, len(got), 1024))]):
            want[r["doc_id"], k, a, b - a, zlib.crc32(got[a:b].tobytes())] += 1
    rows, ends = out.collect(), {}
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    rooms: list[int] = []  # of sequences by first fit, longest first
    for n in sorted((r["length"] for r in rows), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), len(rooms))
        rooms[at:at] = [1024] if at == len(rooms) else []
        rooms[at] -= n
    assert sum(ends.values()) == total and max(ends.values()) <= 1024 and len(ends) <= len(rooms) + 1


def test_stages_of_odd_rows_and_of_none(spark, odd, no_docs):
    rows = odd.drop("path", "key", "rep")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, rows, DATA)
        assert stage(spark, no_docs, DATA).count() == 0
        if name == "packing":
            assert got.where("doc_id is null").count() > 0 and got.agg(F.max("length")).first()[0] <= 1024
        elif name in ("mixing", "near_dedup"):
            assert got.columns == rows.columns and got.count()
        else:
            assert got.columns == rows.columns and got.count() == rows.count()


def test_what_is_left_of_toxic_documents_keeps_no_model_in_the_driver(spark):
    out = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert out.count() and "MapInArrow" not in out._jdf.queryExecution().toString()


def test_freed_memory_goes_back_to_the_system():
    code = """
from pathlib import Path
from cardloom.llm.shared import give_back
held = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096 >> 20
kept = [b"x" * 100_000 for _ in range(2000)]
kept = kept[-1]
before = held()
give_back()
assert before - held() > 100, (before, held())
"""
    subprocess.run([sys.executable, "-c", code], check=True)
