"""Cross-tokenizer alignment against byte offsets taken of each tokenizer's own library."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers
from cardloom.llm import alignment
from cardloom.llm.queries import tokenizer_file
from cardloom.llm.tokenizer import _byte_alphabet
from pyspark.sql import functions as F

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = ["", None, "a", " ", "  two  spaces ", "\n\n\tx\r\n", "<|endoftext|> and <s> </s> <0x41>", "é😀 naïve ﬁ ½ Ａ", "　wide space​", "▁ under", "x" * 3000, "ab " * 4000, "क्षत्रिय 漢字かな交じり文", "\x00\x01\x7f"]


def plain(texts):
    """Rows by bytes' offsets: all pairs whose ranges overlap, cuts where ends agree."""
    a_lib, b_lib, letters = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), _byte_alphabet()
    a_lib.encode_special_tokens = True
    pieces = []
    for t in texts:
        if not t:
            pieces.append(None)
            continue
        a = a_lib.encode(" " + t, add_special_tokens=False)
        a_bytes = [bytes(letters[c] for c in x) for x in a.tokens]
        ids = b_lib.encode(t)
        b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, b_lib.id_to_piece(ids), strict=True)]
        same = b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode()
        pieces.append((a.ids, np.cumsum([0, *map(len, a_bytes)]), ids, np.cumsum([0, *map(len, b_bytes)])) if same else None)
    links, counts = [], Counter()
    for p in pieces:
        own = []
        if p:
            a, x, b, y = p
            own = [(a[i], b[j]) for i in range(len(a)) for j in range(max(0, np.searchsorted(y, x[i], "right") - 1), len(b)) if y[j] < x[i + 1] and x[i] < y[j + 1]] if len(a) < 2000 else list(_swept(p))
        links.append(own)
        counts.update(set(own))
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    out = []
    for p, own in zip(pieces, links, strict=True):
        if not p:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, x, b, y = p
        cuts = sorted(set(x[1:].tolist()) & set(y[1:].tolist()))
        parts, start = [], 0
        for c in cuts:
            parts.append(",".join(str(i) for i, e in zip(a, x[1:], strict=True) if start < e <= c) + "|" + ",".join(str(i) for i, e in zip(b, y[1:], strict=True) if start < e <= c) if len(a) < 2000 else None)
            start = c
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if len(a) < 2000 else None
        out.append((len(a), len(b), len(cuts), len(own), sum(counts[w] == top[w[0]] for w in own), sum(counts[w] for w in own), digest))
    return out


def _swept(p):
    a, x, b, y = p
    i = j = 0
    while i < len(a) and j < len(b):
        yield a[i], b[j]
        i, j = i + (x[i + 1] <= y[j + 1]), j + (y[j + 1] <= x[i + 1])


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60)
    return [*ODD, *(r[0] for r in docs.collect()), "ab ab", "ab ab"]


@pytest.mark.parametrize("together", [3, 2000])
def test_rows_are_those_of_byte_offsets(spark, texts, together, monkeypatch):
    monkeypatch.setattr(alignment, "TOGETHER", together)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("block", F.lit(1)).withColumn("pair", F.lit(2)).withColumn("at", F.lit("x"))
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in alignment.align(df, A, B).collect()}
    for k, want in enumerate(plain(texts)):
        assert got[k] == want if want[-1] is not None else got[k][:-1] == want[:-1], texts[k]
    assert sum(w[0] > 0 for w in got.values()) > 60


def test_transducer_follows_the_side_that_leads():
    machine = alignment.Transducer([b"ab", b"c", b"abc", b"d", b"x", b""], [b"a", b"bcd", b"c", b"abcd", b"b"])
    code = lambda *pairs: [i << alignment.BITS | j for i, j in pairs]
    assert machine.align([0, 1], [0, 4, 2]) == (["0|0,4", "1|2"], code((0, 0), (0, 4), (1, 2)))
    assert machine.align([2, 3], [0, 1]) == (["2,3|0,1"], code((2, 0), (2, 1), (3, 1)))
    assert machine.align([0, 1, 3], [3]) == (["0,1,3|3"], code((0, 3), (1, 3), (3, 3)))
    assert machine.align([], []) == ([], [])
    for a, b in (([4], [0]), ([0], [0]), ([0], []), ([], [0]), ([5], [0]), ([0, 4], [0, 4])):
        assert machine.align(a, b) is None


def test_vocabulary_links(spark, texts):
    df = spark.createDataFrame([(1, "ab ab"), (2, "ab"), (3, None)], "doc_id long, text string")
    rows = alignment.vocabulary_links(alignment.blocks(df, A, B)).collect()
    assert rows and all(r["n"] <= 2 for r in rows) and max(r["n"] for r in rows) == 2 and any(r["best"] for r in rows)


def test_odd_rows_and_no_rows(odd, no_docs):
    got = alignment.align(odd, A, B)
    assert got.count() == odd.count() and got.where("doc_id is null and n_a > 0").count() == 1
    assert alignment.align(no_docs, A, B).count() == 0
