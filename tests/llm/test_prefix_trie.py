"""The trie of conversations against a plain one, built of nested prefixes."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cardloom.llm import prefix_trie
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    members, length = defaultdict(list), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - c % 20, [])[:h] + own[c][h:]
        length[c] = len(seq)
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves = sum(sums[k][0] for k in children[p]) or 1
        sums[p] = (leaves, (len(members[p]) - 1) * words + sum(sums[k][1] for k in children[p]))
    return sorted(
        (m[0], len(p), -1 if not p else members[p[:-1]][0], len(m), len(children[p]), *sums[p], hashlib.sha256(",".join(str(c) for c in m if length[c] == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def rows_of(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(df.columns) == sorted(cols)
    return sorted(tuple(-1 if r[c] is None else r[c] for c in cols) for r in df.collect())


def made(seed, n):
    """Conversations of few different turns, so that prefixes are shared to all depths; gaps, copies, long ones, nulls and ties."""
    rng, rows = np.random.default_rng(seed), []
    for c in rng.permutation(np.arange(n) * int(rng.integers(1, 4)))[: n - n // 8].tolist():
        kind = rng.random()
        many = int(rng.integers(1, 8)) if kind < 0.9 else int(rng.integers(20, 60))
        said = ["same old turn"] * many if kind < 0.3 else [str(x) for x in rng.choice(["", "a b", "c  d\te", "f"], many)]
        rows += [(c, k if rng.random() < 0.97 else None if rng.random() < 0.5 else 1, "user" if k % 2 else None, t) for k, t in enumerate(said)]
    return rows


@pytest.mark.parametrize("stretch, chunk, halvings, seed", [(10, 12, 6, 1), (2, 1, 2, 2), (3, 2, 1, 3)])
def test_nodes_are_those_of_a_plain_trie(spark, monkeypatch, stretch, chunk, halvings, seed):
    for name, v in (("STRETCH", stretch), ("CHUNK", chunk), ("HALVINGS", halvings)):
        monkeypatch.setattr(prefix_trie, name, v)
    rows = [*made(seed, 70), (None, 1, "user", "of none"), (4000, 0, "user", "alone"), (4001, None, None, None)]
    df = spark.createDataFrame(rows, TURNS).repartition(3).withColumn("depth", F.lit(1)).withColumn("place", F.lit("x")).withColumn("at", F.lit(2.5))
    assert rows_of(prefix_trie.trie(df)) == plain(rows)


def test_chains_on_chains(spark):
    """Each conversation leaves the one before one turn later, so chains hang on chains; one has no turns left."""
    rows = [(20 * c, d, "user", "w " * (1 if d < c else d * 100 + c)) for c in range(9) for d in range(c + 2)]
    rows += [(1, 0, "user", "goes, as its opening is that of conversation 0")]
    assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS))) == plain(rows)


def test_no_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).count() == 0
