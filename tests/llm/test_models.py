"""Toxicity and line quality: exact neighbours, held-out accuracy, odd rows."""

import numpy as np
import pytest
from cardloom.llm import quality_crf, toxicity
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(200)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(400):
        text = " ".join(rng.choice(WORDS, 40))
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            text += " " + " ".join(rng.choice(["vile", "rotten", "nasty"], 4))
        if not good:
            text += "\n" + "\n".join(" ".join(["###", "%%%", "$$$"] * 8) for _ in range(5))
        docs.append((i, text, "en", "a", len(text)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def accuracy(scored, labels, label):
    r = scored.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
    assert r[1] > 50
    return r[0]


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    assert accuracy(toxicity.toxicity(docs, labels), labels, "toxic") > 0.97
    assert accuracy(quality_crf.quality(docs, labels), labels, "quality") > 0.97


def test_labels_of_the_held_fold_are_not_used(spark, labelled):
    docs, labels = labelled
    wrong = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, wrong).collect()}


def test_block_max_gives_the_exact_neighbours():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(700):
        t = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        w = rng.random(len(t))
        rows.append((t, w / np.sqrt(w @ w)))
    labels = rng.integers(0, 2, 700)
    index = toxicity.BlockMaxIndex(rows, labels, np.arange(700), 60)
    dense = np.zeros((700, 60))
    for place, i in enumerate(index.order.tolist()):
        dense[place, rows[i][0]] = rows[i][1]
    assert index.labels.tolist() == labels[index.order].tolist()
    for leave in (None, 33):
        for t, w in rows[:80]:
            places, scores = index.nearest(t, w, 15, leave)
            every = dense[:, t] @ w
            every[[] if leave is None else [leave]] = 0
            want = sorted((-round(x, 12), p) for p, x in enumerate(every) if x > 0)[:15]
            assert np.allclose(scores, [-x for x, _ in want], atol=1e-6) and np.allclose(every[places], scores, atol=1e-6) and len(set(places.tolist())) == len(places)


def test_all_terms_of_the_examples_are_indexed(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    words = {t for r in docs.collect() for w in toxicity.words_of(r["text"]) for t in toxicity.names_of(w)}
    assert set(model.vectors.names.tolist()) == words and len(model.vectors.weight) == len(words)
    at = [x[0] for x in model.vectors.terms(["vile", "rotten", "nasty"])]
    assert (model.vectors.weight[at] > np.median(model.vectors.weight)).all()
    n, df = toxicity.document_counts(docs, model.vectors)
    assert n == 400 and df[at[0]] == sum("vile" in r["text"].split() for r in docs.collect())


def test_the_same_model_whatever_the_order_of_rows(spark, labelled):
    docs, labels = labelled
    # copies with other ids and clashing labels
    more = docs.unionByName(docs.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 1000))
    marks = labels.unionByName(labels.where("doc_id < 60").select((F.col("doc_id") + 1000).alias("doc_id"), (1 - F.col("quality")).cast("int").alias("quality"), (1 - F.col("toxic")).cast("int").alias("toxic")))
    for run in (toxicity.toxicity, quality_crf.quality):
        a, b = ({r["doc_id"]: r["score"] for r in run(d, m).collect()} for d, m in ((more, marks), (more.repartition(7).orderBy(F.desc("doc_id")), marks.orderBy(F.desc("doc_id")))))
        assert a == b


def test_marginals_of_many_documents_are_those_of_each():
    rng = np.random.default_rng(12)
    lengths = np.asarray([9, 5, 5, 2, 1, 1])
    odds, moves = rng.normal(size=int(lengths.sum())) * 3, rng.normal(size=(2, 2))
    got, pairs = quality_crf.marginals(odds, lengths, moves)
    each = [quality_crf.forward_backward(o, moves) for o in np.split(odds, np.cumsum(lengths)[:-1])]
    assert np.allclose(got, np.concatenate([e[0] for e in each])) and np.allclose(pairs, sum(e[1] for e in each))


def test_document_scores_are_those_of_the_plain_sum(spark, labelled):
    docs, labels = labelled
    field = quality_crf.fit(docs, labels.where(quality_crf.fold(F.col("doc_id"), 3) != 1))
    got = {r["doc_id"]: r["score"] for r in quality_crf.quality(docs, labels).collect()}
    for r in docs.limit(20).collect():
        x, n = quality_crf.features(r["text"])
        total, good = 0.0, np.zeros(len(n))
        for code in range(2 ** len(n)):  # all labellings of its lines
            y = [code >> i & 1 for i in range(len(n))]
            w = np.exp(sum(o for o, v in zip(x @ field.weights, y, strict=True) if v) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, good = total + w, good + w * np.asarray(y)
        mean = (good / total) @ n / n.sum()
        assert abs(got[r["doc_id"]] - quality_crf.calibrated(field.map_to, np.asarray([mean]))[0]) < 1e-6


def test_evidence_names_examples(labelled):
    docs, labels = labelled
    r = toxicity.toxicity(docs, labels, evidence=True).where("predicted = 1").first()
    ids = {x["doc_id"] for x in labels.where("toxic = 1").collect()}
    assert len(r["example_ids"]) == toxicity.NEIGHBOURS and set(r["example_ids"][:5]) <= ids and max(r["cosines"]) <= 1 + 1e-9


def test_forward_backward_sums_over_all_labellings():
    rng = np.random.default_rng(4)
    odds, moves = rng.normal(size=4), rng.normal(size=(2, 2))
    total, good, pairs = 0.0, np.zeros(4), np.zeros((2, 2))
    for code in range(16):
        y = [code >> i & 1 for i in range(4)]
        w = np.exp(sum(o for o, v in zip(odds, y, strict=True) if v) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        good += w * np.asarray(y)
        for a, b in zip(y, y[1:], strict=False):
            pairs[a, b] += w
    p, e = quality_crf.forward_backward(odds, moves)
    assert np.allclose(p, good / total) and np.allclose(e, pairs / total)


def test_odd_rows_and_no_rows(odd, no_docs, no_labels, labelled):
    docs, labels = labelled
    for run, label in ((toxicity.toxicity, "toxic"), (quality_crf.quality, "quality")):
        both = docs.unionByName(odd.select(docs.columns).where("doc_id is null or doc_id >= 0"))
        out = run(both, labels)
        assert out.count() == both.count()
        assert not out.where("score is null or isnan(score) or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count()
        assert run(no_docs, no_labels).count() == 0
        assert run(odd, no_labels).where("score <> 0").count() == 0
    assert toxicity.flagged(odd, toxicity.fit(docs, labels)).count() == odd.count()


def test_words_that_are_looked_up_later_have_the_same_terms(monkeypatch):
    """Terms by number, remembered or not, are those of the names one by one; counts are summed over words of the same beginning."""
    names = np.sort(np.asarray([n for w in ("alpha", "alphabet", "beta", "gamma") for n in set(toxicity.names_of(w))], np.int64))
    names = np.unique(names)
    text = "Alpha alphabet ALPHABETS bet beta gammas gamma delta alpha " * 3
    want = {}
    for w, n in toxicity.words_of(text).items():
        for name in toxicity.names_of(w):
            if name in names:
                at = int(np.searchsorted(names, name))
                want[at] = want.get(at, 0) + n
    for remembered in (0, 3, 10_000):
        monkeypatch.setattr(toxicity, "REMEMBERED", remembered)
        v = toxicity.Vectors(names, np.ones(len(names)))
        for _ in range(2):
            terms, times = v.counts(text)
            assert dict(zip(terms.tolist(), times.tolist(), strict=True)) == want and terms.tolist() == sorted(want)
        assert len(v.counts(None)[0]) == 0 and len(v.counts("zz")[0]) == 0


@pytest.mark.parametrize("piece", [1, 40, 1 << 16])
def test_postings_in_pieces_give_the_exact_neighbours(monkeypatch, piece):
    """Work space holds PIECE postings and a list at most, however many a text has; bounds of long lists lose no neighbour."""
    monkeypatch.setattr(toxicity, "PIECE", piece)
    monkeypatch.setattr(toxicity, "HEAD", 2)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):  # terms that lie together, terms everywhere
        t = np.unique(np.r_[i // 50, 40 + rng.choice(40, 4, p=np.arange(1, 41) / 820)])
        w = rng.random(len(t)) * np.where(t < 40, 3, 0.5)
        rows.append((t, w / np.sqrt(w @ w)))
    index = toxicity.BlockMaxIndex(rows, rng.integers(0, 2, 1500), np.arange(1500), 80)
    dense = np.zeros((1500, 80))
    for place, i in enumerate(index.order.tolist()):
        dense[place, rows[i][0]] = np.round(rows[i][1] * 2.0**24) / 2.0**24
    assert len(index.maxima)
    for leave in (None, 700):
        for t, w in rows[::50]:
            w = np.round(w * 2.0**24) / 2.0**24
            every = dense[:, t] @ w
            every[[] if leave is None else [leave]] = 0
            want = sorted((-x, p) for p, x in enumerate(every) if x > 0)[:15]
            places, scores = index.nearest(t, w, 15, leave)
            assert places.tolist() == [p for _, p in want] and np.allclose(scores, [-x for x, _ in want], atol=1e-12)
    room = index._own()[3].shape[1]
    assert room == piece + 1500
