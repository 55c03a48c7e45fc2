"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The examples are a bounded sample of labelled texts. Their terms, all of them, are words and beginnings of words (stems carry
the mark in inflected languages). A term weighs 1 + log of its count, times its idf over all documents, times its relevance: from
0 to 1 and rising smoothly with the two-sample z of its share among the examples of either class, so that the
prose around the mark, most of the terms, doesn't drown it; no term is left out. Examples lie in posting lists of each term,
like ones together, in blocks whose largest weight is noted (a block-max index). A text reads the lists of its weightiest terms
and its short lists, whose blocks hold few postings; what the long ones can add in a block at most, by the noted maxima, tells
which examples may still be among its nearest, and these are scored exactly, so the neighbours are the exact ones. Their votes, weighted by similarity, become a probability by logistic calibration on the examples themselves, each voted
on without itself. Ids and cosines of the neighbours are the evidence.

Cases: texts of any length are read whole; null and empty texts, and texts without a term of an example, have no neighbours and get the calibrated score
of an empty vote; rows without label serve as no example; null ids never match a label; an id with clashing labels counts
as labelled 1, as does a text whose rows clash; equal texts are one example, named by the smallest id; repeated rows get equal
scores; without examples of both classes every score is the share of label 1 among the examples, or 0; an empty table
gives an empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .shared import cut, fold, give_back

#: Examples of each class, neighbours that vote, examples in a block.
EXAMPLES, NEIGHBOURS, BLOCK = 3000, 15, 64
#: Lengths of word beginnings that are terms, beside whole words (5 alone finds as many toxic texts as 4 to 7); z at which a term's relevance is one half.
STEMS, HALF_Z = (5,), 6.0
#: Words whose terms a task remembers; texts that are scored together.
REMEMBERED, TOGETHER = 200_000, 64
#: Postings a block from which on a list's blocks, if it has a quarter of all, are tried by their maxima before they are read; lists read whole in any case.
LONG, HEAD = 5, 32
#: Postings that are added up at once, which bounds a task's work space.
PIECE = 1 << 16

_WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> Counter:
    return Counter(_WORDS.findall((text or "").lower()))


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) >= n)]


def names_of(word: str) -> list[int]:
    """The word's terms by their 63-bit hashes, which is how they are known from here on."""
    return [xxhash.xxh3_64_intdigest(t) >> 1 for t in terms_of(word)]


class Vectors:
    """Texts as unit vectors over the terms of the examples: names, sorted, and the weight of each."""

    def __init__(self, names: np.ndarray, weight: np.ndarray):
        self.names, self.weight = names, weight.astype(np.float32)
        #: Words that were met by their number, and of each number the terms.
        self._known, self._terms = {}, np.full((1024, 1 + len(STEMS)), -1, np.int32)

    def terms(self, words: Collection[str]) -> np.ndarray:
        """A row for each word: as many columns as a word can have terms, -1 for what it lacks or no example has. The first
        REMEMBERED words that a task meets, the common ones, are looked up once."""
        known = self._known
        numbers = list(map(known.get, words))
        if None not in numbers:
            return self._terms[numbers] if numbers else self._terms[:0]
        fresh = [w for w, n in zip(words, numbers, strict=True) if n is None]
        found = self._found(fresh)
        if len(known) >= REMEMBERED:
            at = np.asarray([-1 if n is None else n for n in numbers])
            out = self._terms[at]
            out[at < 0] = found
            return out
        fresh, at = list(dict.fromkeys(fresh)), dict(zip(fresh, range(len(fresh)), strict=True))
        size = len(known)
        if size + len(fresh) > len(self._terms):
            self._terms = np.concatenate([self._terms, np.full((size + len(fresh), self._terms.shape[1]), -1, np.int32)])
        self._terms[size : size + len(fresh)] = found[[at[w] for w in fresh]]
        known.update(zip(fresh, range(size, size + len(fresh)), strict=True))
        return self._terms[list(map(known.__getitem__, words))]

    def _found(self, words: list[str]) -> np.ndarray:
        """The terms of words, by their names as in names_of, of all words at once."""
        digest, n = xxhash.xxh3_64_intdigest, len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        columns = [words, *([f"{w[:size]}-" for w in words] for size in STEMS)]
        names = np.stack([np.fromiter(map(digest, c), np.uint64, n) >> 1 for c in columns], axis=1).astype(np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where((self.names[at] == names) & (sizes[:, None] >= np.array([0, *STEMS])), at, -1)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms and how often it has each."""
        words = words_of(text)
        ids = self.terms(words)
        times = np.fromiter(words.values(), np.int64, len(words))
        # a term and its times in one number, which sorts faster than places do
        both = (ids.astype(np.int64) << 31 | times[:, None]).ravel()
        both = both[both >= 0]
        if not len(both):
            return both, both
        both.sort()
        ids = both >> 31
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return ids[first], np.add.reduceat(both & (1 << 31) - 1, first)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text; none if it has no term with a weight."""
        return self.weighted(*self.counts(text))

    def weighted(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(np.maximum(times, 1))) * self.weight[terms].astype(float)
        terms, weights = terms[weights > 0], weights[weights > 0]
        # multiples of 2^-24: products and sums of such are exact in double precision, whatever their order
        return terms, np.round(weights / np.sqrt(weights @ weights) * 2.0**24) / 2.0**24 if len(weights) else weights


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start to before its end, one after the other, and how many each start has."""
    n = (ends - starts).astype(np.int64)
    before = np.cumsum(n) - n
    return np.arange(n.sum()) + np.repeat(starts - before, n), n


class BlockMaxIndex:
    """Posting lists of all terms over examples, in blocks of BLOCK places, each with its largest weight."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, terms: int):
        lead = [(int(t[np.argmax(w)]), float(w.max())) for t, w in rows]
        #: Place of each row, and back.
        self.order = np.asarray(sorted(range(len(rows)), key=lambda i: (lead[i][0], -lead[i][1], int(ids[i]), i)), np.int64)
        self.labels, self.ids, self.blocks = labels[self.order].astype(float), ids[self.order], -(-max(1, len(rows)) // BLOCK)
        term = np.concatenate([rows[i][0] for i in self.order]).astype(np.int32)
        place = np.repeat(np.arange(len(rows), dtype=np.uint16 if len(rows) < 1 << 16 else np.int32), [len(rows[i][0]) for i in self.order])
        by_term = np.argsort(term, kind="stable")  # places stay in order
        term, self.place, self.weight = term[by_term], place[by_term], np.concatenate([np.round(rows[i][1] * 2.0**24) / 2.0**24 for i in self.order]).astype(np.float32)[by_term]
        block = self.place // BLOCK
        at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
        #: Of each term its blocks; of each of these its postings, number and largest weight; each term's largest weight.
        self.lists = np.searchsorted(term[at], np.arange(terms + 1)).astype(np.int32)
        self.postings, self.block, self.most = np.r_[at, len(term)].astype(np.int32), block[at], np.maximum.reduceat(self.weight, at)
        self.starts = self.postings[self.lists]
        self.top = np.zeros(terms, np.float32)
        np.maximum.at(self.top, term[at], self.most)
        #: Lists that hold an eighth of the examples or more are kept as rows of weights instead, for all blocks.
        sizes = self.postings[self.lists[1:]] - self.postings[self.lists[:-1]]
        full = np.flatnonzero(8 * sizes >= len(rows))
        self.row = np.full(terms, -1, np.int32)
        self.row[full] = np.arange(len(full))
        self.full, self._wide = np.zeros((len(full), len(rows)), np.float32), None
        for r, t in enumerate(full.tolist()):
            own = slice(self.postings[self.lists[t]], self.postings[self.lists[t + 1]])
            self.full[r, self.place[own]] = self.weight[own]
        #: Maxima of long lists, a row for each list and a column for each block, so that a text's bounds are one product.
        has = np.diff(self.lists)
        long = np.flatnonzero((sizes >= LONG * has) & (4 * has >= self.blocks) & (self.row < 0))
        self.bounded = np.full(terms, -1, np.int32)
        self.bounded[long] = np.arange(len(long))
        self.maxima = np.zeros((len(long), self.blocks), np.float32)
        at, times = _ranges(self.lists[long], self.lists[long + 1])
        self.maxima[np.repeat(np.arange(len(long)), times), self.block[at]] = self.most[at]

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the longest lists add to the scores of several texts: a row for each text, a column for each example."""
        query = np.zeros((len(vectors), len(self.full)))
        for i, (terms, weights) in enumerate(vectors):
            row = self.row[terms]
            query[i, row[row >= 0]] = weights[row >= 0]
        return query @ self._own()[0]

    def _own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A task's own: the longest lists in the type in which sums are made; all postings, the weight in multiples of 2^-24
        before the place, one number each, so that one is fetched where two were; numbers from 0; work space."""
        if self._wide is None:
            room = PIECE + len(self.labels)
            self._wide = self.full.astype(float), (self.weight * 2.0**24).astype(np.int64) << 32 | self.place, np.arange(room), np.empty((2, room), np.int64)
        return self._wide

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int | None = None, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a common term; ties go to the earlier place."""
        n = len(self.labels)
        scores = (self.common([(terms, weights)])[0] if common is None else common).astype(float)
        listed = self.row[terms] < 0
        terms, weights = terms[listed], weights[listed]
        first, last = self.starts[terms], self.starts[terms + 1]
        bounded = self.bounded[terms]
        far = bounded >= 0
        if len(terms) > HEAD:  # the weightiest lists are read whole: they set the score that others must reach
            impact = weights * self.top[terms]
            far &= impact < np.partition(impact, len(impact) - HEAD)[len(impact) - HEAD]
        scores = self._added(scores, first[~far], last[~far], weights[~far])
        if leave is not None:
            scores[leave] = 0
        if far.any():
            least, tops = self._least(scores, k)
            bounds = weights[far] @ self.maxima[bounded[far]].astype(float) + tops
            left = bounds * (1 + 1e-9) + 1e-12 >= least
            if 2 * left.sum() < self.blocks:
                at, times = _ranges(self.lists[terms[far]], self.lists[terms[far] + 1])
                on = left[self.block[at]]
                scores = self._added(scores, self.postings[at[on]], self.postings[at[on] + 1], np.repeat(weights[far], times)[on])
            else:
                scores = self._added(scores, first[far], last[far], weights[far])
            if not left.all():
                scores[~np.repeat(left, BLOCK)[:n]] = 0
            if leave is not None:
                scores[leave] = 0
        least = self._least(scores, k)[0]
        found = np.flatnonzero(scores >= least if least > 0 else scores > 0)
        found = found[np.lexsort((found, -scores[found]))[:k]]
        return found, np.minimum(scores[found], 1.0)

    def _least(self, scores: np.ndarray, k: int) -> tuple[float, np.ndarray]:
        """The k-th largest score, 0 if there are no more than k, and the largest of each block. It is no less than the k-th largest of these."""
        tops = np.maximum.reduceat(scores, np.arange(0, len(scores), BLOCK))
        if len(scores) <= k:
            return 0.0, tops
        if len(tops) >= k:
            scores = scores[scores >= np.partition(tops, len(tops) - k)[len(tops) - k]]
        return float(np.partition(scores, len(scores) - k)[len(scores) - k]), tops

    def _added(self, scores: np.ndarray, first: np.ndarray, last: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """scores, to which the postings from each first to before its last are added, by their weights."""
        _, postings, numbers, (held, place) = self._own()
        n = (last - first).astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        cuts = [0, *np.searchsorted(ends, np.arange(PIECE, total, PIECE), side="right").tolist(), len(n)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            before = int(ends[a] - n[a])
            size = int(ends[b - 1]) - before
            at = np.repeat(first[a:b] - (ends[a:b] - n[a:b] - before), n[a:b])
            at += numbers[:size]
            x = np.take(postings, at, out=held[:size], mode="clip")
            p = np.bitwise_and(x, (1 << 32) - 1, out=place[:size])
            x >>= 32
            own = np.repeat(weights[a:b], n[a:b])
            own *= x
            scores = scores + np.bincount(p, own, len(scores)) * 2.0**-24
        return scores


def vote(index: BlockMaxIndex, places: np.ndarray, scores: np.ndarray) -> tuple[float, float]:
    """Share of label 1 among the neighbours, by squared cosine and drawn to one half by a weak prior; the total weight."""
    w = scores**2
    return float((w @ index.labels[places] + 0.05) / (w.sum() + 0.1)), float(w.sum())


def _traits(votes: list[tuple[float, float]]) -> np.ndarray:
    v = np.asarray(votes, float).reshape(-1, 2)
    none = (v[:, 1] == 0).astype(float)
    odds = np.log(v[:, 0] / (1 - v[:, 0])) * (1 - none)
    return np.c_[np.ones(len(v)), odds, none]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


class Model:
    """What a task needs to score texts: bounded by EXAMPLES and the length of their texts."""

    def __init__(self, vectors: Vectors | None, index: BlockMaxIndex | None, coefficients: np.ndarray | None, rate: float):
        self.vectors, self.index, self.coefficients, self.rate = vectors, index, coefficients, rate

    def scores(self, b: pa.RecordBatch, columns: list[int]) -> list[tuple[float, list[int], list[float]]]:
        """Score of each row, and as evidence the ids and cosines of its nearest examples. The columns hold a text, or the
        terms and times that were read of it."""
        if self.index is None:
            return [(self.rate, [], [])] * b.num_rows
        out = []
        for i in range(0, b.num_rows, TOGETHER):
            rows = zip(*(b.column(c).slice(i, TOGETHER).to_pylist() for c in columns), strict=True)
            vectors = [self.vectors.of(*r) if len(r) == 1 else self.vectors.weighted(*unpacked(*r)) for r in rows]
            for (terms, weights), common in zip(vectors, self.index.common(vectors), strict=True):
                places, cosines = self.index.nearest(terms, weights, NEIGHBOURS, common=common) if len(terms) else (np.zeros(0, np.int64), np.zeros(0))
                p = 1 / (1 + np.exp(-float((_traits([vote(self.index, places, cosines)]) @ self.coefficients)[0])))
                out.append((float(p), self.index.ids[places].tolist(), cosines.tolist()))
        return out


def sampled_labels(labels: DataFrame, label: str, n: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of at most n ids of each class, by a hash of the id, and how many there are of each class."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    have = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    pick = lambda c: known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return pick(0).unionByName(pick(1)), have


def distinct_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, label of the sampled documents: equal texts once, with their smallest id and largest label."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # the sample is bounded
    return rows.groupBy("text").agg(F.min("doc_id").cast("long").alias("doc_id"), F.max("label").alias("label"))


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for text, label in zip(b["text"], b["label"], strict=True):
            counts[label].update({t for w in words_of(text) for t in names_of(w)})
    terms = np.fromiter(counts[0].keys() | counts[1].keys(), np.int64)
    for i in range(0, len(terms), 10_000):
        part = terms[i : i + 10_000].tolist()
        yield pd.DataFrame({"term": part, "zeros": [counts[0][t] for t in part], "ones": [counts[1][t] for t in part]})


def packed(terms: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Terms, which ascend, by their distances, and times as bytes that compress well."""
    return np.diff(terms, prepend=0).astype(np.int32).tobytes(), times.astype(np.int32).tobytes()


def unpacked(terms: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(terms, np.int32), dtype=np.int64), np.frombuffer(times, np.int32)


def term_columns(columns: list[str]) -> list[str]:
    """Names, clear of the others, of the columns that hold the terms and times of a text."""
    free = "_" * max(map(len, columns), default=0)
    return [f"{free}terms", f"{free}times"]


def _read(docs: DataFrame) -> tuple[list[str], list[str]]:
    """The columns that docs had at first, and those that scoring reads: the terms if they are there, else the text."""
    first, last = docs.columns[:-2], docs.columns[-2:]
    return (first, last) if last == term_columns(first) else (docs.columns, ["text"])


def with_terms(docs: DataFrame, vectors: Vectors, keep: list[str] | None = None) -> DataFrame:
    """docs, or those of its columns that are to be kept, with the terms of each text, written, so that texts are taken apart once."""
    held, at = docs.sparkSession.sparkContext.broadcast(vectors), docs.columns.index("text")
    own = [i for i, c in enumerate(docs.columns) if keep is None or c in keep]
    fields = [docs.schema.fields[i] for i in own]
    names = term_columns([f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [packed(*held.value.counts(t)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in own), *(pa.array([g[i] for g in got], pa.binary()) for i in (0, 1))], names=[*(f.name for f in fields), *names])

    out = cut(docs.mapInArrow(run, StructType([*fields, *(StructField(n, BinaryType()) for n in names)])), "toxic-terms")
    held.destroy()
    return out


def document_counts(docs: DataFrame, vectors: Vectors) -> tuple[int, np.ndarray]:
    """The number of all documents, and of those that hold each term, from the terms of each."""
    read, known = docs if _read(docs)[1] != ["text"] else with_terms(docs, vectors, []), len(vectors.weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out = 0, np.zeros(known, np.int64)
        for b in batches:
            n += b.num_rows
            for t in b.column(0):
                out[np.cumsum(np.frombuffer(t.as_py(), np.int32))] += 1  # each term of a text stands there once
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[n, out[some]])], names=["term", "n"])

    found = read.select(_read(read)[1][0]).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    at, n, out = found["term"].to_numpy(), found["n"].to_numpy(), np.zeros(known, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


def relevance(zeros: np.ndarray, ones: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """From 0 to 1, by how much the shares of texts with a term differ between the classes, in standard errors."""
    p = (zeros + ones + 1) / (n0 + n1 + 2)
    z = np.abs(ones / n1 - zeros / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    return z / (z + HALF_Z)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, label); only ids in both are examples."""
    return fitted(docs.select("doc_id", "text"), labels, label, examples, [])[0]


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES, keep: list[str] | None = None) -> tuple[Model, DataFrame]:
    """As fit, and docs, or the columns to be kept, with the terms that were read of each text, for scoring; docs as they are
    where there are no terms."""
    sample, have = sampled_labels(labels, label, examples)
    texts = cut(distinct_texts(docs, sample), "toxic-examples")
    ones, zeros = (lambda r: (r["ones"] or 0, r["n"] - (r["ones"] or 0)))(texts.agg(F.sum("label").alias("ones"), F.count("*").alias("n")).first())
    rate = have.get(1, 0) / max(1, have.get(0, 0) + have.get(1, 0))
    if not ones or not zeros:
        return Model(None, None, None, float(rate)), docs
    counted = texts.mapInPandas(_count_terms, "term long, zeros long, ones long").groupBy("term").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    counted = counted.toArrow().sort_by("term")  # the terms of the examples
    if not len(counted):
        return Model(None, None, None, float(rate)), docs
    share = {0: have[0] / zeros, 1: have[1] / ones}  # an example stands for so many
    vectors = Vectors(counted["term"].to_numpy(), relevance(counted["zeros"].to_numpy(), counted["ones"].to_numpy(), zeros, ones))
    del counted
    docs = with_terms(docs, vectors, keep)
    n, df = document_counts(docs, vectors)
    vectors = Vectors(vectors.names, vectors.weight * (np.log((n + 1) / (df + 1)) + 1))
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def to_vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [held.value.of(t) for t in b["text"]]
            yield pd.DataFrame({"name": b["name"], "doc_id": b["doc_id"], "label": b["label"], "terms": [t.astype(np.int32).tobytes() for t, _ in got], "weights": [w.tobytes() for _, w in got]})

    rows = cut(texts.withColumn("name", F.md5("text")).mapInPandas(to_vectors, "name string, doc_id long, label int, terms binary, weights binary"), "toxic-vectors")
    held.destroy()
    give_back()
    full = rows.where(F.length("terms") > 0).toArrow().sort_by("name")
    if not len(full):
        return Model(None, None, None, float(rate)), docs
    unpacked = [(np.frombuffer(t.as_py(), np.int32), np.frombuffer(w.as_py())) for t, w in zip(full["terms"], full["weights"], strict=True)]
    index = BlockMaxIndex(unpacked, full["label"].to_numpy(), full["doc_id"].to_numpy(), len(vectors.weight))
    names = full["name"].to_pylist()
    places = {names[i]: place for place, i in enumerate(index.order.tolist())}
    del full, unpacked
    tried = docs.sparkSession.sparkContext.broadcast((index, places))

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, places = tried.value
        for b in batches:
            at, got = [places[x] for x in b["name"]], []
            vectors = [(np.frombuffer(t, np.int32), np.frombuffer(w)) for t, w in zip(b["terms"], b["weights"], strict=True)]
            for i in range(0, len(vectors), TOGETHER):
                common = index.common(vectors[i : i + TOGETHER])
                got += [vote(index, *index.nearest(t, w, NEIGHBOURS, p, c)) for (t, w), p, c in zip(vectors[i : i + TOGETHER], at[i : i + TOGETHER], common, strict=True)]
            yield pd.DataFrame({"place": at, "share": [g[0] for g in got], "mass": [g[1] for g in got]})

    # each example voted on without itself, in tasks; those without terms have the empty vote
    got = rows.where(F.length("terms") > 0).repartition(32, "name").mapInPandas(votes, "place long, share double, mass double").toArrow().sort_by("place")
    tried.destroy()
    bare = {r["label"]: r["count"] for r in rows.where(F.length("terms") == 0).groupBy("label").count().collect()}
    y = np.r_[index.labels, *(np.full(bare.get(c, 0), float(c)) for c in (0, 1))]
    x = [*zip(got["share"].to_numpy(), got["mass"].to_numpy(), strict=True), *[(0.5, 0.0)] * (len(y) - len(index.labels))]
    del got, names, places
    give_back()
    return Model(vectors, index, logistic(_traits(x), y, np.where(y > 0, share[1], share[0])), float(rate)), docs


def score(docs: DataFrame, model: Model, *, evidence: bool = False) -> DataFrame:
    """doc_id, score, predicted for each document; with evidence also example_ids and cosines of its neighbours. docs may hold
    the terms that fit read."""
    held, (_, read) = docs.sparkSession.sparkContext.broadcast(model), _read(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            got = m.scores(b, list(range(1, b.num_columns)))
            p = pa.array([g[0] for g in got], pa.float64())
            cols = [b.column(0), p, pa.array([int(g[0] >= 0.5) for g in got], pa.int32())]
            if evidence:
                cols += [pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted", "example_ids", "cosines"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *read).mapInArrow(run, "doc_id long, score double, predicted int" + ", example_ids array<long>, cosines array<double>" * evidence)


def flagged(docs: DataFrame, model: Model, name: str = "toxic") -> DataFrame:
    """docs, without the terms that fit read, with one more column: 1 if the score of its text is 0.5 or more, else 0.

    The marks are written, so that what reads them later doesn't keep the model in the driver."""
    held, (own, read) = docs.sparkSession.sparkContext.broadcast(model), _read(docs)
    at, n = [docs.columns.index(c) for c in read], len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = pa.array([int(got[0] >= 0.5) for got in held.value.scores(b, at)], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], marks], names=[*b.schema.names[:n], name])

    out = cut(docs.mapInArrow(run, StructType([*docs.schema.fields[:n], StructField(name, IntegerType())])), "toxic-flagged")
    held.destroy()
    return out


def toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, evidence: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from labels whose fold isn't ``held`` only."""
    model, read = fitted(docs.select("doc_id", "text"), labels.where(fold(F.col("doc_id"), folds) != held), keep=["doc_id"])
    out = score(read, model, evidence=evidence)
    del model
    give_back()
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), *[c for c in out.columns if c != "doc_id"])
