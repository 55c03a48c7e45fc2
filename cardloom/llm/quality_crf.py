"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe it and its neighbours (how much it repeats words, how many
symbols, capitals and digits it has, how long its words are, ...); the chain's transition weights let a line's label lean
on the labels around it. Weights are learnt by maximum likelihood from a bounded sample of labelled documents, whose
lines take their document's label. Forward-backward gives each line's chance to be good; the mean of these, weighted by
line length, is mapped to a probability by logistic calibration on the sample.

Cases: texts of any length are scored whole, line by line; null and empty texts are one empty line; blank lines count with the length 1; null ids never match a label; an id with
clashing labels counts as labelled 1, as does a text whose rows clash; equal texts are learnt from once; repeated rows get equal scores; without documents of both classes every score is the share of label 1 in the sample, or
0; an empty table gives an empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, fold
from .toxicity import distinct_texts, logistic, sampled_labels

#: Documents of each class in the sample; lines of a sampled document at most (longer ones aren't sampled).
SAMPLE, LINES = 1500, 400
STEPS, RATE, RIDGE = 60, 0.15, 1e-3

_SYMBOLS, _UPPER, _DIGITS, _BARS = re.compile(r"[#*$%&<>!@=_{}\[\]\\^~]"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"\|")
#: Features of one line; with those of both neighbours and two for the ends.
OWN = 12


def line_features(line: str, before: str) -> list[float]:
    n, words = len(line), line.split()
    k = len(words)
    if not k:
        return [1.0] + [0.0] * (OWN - 1)
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        1.0,
        min(1.0, k / 40),
        1 - len(set(words)) / k,
        again / k,
        min(1.0, 4 * len(_SYMBOLS.findall(line)) / n),
        len(_UPPER.findall(line)) / n,
        min(1.0, 4 * len(_DIGITS.findall(line)) / n),
        min(1.0, 8 * len(_BARS.findall(line)) / n),
        min(2.0, n / k / 8),
        float(k < 4),
        float(line.rstrip()[-1] in ".!?\"'…"),
        float(line == before),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row for each line, and the lines' lengths."""
    lines = (text or "").split("\n")
    own = np.asarray([line_features(x, lines[i - 1] if i else "") for i, x in enumerate(lines)])
    none = np.zeros((1, OWN))
    ends = np.zeros((len(lines), 2))
    ends[0, 0] = ends[-1, 1] = 1
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), ends]), np.asarray([max(1, len(x)) for x in lines], float)


WIDTH = 3 * OWN + 2


def forward_backward(odds: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each line to be good, and the expected number of moves between labels.

    odds: log odds of good at each line; moves: 2 x 2 log weights of the label before and after.
    """
    n = len(odds)
    good = np.exp(np.clip(odds, -30, 30)).tolist()
    (m00, m01), (m10, m11) = np.exp(moves).tolist()
    a = [(1 / (1 + good[0]), good[0] / (1 + good[0]))]
    for g in good[1:]:
        x, y = a[-1]
        p, q = x * m00 + y * m10, (x * m01 + y * m11) * g
        a.append((p / (p + q), q / (p + q)))
    b, pairs, out = (0.5, 0.5), np.zeros((2, 2)), [0.0] * n
    for i in range(n - 1, -1, -1):
        x, y = a[i]
        out[i] = y * b[1] / (x * b[0] + y * b[1])
        if i:
            g, (u, v) = good[i], a[i - 1]
            c, d = b[0], b[1] * g
            t = (u * m00 * c, u * m01 * d, v * m10 * c, v * m11 * d)
            s = sum(t)
            pairs += np.asarray(t).reshape(2, 2) / s
            p, q = m00 * c + m01 * d, m10 * c + m11 * d
            b = (p / (p + q), q / (p + q))
    return np.asarray(out), pairs


def marginals(odds: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """forward_backward of many documents at once. odds: those of all lines, document after document, longest document
    first; lengths: lines of each."""
    starts, most = np.r_[0, np.cumsum(lengths)[:-1]], int(lengths[0])
    good, m = np.exp(np.clip(odds, -30, 30)), np.exp(moves)
    alive = np.searchsorted(-lengths, -np.arange(most), side="left")  # documents longer than i
    ahead, out, pairs = np.empty((len(odds), 2)), np.empty(len(odds)), np.zeros((2, 2))
    at = starts[: alive[0]]
    ahead[at] = np.c_[1 / (1 + good[at]), good[at] / (1 + good[at])]
    for i in range(1, most):
        at = starts[: alive[i]] + i
        p = ahead[at - 1] @ m
        p[:, 1] *= good[at]
        ahead[at] = p / p.sum(axis=1, keepdims=True)
    back = np.full((len(lengths), 2), 0.5)
    for i in range(most - 1, -1, -1):
        n = alive[i]
        at = starts[:n] + i
        both = ahead[at] * back[:n]
        out[at] = both[:, 1] / both.sum(axis=1)
        if i:
            right = back[:n].copy()
            right[:, 1] *= good[at]
            t = ahead[at - 1][:, :, None] * m * right[:, None, :]
            pairs += (t / t.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            p = right @ m.T
            back[:n] = p / p.sum(axis=1, keepdims=True)
    return out, pairs


class Field:
    """The fitted field and its calibration: a few dozen numbers."""

    def __init__(self, weights: np.ndarray | None, moves: np.ndarray | None, map_to: np.ndarray | None, rate: float):
        self.weights, self.moves, self.map_to, self.rate = weights, moves, map_to, rate

    def lines(self, x: np.ndarray) -> np.ndarray:
        return forward_backward(x @ self.weights, self.moves)[0]

    def document(self, text: str | None) -> float:
        if self.weights is None:
            return self.rate
        x, length = features(text)
        return float(calibrated(self.map_to, np.asarray([self.lines(x) @ length / length.sum()]))[0])


def calibrated(map_to: np.ndarray, mean: np.ndarray) -> np.ndarray:
    odds = np.log(np.clip(mean, 1e-4, 1 - 1e-4) / np.clip(1 - mean, 1e-4, 1))
    return 1 / (1 + np.exp(-(map_to[0] + map_to[1] * odds)))


def train(x: np.ndarray, weight: np.ndarray, lengths: np.ndarray, labels: np.ndarray, share: dict[int, float], rate: float) -> Field:
    """x, weight: features and length of all lines, document after document, longest document first; lengths, labels: of each
    document; share: for how many documents one of a class stands."""
    if len(np.unique(labels)) < 2:
        return Field(None, None, None, rate)
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    y = np.repeat(labels, lengths)
    own = np.diag([float((lengths - 1)[labels == c].sum()) for c in (0, 1)])  # moves of the labellings learnt from: none changes inside a document
    for step in range(1, STEPS + 1):
        good, pairs = marginals(x @ theta[:WIDTH].astype(np.float32), lengths, theta[WIDTH:].reshape(2, 2))
        g = np.r_[x.T @ (y - good).astype(np.float32), (own - pairs).ravel()] / len(y) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    good, _ = marginals(x @ theta[:WIDTH].astype(np.float32), lengths, theta[WIDTH:].reshape(2, 2))
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    mean = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
    odds = np.log(np.clip(mean, 1e-4, 1 - 1e-4) / np.clip(1 - mean, 1e-4, 1))
    map_to = logistic(np.c_[np.ones(len(labels)), odds], labels.astype(float), np.where(labels > 0, share[1], share[0]))
    return Field(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), map_to, rate)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Field:
    """Learn from docs (doc_id, text) and labels (doc_id, label); at most ``sample`` documents of each class.

    Features are made in tasks. At the bound the driver holds 2 * SAMPLE * LINES lines of WIDTH single-precision features,
    180 MB, and goes through them in array operations over all documents.
    """
    picked, have = sampled_labels(labels, label, sample)
    texts = distinct_texts(docs, picked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [features(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "lines": [len(n) for _, n in got], "x": [x.astype(np.float32).tobytes() for x, _ in got], "n": [n.tobytes() for _, n in got]})

    small = texts.where(F.length("text") - F.length(F.translate("text", "\n", "")) < LINES)
    rows = cut(small.mapInPandas(run, "doc_id long, label int, lines int, x binary, n binary"), "crf-sample").orderBy(F.desc("lines"), "doc_id", "x").toPandas()
    y = rows["label"].to_numpy(np.int64)
    rate = have.get(1, 0) / max(1, have.get(0, 0) + have.get(1, 0))
    if not len(rows):
        return Field(None, None, None, float(rate))
    share = {c: have.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
    x, weight = np.frombuffer(b"".join(rows.pop("x")), np.float32).reshape(-1, WIDTH), np.frombuffer(b"".join(rows.pop("n")))
    return train(x, weight, rows["lines"].to_numpy(np.int64), y, share, float(rate))


def quality(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from labels whose fold isn't ``held`` only."""
    field = fit(docs, labels.where(fold(F.col("doc_id"), folds) != held))
    held_field = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held_field.value
        for b in batches:
            p = [f.document(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], names=["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")
