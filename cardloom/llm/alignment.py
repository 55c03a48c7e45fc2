"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and which pairs of ids overlap how often.

Both token sequences of a text are read by a transducer whose state is the side that leads and its bytes which the other side
hasn't matched yet (the dangling suffix). The side behind reads its next token: either that is a beginning of the suffix, which
then is shorter, or the suffix is a beginning of the token, which then leads with what is left. An empty suffix closes a group.
Where a suffix goes with a token is remembered, so bytes are compared once for each pair of suffix and token. As a
suffix always belongs to the last token of its side, each step on a suffix is one link. The two steps of a group of one token
each, the commonest, are remembered together.

Documents are aligned in blocks, each a row with its documents' distinct linked pairs in it (``aligned``). How many documents
link a pair is summed over blocks, and goes back to the blocks that hold the pair, not to documents, so that what crosses the
network is a row for each pair of each block, twice, and each block once.

Cases: null and empty texts, and texts whose bytes either tokenizer doesn't give back, have no tokens: zeros and the empty
digest; null ids, repeated ids and repeated rows each keep their own row and count as documents of their own; ties of counts are
all best; texts of any length are aligned whole, a long one in a block of its own; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .tokenizer import Encoder, token_bytes

#: Documents and distinct links (summed over documents) that close a block.
TOGETHER, LINKS = 2_000, 1_000_000
#: Remembered transitions; beyond, they are forgotten and found anew.
REMEMBERED = 2_000_000
#: An id of the second tokenizer in a pair's code.
BITS = 20
LOW = (1 << BITS) - 1

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
BLOCKS = f"block long, doc_id array<long>, {', '.join(f'{c} array<int>' for c in COUNTS)}, groups_sha256 array<string>, distinct array<int>, at array<int>, times array<int>, pairs array<long>, docs array<int>"
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Transducer:
    """States are numbers: 0 for the empty suffix, on which the first side reads."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self._bytes = (a_bytes, b_bytes)
        self._states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self._names: list[tuple[int, bytes]] = [(0, b"")]
        self._leads: list[int] = [0]  # 1 where the first side leads, so the second reads
        self._next: dict[int, int] = {}
        self._pairs: dict[int, str] = {}

    def _step(self, state: int, token: int) -> int:
        """The state after the side behind has read ``token``; -1 where bytes differ."""
        leads, suffix = self._names[state]
        read = self._bytes[leads][token]
        if not read:
            return -1
        if suffix.startswith(read):
            name = (leads, suffix[len(read) :])
        elif read.startswith(suffix):
            name = (1 - leads, read[len(suffix) :])
        else:
            return -1
        name = name if name[1] else (0, b"")
        if name not in self._states:
            self._states[name] = len(self._names)
            self._names.append(name)
            self._leads.append(name[0])
        return self._states[name]

    def _after(self, state: int, token: int) -> int:
        """``_step``, remembered."""
        after = self._next[state << BITS | token] = self._step(state, token)
        return after

    def _alone(self, code: int) -> str:
        """The text of the group that one token of each side closes, empty if they don't; remembered for both steps at once."""
        x, y = code >> BITS, code & LOW
        at = self._step(0, x)
        closes = at > 0 and self._leads[at] and self._step(at, y) == 0
        return f"{x}|{y}" if closes else ""

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]] | None:
        """(groups as ``a1,a2|b1``, codes of links), both in order; None where the bytes differ."""
        if len(self._next) + len(self._pairs) > REMEMBERED:
            self._next.clear()
            self._pairs.clear()
        get, pair, leads = self._next.get, self._pairs.get, self._leads
        left, right = iter([x << BITS for x in a]), iter(b)
        groups, links, more = [], [], 0
        closed, linked = groups.append, links.append
        for code in map(or_, left, right):  # a token of each side from the empty suffix
            alone = pair(code)
            if alone is None:
                alone = self._pairs[code] = self._alone(code)
            if alone:
                closed(alone)
                linked(code)
                continue
            x, y = code & ~LOW, code & LOW
            xs, ys, held = [x >> BITS], [y], True  # y is read, but not yet taken
            state = get(x >> BITS)
            if state is None:
                state = self._after(0, x >> BITS)
            while state > 0:
                if leads[state]:
                    if not held:
                        if (y := next(right, -1)) < 0:
                            return None
                        ys.append(y)
                    held, token = False, y
                else:
                    if (x := next(left, -1)) < 0:
                        return None
                    token = x >> BITS
                    xs.append(token)
                linked(x | y)
                key = state << BITS | token
                after = get(key)
                state = self._after(state, token) if after is None else after
            if state < 0:
                return None
            more += len(xs) - 1
            closed(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)))
        # where one side has no more tokens map() may have taken one of the other
        return (groups, links) if len(groups) + more == len(a) and next(right, None) is None else None


@lru_cache(maxsize=2)
def _tools(a_path: str, b_path: str) -> tuple[Encoder, Encoder, list[bytes], Transducer]:
    a_bytes = token_bytes(a_path)
    return Encoder(a_path, plain=True), Encoder(b_path, plain=True), a_bytes, Transducer(a_bytes, token_bytes(b_path))


def _blocks(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc_a, enc_b, a_bytes, machine = _tools(a_path, b_path)
        block, rows, codes, times, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        nothing = np.zeros(0, np.int64)

        def aligned(text: str) -> tuple[tuple, np.ndarray, np.ndarray]:
            spaced = " " + text
            a, b = enc_a.listed(spaced), enc_b.listed(text)
            if b"".join([a_bytes[i] for i in a]) != spaced.encode() or (found := machine.align(a, b)) is None:  # b's bytes are then a's
                return (0, 0, 0, 0, ""), nothing, nothing
            groups, links = found
            own, n = np.unique(np.asarray(links, np.int64), return_counts=True)
            return (len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()), own, n

        def closed() -> pa.RecordBatch:
            nonlocal block, held
            ids, facts = zip(*rows, strict=True)
            pairs, at, docs = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            cols = [[block], [ids], *([c] for c in zip(*facts, strict=True)), [[len(c) for c in codes]], [at.astype(np.int32)], [np.concatenate(times).astype(np.int32)], [pairs], [docs.astype(np.int32)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4, pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["block", "doc_id", *COUNTS, "groups_sha256", "distinct", "at", "times", "pairs", "docs"]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            block, held = block + 1, 0
            for x in (rows, codes, times):
                x.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                facts, own, n = aligned(text) if text else ((0, 0, 0, 0, ""), nothing, nothing)
                rows.append((doc_id, facts))
                codes.append(own)
                times.append(n)
                held += len(own)
                if len(rows) >= TOGETHER or held >= LINKS:
                    yield closed()
        if rows:
            yield closed()

    return run


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the corpus's counts of their pairs, back to rows of documents."""
    for b in batches:
        for k in range(b.num_rows):
            get = lambda name: b.column(name)[k].values  # noqa: B023, E731
            n = len(get("doc_id"))
            if found := b.column("found")[k].values:
                order = np.argsort(found.field("pos").to_numpy(zero_copy_only=False), kind="stable")
                count, best = (found.field(c).to_numpy(zero_copy_only=False)[order] for c in ("n", "best"))
                at, times = get("at").to_numpy(), get("times").to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(n), get("distinct").to_numpy())
                sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
                np.add.at(sums[0], doc, times * best[at])
                np.add.at(sums[1], doc, times * count[at])
            else:
                sums = [np.zeros(n, np.int64)] * 2
            cols = [get("doc_id"), *(get(c).cast(pa.int64()) for c in COUNTS), *map(pa.array, sums), get("groups_sha256")]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])


def blocks(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_blocks(a_path, b_path), BLOCKS), "align-blocks")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that link it), best (1 if no pair of its first id is in more documents)."""
    pairs = aligned.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    pairs = cut(pairs, "align-pairs")
    top = pairs.groupBy(F.shiftright("pair", BITS).alias("a")).agg(F.max("n").alias("most"))
    return pairs.join(top, F.shiftright("pair", BITS) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def vocabulary_links(aligned: DataFrame) -> DataFrame:
    """a, b, n, best: the table of linked ids, for mapping one vocabulary onto the other."""
    counts = pair_counts(aligned)
    return counts.select(F.shiftright("pair", BITS).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << BITS) - 1).cast("int").alias("b"), "n", (F.col("best") == 1).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each document."""
    aligned = blocks(docs, a_path, b_path, id_col=id_col, text_col=text_col)
    asked = aligned.select("block", F.posexplode("pairs").alias("pos", "asked"))
    told = asked.join(pair_counts(aligned), F.col("asked") == F.col("pair")).groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("pos", "n", "best")).alias("found"))
    return aligned.join(told, F.col("block") == F.col("of"), "left").select("doc_id", *COUNTS, "groups_sha256", "distinct", "at", "times", "found").mapInArrow(_unfolded, ROWS)
