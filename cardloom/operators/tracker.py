"""The segmenter as a state machine that takes frame by frame and keeps a few numbers, however long a video or a window lasts.

It finds what the window functions of ``segmentation`` find, and also has the backstop, which depends on its own past
decisions: in a long window the picture is compared, every few frames, with an anchor (the picture at the window's opening,
later that of the last check that found no change). A change opens a window of the most recent frames on trial; if so many
checks in a row find it, all against the same anchor, the window ends as it stood at the anchor, and the one on trial goes on.

Cases: a frame without motion (a video's first) is skipped and neither continues nor breaks anything; a frame without cells is
not checked; without hashes nothing is a repeat.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

from ..params import Backstop, Segmentation

#: A frame as the machine keeps it: number, motion, sharpness, hash.
Row = tuple[int, float, float, int | None]
#: What a window is kept as.
WINDOW = "frames int, first int, last int, last_motion double, last_sharpness double, last_hash long, calm_frame int, calm_motion double, calm_sharpness double, calm_hash long, other_frame int, other_motion double, other_sharpness double, other_hash long"


def rounded(x: float) -> float:
    """Six decimals by the rule of ``functions.numbers.rounded``, so that the machine's ties are those of the window functions."""
    y = abs(x) * 1e6
    low = math.floor(y)
    return math.copysign((low + (y - low >= 0.5)) / 1e6, x)


@dataclass(slots=True)
class Window:
    """A window's bounds, its last frame, and its best frames so far: of those with little local motion, and of all.

    A candidate is a frame with neighbours in the window, (number, local motion, sharpness, hash).
    """

    frames: int = 0
    first: int = 0
    last: Row | None = None
    calm: Row | None = None
    other: Row | None = None

    def add(self, row: Row, p: Segmentation) -> None:
        if self.frames >= 2:
            frame, motion, sharpness, bits = self.last
            found = (frame, rounded((motion + row[1]) / 2), sharpness, bits)
            if found[1] <= p.candidate_motion and (self.calm is None or self._calmness(found) < self._calmness(self.calm)):
                self.calm = found
            if self.other is None or self._score(found, p) < self._score(self.other, p):
                self.other = found
        self.first = self.first if self.frames else row[0]
        self.frames, self.last = self.frames + 1, row

    @staticmethod
    def _calmness(c: Row) -> tuple:
        return c[1], -c[2], c[0]

    @staticmethod
    def _score(c: Row, p: Segmentation) -> tuple:
        return rounded(-(c[2] - p.fallback_weight * c[1])), c[1], -c[2], c[0]

    def copy(self) -> Window:
        return Window(self.frames, self.first, self.last, self.calm, self.other)

    def kept(self) -> tuple:
        """The values of WINDOW."""
        none = (None,) * 4
        return (self.frames, self.first, *(self.last or none), *(self.calm or none), *(self.other or none))

    @classmethod
    def of(cls, kept: Sequence) -> Window:
        rows = [tuple(kept[i : i + 4]) for i in (2, 6, 10)]
        return cls(kept[0], kept[1], *(r if r[0] is not None else None for r in rows))


@dataclass(slots=True)
class Tracker:
    """``push`` and ``finish`` give each window that ends, as a dict."""

    p: Segmentation = field(default_factory=Segmentation)
    backstop: Backstop | None = None
    mode: str = "idle"
    high: int = 0
    low: int = 0
    segment: int = 0
    seed: deque = field(default_factory=deque)
    window: Window | None = None
    anchor: np.ndarray | None = None
    anchored: Window | None = None
    trial: Window | None = None
    since: int = 0
    positive: int = 0
    recent: deque = field(default_factory=deque)

    def push(self, frame: int, motion: float | None, sharpness: float, bits: int | None = None, cells: np.ndarray | None = None) -> Iterator[dict]:
        if motion is None or motion != motion:
            return
        p, row = self.p, (frame, motion, sharpness, bits)
        self.high = self.high + 1 if motion >= p.enter else 0
        self.low = self.low + 1 if motion <= p.exit else 0
        if self.mode == "stable" and self.high < p.enter_frames:
            yield from self._stay(row, cells)
        elif self.high >= p.enter_frames:
            if self.mode == "stable":
                yield self._ended(self.window, False)
            self.mode, self.low, self.window = "moving", 0, None
            self.seed.clear()
        elif self.mode == "moving" and not self.low:
            self.seed.clear()
        elif self.mode == "moving":
            self.seed.append(row)
            if self.low >= p.exit_frames:
                self._open(cells)

    def finish(self) -> Iterator[dict]:
        """The window in which the frames end; the next frame is then that of a new video, or of one that goes on after a break."""
        if self.mode == "stable":
            yield self._ended(self.window, True)
        self.mode, self.high, self.low, self.window = "idle", 0, 0, None
        self.seed.clear()

    def _open(self, cells: np.ndarray | None) -> None:
        self.mode, self.window = "stable", Window()
        for row in self.seed:
            self.window.add(row, self.p)
        self.seed.clear()
        self._anchor(cells)

    def _anchor(self, cells: np.ndarray | None) -> None:
        self.anchor, self.anchored, self.trial = cells, self.window.copy() if self.backstop else None, None
        self.since = self.positive = 0
        self.recent.clear()

    def _stay(self, row: Row, cells: np.ndarray | None) -> Iterator[dict]:
        self.window.add(row, self.p)
        if not self.backstop:
            return
        b = self.backstop
        self.recent.append(row)
        while len(self.recent) > max(b.seed, b.interval):
            self.recent.popleft()
        self.since += 1
        if self.trial:
            self.trial.add(row, self.p)
        if self.window.frames < max(b.start, self.p.min_frames) or self.since % b.interval or cells is None or self.anchor is None:
            return
        if not self._changed(cells):
            self._anchor(cells)
            return
        if not self.positive:
            self.trial = Window()
            for r in self.recent:
                self.trial.add(r, self.p)
        self.positive += 1
        if self.positive >= b.checks:
            yield self._ended(self.anchored, False)
            self.window = self.trial
            self._anchor(cells)

    def _changed(self, cells: np.ndarray) -> bool:
        """Whether enough cells differ from the anchor's. cells holds a number for each cell, or all pixels, cell after cell."""
        each = np.abs(np.asarray(cells, float) - np.asarray(self.anchor, float)).reshape(self.backstop.grid, -1).mean(axis=1)
        return int((each >= self.backstop.cell_change).sum()) >= self.backstop.cells

    def _ended(self, w: Window, eof: bool) -> dict:
        self.segment += 1
        pick = w.calm or w.other or (None,) * 4
        return {"segment": self.segment, "first_frame": w.first, "final_frame": w.last[0], "frames": w.frames, "eof": eof, "fallback": not w.calm and w.other is not None, "frame_number": pick[0], "local_motion": pick[1], "sharpness": pick[2], "hash": pick[3]}


@dataclass(slots=True)
class Log:
    """Decisions on windows in order: short and blurry ones go, then repeats of the last accepted one; the others are numbered."""

    p: Segmentation = field(default_factory=Segmentation)
    accepted: int = 0
    bits: int | None = None
    frame: int | None = None

    def decided(self, w: dict) -> dict:
        p = self.p
        short, blurry = w["frames"] < p.min_frames or w["frame_number"] is None, w["frame_number"] is not None and w["sharpness"] < p.blur
        review = w["frames"] < max(p.low_confidence_frames, p.min_frames) or w["eof"] or w["fallback"] or blurry
        out = w | {"needs_review": review, "extraction_confidence": "low" if review else "high", "sequence_index": None, "duplicate_distance": None, "duplicate_of_frame_number": None}
        if short or blurry:
            return out | {"decision": "rejected_short_stable" if short else "rejected_blur"}
        distance = None if self.bits is None or w["hash"] is None else ((self.bits ^ w["hash"]) & (1 << 64) - 1).bit_count()
        out["duplicate_distance"] = distance
        if distance is not None and distance < p.duplicate_distance:
            return out | {"decision": "rejected_dedup", "duplicate_of_frame_number": self.frame}
        self.accepted, self.bits, self.frame = self.accepted + 1, w["hash"], w["frame_number"]
        return out | {"decision": "accepted", "sequence_index": self.accepted}
