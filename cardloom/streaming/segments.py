"""The segmenter over unbounded input: windows, decisions, repeats and the backstop, with state of bounded size for each video."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.segmentation import LOGGED
from ..operators.tracker import WINDOW, Log, Tracker, Window
from ..params import Backstop, Segmentation

#: Set on a session that runs such a stream: state with several variables is kept in RocksDB.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ROW = "frame int, motion double, sharpness double, hash long"
_NAMES = [c.split()[0] for c in LOGGED.split(", ")]


class Segmenter(StatefulProcessor):
    """State of a video: where the machine stands (``machine``), the frames that may open a window (``seed``) and a trial
    (``recent``), its windows by their part (``windows``), the anchor's cells, the last accepted frame (``log``), and the
    timer that ends a video which has been silent."""

    def __init__(self, p: Segmentation, backstop: Backstop | None, idle: float):
        self._p, self._b, self._idle = p, backstop, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._machine = handle.getValueState("machine", "mode string, high int, low int, segment int, since int, positive int, timer long")
        self._log = handle.getValueState("log", "accepted int, hash long, frame int")
        self._anchor = handle.getValueState("anchor", "cells array<double>")
        self._seed, self._recent = handle.getListState("seed", ROW), handle.getListState("recent", ROW)
        self._windows = handle.getMapState("windows", "part string", WINDOW)

    def _read(self) -> tuple[Tracker, Log, int | None]:
        if not self._machine.exists():
            return Tracker(self._p, self._b), Log(self._p), None
        mode, high, low, segment, since, positive, timer = self._machine.get()
        part = {k: Window.of(v) for (k,), v in self._windows.iterator()}
        anchor = self._anchor.get()[0] if self._anchor.exists() else None
        rows = lambda state: deque(tuple(r) for r in state.get()) if state.exists() else deque()
        machine = Tracker(self._p, self._b, mode, high, low, segment, rows(self._seed), part.get("open"), None if anchor is None else np.asarray(anchor, float), part.get("anchored"), part.get("trial"), since, positive, rows(self._recent))
        return machine, Log(self._p, *(self._log.get() if self._log.exists() else ())), timer

    def _write(self, m: Tracker, log: Log, timer: int | None) -> None:
        self._machine.update((m.mode, m.high, m.low, m.segment, m.since, m.positive, timer))
        self._log.update((log.accepted, log.bits, log.frame))
        for state, rows in ((self._seed, m.seed), (self._recent, m.recent)):
            if rows:
                state.put(list(rows))
            else:
                state.clear()
        if m.anchor is None:
            self._anchor.clear()
        else:
            self._anchor.update((np.asarray(m.anchor, float).tolist(),))
        for part, w in (("open", m.window), ("anchored", m.anchored), ("trial", m.trial)):
            if w is not None:
                self._windows.updateValue((part,), w.kept())
            elif self._windows.containsKey((part,)):
                self._windows.removeKey((part,))

    def _rows(self, key: tuple, found: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame([[w[c] for c in _NAMES] for w in found], columns=_NAMES, dtype=object)
        out.insert(0, "video_id", key[0])
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, log, timer = self._read()
        wait = int(self._idle * 1000)
        out, seen, final = [], None if timer is None else timer - wait, False
        for r in pd.concat(list(rows)).sort_values("frame_number", kind="stable").itertuples(index=False):
            now = int(pd.Timestamp(r.ts).timestamp() * 1000)
            if final or seen is not None and now - seen > wait:
                out += [log.decided(w) for w in machine.finish()]
                machine, log = Tracker(self._p, self._b), Log(self._p)
            bits = None if r.hash is None else int(r.hash)  # as text, since pandas makes floats of longs with nulls
            cells = None if r.cells is None else np.asarray(r.cells, float)
            motion = None if pd.isna(r.motion) else float(r.motion)
            out += [log.decided(w) for w in machine.push(int(r.frame_number), motion, float(r.sharpness), bits, cells)]
            seen, final = max(now, now if seen is None else seen), bool(r.final)
            if final:
                out += [log.decided(w) for w in machine.finish()]
        if timer is not None:
            self._handle.deleteTimer(timer)
        if final:
            self._forget()
        else:
            self._handle.registerTimer(seen + wait)
            self._write(machine, log, seen + wait)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine, log, _ = self._read()
        out = [log.decided(w) for w in machine.finish()]
        self._forget()
        if out:
            yield self._rows(key, out)

    def _forget(self) -> None:
        for state in (self._machine, self._log, self._anchor, self._seed, self._recent, self._windows):
            state.clear()


def decision_stream(frames: DataFrame, p: Segmentation = Segmentation(), backstop: Backstop | None = None, *, late: str = "0 seconds", idle: float = 3600.0) -> DataFrame:
    """The decision log of each video as its windows end.

    frames: video_id, frame_number, ts (event time), motion, sharpness, and if there are such hash, cells, and final (true on a
    video's last frame, which ends it). A video's frames must arrive in order across batches; inside one they are sorted, so a
    batch bounds what of a video is held at once. A video that is silent for more than ``idle`` seconds of event time ends as if its
    frames had, when the watermark has passed or a later frame comes, and its state goes; frames after that are of a new one.
    """
    for name, kind in (("hash", "long"), ("cells", "array<double>"), ("final", "boolean")):
        if name not in frames.columns:
            frames = frames.withColumn(name, F.lit(None).cast(kind) if name != "final" else F.lit(False))
    rows = frames.select("video_id", "frame_number", "ts", "motion", "sharpness", F.col("hash").cast("string").alias("hash"), "cells", F.coalesce("final", F.lit(False)).alias("final")).withWatermark("ts", late)
    kind = frames.schema["video_id"].dataType.simpleString()
    return rows.groupBy("video_id").transformWithStateInPandas(Segmenter(p, backstop, idle), f"video_id {kind}, {LOGGED}", "Append", "EventTime")
