"""The state machine, the iterator over sorted frames and the stream, against a plain run that keeps whole windows."""

import duckdb
import numpy as np
import pytest
from cardloom.functions import numbers
from cardloom.operators import segmentation, tracker
from cardloom.operators.tracker import Log, Tracker
from cardloom.params import Backstop, Segmentation
from cardloom.plans.streams import in_batches
from cardloom.streaming import segments
from pyspark.sql import functions as F

SHORT = Segmentation(exit_frames=3, min_frames=4, low_confidence_frames=6, candidate_motion=2.0, blur=20.0)
SILENT = Backstop(start=6, interval=2, cell_change=8.0, cells=2, checks=2, seed=3)
FRAME = "video_id long, frame_number int, motion double, sharpness double, hash long, cells array<double>, ts timestamp"


def plain(frames, p, b=None):
    """Windows as lists of frames (number, motion, sharpness, hash, cells), written without regard to what state costs."""
    windows, mode, high, low, held = [], "idle", 0, 0, []
    window = anchor = anchored = trial = None
    since = positive = 0
    recent = []

    def restart(cells):
        nonlocal anchor, anchored, trial, since, positive, recent
        anchor, anchored, trial, since, positive, recent = cells, list(window), None, 0, 0, []

    for f in frames:
        if f[1] is None:
            continue
        high, low = (high + 1 if f[1] >= p.enter else 0), (low + 1 if f[1] <= p.exit else 0)
        if mode == "idle":
            if high >= p.enter_frames:
                mode, held, low = "moving", [], 0
        elif mode == "moving":
            if not low:
                held = []
                continue
            held = [*held, f][-p.exit_frames :]
            if low >= p.exit_frames:
                mode, window = "stable", list(held)
                restart(f[4])
        elif high >= p.enter_frames:
            windows.append((window, False))
            mode, held, low = "moving", [], 0
        else:
            window.append(f)
            recent, since = [*recent, f][-max(b.seed, b.interval) :] if b else [], since + 1
            if trial is not None:
                trial.append(f)
            if b and len(window) >= max(b.start, p.min_frames) and since >= b.interval and since % b.interval == 0:
                if sum(abs(x - y) >= b.cell_change for x, y in zip(f[4], anchor, strict=True)) >= b.cells:
                    if positive == 0:
                        trial = list(recent)
                    positive += 1
                    if positive >= b.checks:
                        windows.append((anchored, False))
                        window = trial
                        restart(f[4])
                else:
                    restart(f[4])
    if mode == "stable":
        windows.append((window, True))
    out, accepted = [], []
    for k, (w, eof) in enumerate(windows, 1):
        found = [(w[i][0], round((w[i][1] + w[i + 1][1]) / 2, 6), w[i][2], w[i][3]) for i in range(1, len(w) - 1)]
        calm = [c for c in found if c[1] <= p.candidate_motion]
        best = min(calm, key=lambda c: (c[1], -c[2], c[0])) if calm else min(found, key=lambda c: (round(p.fallback_weight * c[1] - c[2], 6), c[1], -c[2], c[0])) if found else None
        if len(w) < p.min_frames or best is None:
            decision = "rejected_short_stable"
        elif best[2] < p.blur:
            decision = "rejected_blur"
        elif accepted and bin((best[3] ^ accepted[-1][1]) & (1 << 64) - 1).count("1") < p.duplicate_distance:
            decision = "rejected_dedup"
        else:
            decision = "accepted"
            accepted.append((best[0], best[3]))
        review = len(w) < p.low_confidence_frames or eof or bool(found and not calm) or bool(best and best[2] < p.blur)
        out.append((k, w[0][0], w[-1][0], len(w), eof, best and best[0], decision, len(accepted) if decision == "accepted" else None, review))
    return out


COLUMNS = ["segment", "first_frame", "final_frame", "frames", "eof", "frame_number", "decision", "sequence_index", "needs_review"]


def made(seed, n):
    """Videos of still stretches with cuts, some of them silent, flicker, and hashes that come back."""
    rng, out, motion, cells, bits = np.random.default_rng(seed), [], 0.0, np.zeros(16), 0
    for k in range(1, n + 1):
        if rng.random() < 0.09:
            moving = int(rng.integers(1, 5))
        else:
            moving = 0
        motion = float(rng.uniform(12, 30)) if moving or (out and out[-1][1] is not None and out[-1][1] >= 12 and rng.random() < 0.6) else float(rng.choice([0.5, 1.5, 3.0, 5.5, 8.0], p=[0.4, 0.25, 0.2, 0.1, 0.05]))
        if rng.random() < 0.08:  # a silent change, which may go back
            cells = np.where(rng.random(16) < 0.4, rng.integers(0, 60, 16), cells).astype(float)
        if rng.random() < 0.2:
            bits = int(rng.choice([0, 7, 0xFFFF, -1, 1 << 62]))
        out.append((k, None if k == 1 else motion, float(rng.integers(1, 34)), bits, (cells + rng.integers(0, 3, 16)).tolist()))
    return out


@pytest.fixture(scope="module")
def videos():
    return {v: made(v, n) for v, n in ((1, 900), (2, 300), (3, 90), (4, 3))}


@pytest.fixture(scope="module")
def table(spark, videos):
    rows = [(v, *f, 1000 * k) for v, fs in videos.items() for k, f in enumerate(fs)]
    df = spark.createDataFrame([(*r[:-1], None) for r in rows], FRAME).drop("ts")
    return df.withColumn("ts", F.timestamp_seconds(F.col("frame_number") * 10)).repartition(5)


@pytest.mark.parametrize("backstop", [None, SILENT, Backstop(start=4, interval=3, cells=1, checks=1, seed=1)])
def test_sorted_iterator_is_a_plain_run(videos, table, backstop):
    got = {}
    for r in segmentation.tracked(table, SHORT, backstop).orderBy("video_id", "segment").collect():
        got.setdefault(r["video_id"], []).append(tuple(r[c] for c in COLUMNS))
    want = {v: w for v, fs in videos.items() if (w := plain(fs, SHORT, backstop))}
    assert got == want
    if backstop:
        assert want != {v: w for v, fs in videos.items() if (w := plain(fs, SHORT))}  # the backstop does something
    assert {x[6] for w in want.values() for x in w} >= {"accepted", "rejected_blur", "rejected_dedup"}


def test_windows_of_window_functions_are_the_machines(table):
    cols = ["video_id", "segment", "decision", "sequence_index", "frame_number", "needs_review", "duplicate_distance"]
    rows = lambda df: sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    assert rows(segmentation.decisions(table.drop("cells"), SHORT)) == rows(segmentation.tracked(table.drop("cells"), SHORT))


@pytest.mark.parametrize("backstop", [None, SILENT])
def test_stream_of_many_batches_is_a_plain_run(spark, videos, table, backstop):
    """Seven batches cut through windows, trials and anchors; the last video ends by its timer."""
    parts = [table.where(f"frame_number > {a} and frame_number <= {b}") for a, b in ((0, 37), (37, 38), (38, 80), (80, 200), (200, 333), (333, 900))]
    later = spark.createDataFrame([(99, 1, None, 1.0, None, None)], FRAME.removesuffix(", ts timestamp")).withColumn("ts", F.timestamp_seconds(F.lit(10**9)))
    out = in_batches(spark, [*parts, later], lambda s: segments.decision_stream(s, SHORT, backstop, idle=50_000))
    got = {}
    for r in out.orderBy("video_id", "segment").collect():
        got.setdefault(r["video_id"], []).append(tuple(r[c] for c in COLUMNS))
    assert got == {v: w for v, fs in videos.items() if (w := plain(fs, SHORT, backstop))}


def test_a_silent_video_ends_and_its_state_goes(spark, videos, table):
    """Frames after a pause longer than idle are those of a new video: numbered anew."""
    one = table.where("video_id = 1")
    early, late_ = one.where("frame_number <= 200"), one.where("frame_number > 200").withColumn("ts", F.expr("ts + INTERVAL 1 DAY"))
    other = table.where("video_id = 2 and frame_number <= 9").withColumn("ts", F.expr("ts + INTERVAL 5 DAYS"))
    want = sorted(plain(videos[1][:200], SHORT) + plain(videos[1][200:], SHORT))
    for parts in ([early, late_, other], [early, other, late_.withColumn("ts", F.expr("ts + INTERVAL 9 DAYS")), other.withColumn("ts", F.expr("ts + INTERVAL 30 DAYS"))]):
        out = in_batches(spark, parts, lambda s: segments.decision_stream(s, SHORT, idle=3600.0))
        assert sorted(tuple(r[c] for c in COLUMNS) for r in out.where("video_id = 1").collect()) == want


def test_a_change_in_silence_splits_and_flicker_does_not():
    """Eighteen still frames, a slow change of six, eighteen still frames: two cards; small swings of light: one."""
    p, b = Segmentation(blur=0.0), Backstop(start=12, interval=3, cell_change=5.0, cells=2, checks=2, seed=3)
    start = [(k, 60.0, 80.0, None, [0.0] * 16) for k in range(1, 5)]
    still = [(0.0, [100.0] * 16)] * 18
    change = [(1.5, [100.0 + s * 3.0] * 4 + [100.0] * 12) for s in range(1, 7)]
    after = [(0.0, [118.0] * 4 + [100.0] * 12)] * 18
    flicker = [(0.8, [100.0 + x] * 16) for x in (0.0, 0.8, -0.4, 1.0, 0.4, 0.0, 0.6, -0.6, 0.2, 0.5, 0.0, -0.3)]

    def run(rest):
        machine, log = Tracker(p, b), Log(p)
        frames = start + [(k, m, 80.0, None, c) for k, (m, c) in enumerate(rest, 5)]
        found = [log.decided(w) for f in frames for w in machine.push(*f)]
        return found + [log.decided(w) for w in machine.finish()]

    split = run(still + change + after)
    assert [w["decision"] for w in split] == ["accepted", "accepted"] and split[1]["frame_number"] > split[0]["frame_number"]
    assert split[0]["final_frame"] < split[1]["first_frame"]
    assert [w["decision"] for w in run(still + flicker)] == ["accepted"]


def test_cells_may_be_pixels():
    b = Backstop(start=1, interval=1, cells=1, checks=1, seed=1, grid=2)
    machine = Tracker(SHORT, b)
    machine.anchor = np.array([[0, 0], [0, 0]], float).ravel()
    assert not machine._changed(np.array([7.0, 8.0, 0, 0]))  # 7.5 in the mean of the first cell
    assert machine._changed(np.array([0, 0, 9.0, 8.0]))


def test_repeats_with_null_hashes(spark):
    df = spark.createDataFrame([("v", 1, 0), ("v", 2, 1), ("v", 3, None), ("v", 4, 1), ("w", 1, -1), ("w", 2, -1)], "video_id string, segment int, hash long")
    got = [(r["accepted"], r["sequence_index"], r["duplicate_distance"]) for r in segmentation.without_repeats(df, "video_id", "segment", 6).orderBy("video_id", "segment").collect()]
    assert got == [(True, 1, None), (False, None, 1), (True, 2, None), (True, 3, None), (True, 1, None), (False, None, 0)]


def test_local_motion_is_rounded_as_sql_does(spark):
    """Halfway cases of six decimals: the window functions, the machine and SQL put them on the same side."""
    rng = np.random.default_rng(3)
    pairs = [(int(a) / 1e6, int(b) / 1e6) for a, b in rng.integers(0, 20_000_000, (4000, 2))]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a double, b double").orderBy("k")
    want = [duckdb.execute("select round((?::double + ?::double) / 2, 6)", p).fetchone()[0] for p in pairs]
    assert [r[0] for r in df.select(numbers.rounded((F.col("a") + F.col("b")) / 2, 6)).collect()] == want
    assert [tracker.rounded((a + b) / 2) for a, b in pairs] == want


def test_the_best_frame_lies_on_the_rounded_side(spark):
    """The fifth frame's local motion, 1.1130754999... as a double, is 1.113076 to SQL, and so is the sixth's: the sharper one is chosen."""
    motions = [20.0, 20.0, 5.0, 5.0, 1.179424, 1.046727, 1.179425, 5.0, 5.0]
    df = spark.createDataFrame([(1, k, m, 50.0 if k == 6 else 10.0, k) for k, m in enumerate(motions, 1)], "video_id long, frame_number int, motion double, sharpness double, hash long")
    for rows in (segmentation.decisions(df, SHORT), segmentation.tracked(df, SHORT)):
        assert [(r["frame_number"], r["local_motion"], r["decision"]) for r in rows.collect()] == [(6, 1.113076, "accepted")]
