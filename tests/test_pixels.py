"""Measures of pictures against numpy, and hand-made pictures."""

import numpy as np
import pytest
from cardloom.functions import pixels as X
from cardloom.functions.geometry import hamming
from pyspark.sql import functions as F

PX = "k int, px array<array<double>>"


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(1)
    return [rng.integers(0, 256, s).astype(float) for s in ((8, 8), (12, 17), (9, 9), (30, 20), (1, 9), (40, 40))]


@pytest.fixture(scope="module")
def table(spark, pictures):
    return spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(pictures)], PX)


def column(df, c):
    return [r[0] for r in df.orderBy("k").select(c).collect()]


def area(p, w, h):
    """Each pixel spread over a fine grid that both sizes divide."""
    ph, pw = p.shape
    fine = np.repeat(np.repeat(p, h, 0), w, 1)
    return fine.reshape(h, ph, w, pw).mean((1, 3))


def test_sharpness_is_the_variance_of_the_mirrored_laplacian(table, pictures):
    for got, p in zip(column(table, X.sharpness(F.col("px"))), pictures, strict=True):
        q = np.pad(p, 1, mode="reflect") if min(p.shape) > 1 else np.pad(np.pad(p, ((1, 1), (0, 0)), mode="edge"), ((0, 0), (1, 1)), mode="reflect")
        assert got == pytest.approx((q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:] - 4 * p).var())


def test_pictures_shrink_by_area(table, pictures):
    for got, p in zip(column(table, X.shrunk(F.col("px"), 5, 4, whole=False)), pictures, strict=True):
        if min(p.shape[0] // 4, p.shape[1] // 5):
            assert np.allclose(got, area(p, 5, 4))
        else:
            assert got is None
    assert column(table, X.shrunk(F.col("px"), 8, 8))[0] == pictures[0].tolist()


def test_hashes_compare_neighbours(spark, table, pictures):
    for got, p in zip(column(table, X.difference_bits(F.col("px"), 4)), pictures, strict=True):
        small = np.rint(area(p, 5, 4)) if p.shape[0] >= 4 else None
        assert got == (None if small is None else (small[:, 1:] > small[:, :-1]).ravel().tolist())
    ramp = [[float(x * 10) for x in range(18)] for _ in range(16)]
    df = spark.createDataFrame([(0, ramp), (1, [r[::-1] for r in ramp]), (2, [[7.0] * 18] * 16)], PX)
    assert column(df, X.difference_hash(F.col("px"))) == [-1, 0, 0]
    assert column(df, hamming(X.difference_hash(F.col("px")), F.lit(-1).cast("long"))) == [0, 64, 64]


def test_regions_and_grids(table, pictures):
    for got, p in zip(column(table, X.cropped(F.col("px"), 0.2, 0.15, 0.2)), pictures, strict=True):
        h, w = p.shape
        top, low, left = min(h - 1, round(h * 0.15)), h - round(h * 0.2), min(w - 1, round(w * 0.2))
        assert got == p[top : max(top + 1, low), left : max(left + 1, w - round(w * 0.2))].tolist()
    for got, p in zip(column(table, X.cells(F.col("px"))), pictures, strict=True):
        ys, xs = (np.linspace(0, n, 5, dtype=int) for n in p.shape)
        assert got == [p[ys[r] : ys[r + 1], xs[c] : xs[c + 1]].ravel().tolist() for r in range(4) for c in range(4)]
    moved = F.transform("px", lambda row, y: F.transform(row, lambda v, x: v + F.when((y < 2) & (x < 2), 9.0).otherwise(0.0)))
    assert column(table.where("k = 0"), X.changed_cells(F.col("px"), moved, 9.0)) == [1] and column(table.where("k = 0"), X.changed_cells(F.col("px"), moved, 9.5)) == [0]


def test_histograms(table, pictures):
    for got, p in zip(column(table, X.histogram(F.col("px"), 16)), pictures, strict=True):
        n = np.bincount((p.ravel() // 16).astype(int), minlength=16)
        assert np.allclose(got, n / np.sqrt((n * n).sum()))
    same = X.histogram_distance(X.histogram(F.col("px"), 16), X.histogram(F.col("px"), 16))
    assert np.allclose(column(table, same), 0, atol=1e-7)
    assert column(table.where("k = 0"), X.histogram_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == [1.0]


def test_rows_of_frames(table, pictures):
    row = column(table, X.frame_row(F.col("px")))[5]
    assert len(row["roi"]) == 26 and len(row["roi"][0]) == 24 and len(row["cells"]) == 26 * 24 and row["sharpness"] > 0
