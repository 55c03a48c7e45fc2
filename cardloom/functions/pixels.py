"""Measures of small pictures as column expressions. A picture is array<array<double>>: rows of gray values from 0 to 255.

Pictures of equal rows are expected; null pictures give null. Sizes are those of thumbnails: every function looks at each pixel a
bounded number of times, but inside its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let


def height(px: Column) -> Column:
    return F.size(px)


def width(px: Column) -> Column:
    return F.size(px[0])


def pixels(px: Column) -> Column:
    return F.flatten(px)


def _sum(values: Column, of: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + of(v))


def _mirrored(i: Column, n: Column) -> Column:
    """An index beyond either end, mirrored at the last one."""
    return F.when(n == 1, 0).when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)


def laplacian(px: Column) -> Column:
    """The sum of each pixel's four neighbours less four times itself, as one array; edges are mirrored at the last pixel."""

    def of(h: Column, w: Column) -> Column:
        return F.flatten(F.transform(px, lambda row, y: F.transform(row, lambda v, x: px[_mirrored(y - 1, h)][x] + px[_mirrored(y + 1, h)][x] + row[_mirrored(x - 1, w)] + row[_mirrored(x + 1, w)] - 4 * v)))

    return of(height(px), width(px))


def variance(values: Column) -> Column:
    """Of all values, over their number."""
    return let(values, lambda vs: let(_sum(vs) / F.size(vs), lambda m: _sum(vs, lambda v: (v - m) * (v - m)) / F.size(vs)))


def sharpness(px: Column) -> Column:
    """Variance of the Laplacian: high where a picture is in focus."""
    return variance(laplacian(px))


def cropped(px: Column, x: float, top: float, bottom: float) -> Column:
    """Without margins, which are shares of the size; at least one pixel stays."""
    h, w = height(px), width(px)
    margin = lambda n, share: F.rint(n * F.lit(share)).cast("int")
    left, high = F.least(w - 1, F.greatest(margin(w, x), F.lit(0))), F.least(h - 1, F.greatest(margin(h, top), F.lit(0)))
    right, low = F.greatest(left + 1, F.least(w, w - margin(w, x))), F.greatest(high + 1, F.least(h, h - margin(h, bottom)))
    return F.transform(F.slice(px, high + 1, low - high), lambda row: F.slice(row, left + 1, right - left))


def _shrunk(values: Column, n: Column, to: int) -> Column:
    """An array of ``n`` values averaged to ``to`` of them, each over the stretch that it stands for, parts of values included."""
    size = n / F.lit(float(to))
    part = lambda i, a, b: F.greatest(F.least(i + 1.0, b) - F.greatest(i.cast("double"), a), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(to - 1)), lambda j: _sum(F.transform(values, lambda v, i: v * part(i, j * size, (j + 1) * size))) / size)


def shrunk(px: Column, w: int, h: int, whole: bool = True) -> Column:
    """The picture averaged over areas to ``w`` by ``h`` pixels, which it must have at least; as whole gray values, halves to even."""
    rows = F.transform(px, lambda row: _shrunk(row, F.size(row), w))
    columns = F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda x: _shrunk(F.transform(rows, lambda r: r[x]), height(px), h))
    out = let(columns, lambda cs: F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.transform(cs, lambda c: F.rint(c[y]) if whole else c[y])))
    return F.when((width(px) >= w) & (height(px) >= h), out)


def difference_bits(px: Column, n: int = 8) -> Column:
    """Whether each pixel of the picture shrunk to n + 1 by n is darker than the one right of it: n * n flags, row by row."""
    return F.flatten(F.transform(shrunk(px, n + 1, n), lambda row: F.zip_with(F.slice(row, 2, n), F.slice(row, 1, n), lambda b, a: b > a)))


def packed(flags: Column) -> Column:
    """Up to 64 flags as the bits of a long, the first the highest."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))


def difference_hash(px: Column) -> Column:
    """The 64 bits of ``difference_bits`` as a long, for ``hamming``."""
    return packed(difference_bits(px, 8))


def _edges(n: Column, parts: int) -> list[Column]:
    return [F.floor(n * F.lit(i) / F.lit(float(parts))).cast("int") for i in range(parts + 1)]


def cells(px: Column, rows: int = 4, cols: int = 4) -> Column:
    """The pixels of each cell of a grid, cell after cell: array<array<double>>."""
    ys, xs = _edges(height(px), rows), _edges(width(px), cols)
    cell = lambda r, c: F.flatten(F.transform(F.slice(px, ys[r] + 1, ys[r + 1] - ys[r]), lambda row: F.slice(row, xs[c] + 1, xs[c + 1] - xs[c])))
    return F.array(*[cell(r, c) for r in range(rows) for c in range(cols)])


def changed_cells(a: Column, b: Column, least: float, rows: int = 4, cols: int = 4) -> Column:
    """In how many cells of a grid the mean absolute difference of two pictures reaches ``least``."""
    mean = lambda x, y: _sum(F.zip_with(x, y, lambda u, v: F.abs(u - v))) / F.size(x)
    return F.size(F.filter(F.zip_with(cells(a, rows, cols), cells(b, rows, cols), mean), lambda m: m >= least))


def histogram(px: Column, bins: int = 256) -> Column:
    """Counts of gray values in ``bins`` of equal width, over the root of the sum of their squares."""
    at = F.transform(pixels(px), lambda v: F.least(F.floor(v * F.lit(bins / 256.0)), F.lit(bins - 1)).cast("int"))
    counts = let(at, lambda vs: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(vs, lambda v: v == k)).cast("double")))
    return let(counts, lambda cs: let(F.sqrt(_sum(cs, lambda c: c * c)), lambda n: F.transform(cs, lambda c: c / n)))


def histogram_distance(a: Column, b: Column) -> Column:
    """Bhattacharyya distance of two histograms: 0 for equal ones, 1 for those that share no bin."""
    shared = _sum(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    return F.when(shared.isNotNull(), F.sqrt(F.greatest(F.lit(1.0) - shared / F.sqrt(_sum(a) * _sum(b)), F.lit(0.0))))


def frame_row(px: Column, x: float = 0.20, top: float = 0.15, bottom: float = 0.20) -> Column:
    """struct<roi, sharpness, hash, cells> of a frame: its inner region, that region's sharpness and hash, and its grid of pixels."""
    return let(cropped(px, x, top, bottom), lambda roi: F.struct(roi.alias("roi"), sharpness(roi).alias("sharpness"), difference_hash(roi).alias("hash"), F.flatten(cells(roi)).alias("cells")))
