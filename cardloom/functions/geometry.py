"""Boxes, distances of arrays and bit strings on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes [x1, y1, x2, y2]."""
    side = lambda i, j: F.greatest(F.least(a[j], b[j]) - F.greatest(a[i], b[i]), F.lit(0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return let((side(0, 2) * side(1, 3)).cast("double"), lambda both: F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0)))


def meet(a: Column, b: Column) -> Column:
    """Whether two boxes share an area."""
    return (a[0] < b[2]) & (a[1] < b[3]) & (a[2] > b[0]) & (a[3] > b[1])


def around(boxes: Column) -> Column:
    """The box around all boxes; null if there are none."""
    edge = lambda i, of: of(F.transform(boxes, lambda b: b[i]))
    return F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max))


def within_reach(words: Column, boxes: Column) -> Column:
    """array<struct<bbox, i, confidence>> of the words that share an area with the box around all boxes: no other can match one of them."""
    return let(around(boxes), lambda box: F.filter(F.transform(words, lambda w, i: F.when(meet(box, w["bbox"]), F.struct(w["bbox"].alias("bbox"), i.alias("i"), w["confidence"].alias("confidence")))), lambda w: w.isNotNull()))


def best_match(box: Column, near: Column, least: float = 0.3) -> Column:
    """struct<iou, at, confidence> of the word (of ``within_reach``) that covers a box best; the first on ties."""
    scored = F.transform(F.filter(near, lambda w: meet(box, w["bbox"])), lambda w: F.struct(iou(box, w["bbox"]).alias("iou"), (-w["i"]).alias("at"), w["confidence"].alias("confidence")))
    return let(F.array_max(scored), lambda top: F.when(top["iou"] >= least, F.struct(top["iou"].alias("iou"), (-top["at"]).alias("at"), top["confidence"].alias("confidence"))))


def in_band(words: Column, y0: Column, y1: Column) -> Column:
    """Words that overlap a band of heights, by their left edges."""
    return by_left(F.filter(words, lambda w: ~((w["bbox"][3] < y0) | (w["bbox"][1] > y1))))


def right_of(words: Column, anchor: Column, margin: int, xmax: int) -> Column:
    """Words to the right of an anchor box in its band of heights, up to ``xmax``."""
    return by_left(F.filter(words, lambda w: (w["bbox"][0] >= anchor[2]) & (w["bbox"][0] <= xmax) & ~((w["bbox"][3] < anchor[1] - margin) | (w["bbox"][1] > anchor[3] + margin))))


def by_left(words: Column) -> Column:
    keyed = F.transform(words, lambda w, i: F.struct(w["bbox"][0].alias("x"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda k: k["w"])


def nearest_height(words: Column, y: Column, most: int) -> Column:
    """The word whose middle is nearest to a height, within a tolerance; the first on ties."""
    near = F.transform(words, lambda w, i: F.struct(F.abs((w["bbox"][1] + w["bbox"][3]) / F.lit(2.0) - y).alias("d"), i.alias("i"), w.alias("w")))
    best = F.array_min(F.filter(near, lambda k: k["d"] <= most))
    return best["w"]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(v: Column) -> Column:
    """The signs of 64 numbers as the bits of a long."""
    return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR((x > 0).cast("long")))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of equal length; null where one is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)
