"""Vector and geometry expressions. Values are computed in double precision, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector by its length; a vector of length zero stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def usable(a: Column, dims: int | None = None) -> Column:
    """Not null, of the length asked for, all values finite, not all zero."""
    ok = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(a, lambda x: x != 0)
    return F.coalesce(ok & ((F.size(a) == dims) if dims else (F.size(a) > 0)), F.lit(False))


def overlap(a: Column, b: Column, stored_area: bool = False) -> Column:
    """Intersection over union of two boxes (structs y1, x1, y2, x2[, area]); 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    inter = side("y1", "y2") * side("x1", "x2")
    area = (lambda v: v["area"]) if stored_area else (lambda v: F.greatest(v["y2"] - v["y1"], F.lit(0.0)) * F.greatest(v["x2"] - v["x1"], F.lit(0.0)))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def kept_boxes(boxes: Column, threshold: float) -> Column:
    """Greedy suppression over an ordered array of boxes: one is kept if it overlaps no kept box by more than threshold."""
    empty = F.slice(boxes, 1, 0)
    return F.aggregate(boxes, empty, lambda kept, b: F.when(F.exists(kept, lambda k: overlap(k, b) > threshold), kept).otherwise(F.array_append(kept, b)))


def horizontal_region(x: Column) -> Column:
    return F.when(x < 0.33, "left").when(x < 0.66, "center").when(x.isNotNull(), "right")


def vertical_region(y: Column) -> Column:
    return F.when(y < 0.33, "top").when(y < 0.66, "middle").when(y.isNotNull(), "bottom")


def valid_box(y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    return F.coalesce((y1 >= 0) & (y1 <= y2) & (y2 <= 1) & (x1 >= 0) & (x1 <= x2) & (x2 <= 1), F.lit(False))


def interval_distance(x: Column, start: Column, end: Column) -> Column:
    """0 inside the interval, else the distance to its nearer end."""
    return F.greatest(start - x, x - end, F.lit(0.0))
