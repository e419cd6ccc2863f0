"""Boxes as Column expressions: a box is an array of up to four [x, y] points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(box: Column, scale_x: Column, scale_y: Column) -> Column:
    """Points divided by the scales; an empty array where that can't be done."""
    points = F.transform(F.slice(box, 1, 4), lambda p: F.array(F.try_divide(F.get(p, 0), scale_x), F.try_divide(F.get(p, 1), scale_y)))
    whole = F.forall(points, lambda p: F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull())
    return F.when(box.isNotNull() & whole, points).otherwise(F.array().cast("array<array<double>>"))


def _axis(box: Column, at: int) -> Column:
    return F.transform(F.slice(box, 1, 4), lambda p: F.get(p, at))


def centre(box: Column) -> Column:
    """Mean of the points; (0, 0) where there are none."""

    def mean(at: int) -> Column:
        axis = _axis(box, at)
        return F.coalesce(F.try_divide(F.aggregate(axis, F.lit(0.0), lambda s, v: s + v), F.size(axis)), F.lit(0.0))

    return F.struct(mean(0).alias("x"), mean(1).alias("y"))


def dimensions(box: Column) -> Column:
    def extent(at: int) -> Column:
        axis = _axis(box, at)
        return F.coalesce(F.array_max(axis) - F.array_min(axis), F.lit(0.0))

    return F.struct(extent(0).alias("w"), extent(1).alias("h"))


def extent(box: Column) -> Column:
    """Edges, mid-points, and width and height of one at least; null for fewer than four points."""
    x, y = _axis(box, 0), _axis(box, 1)
    left, right, top, bottom = F.array_min(x), F.array_max(x), F.array_min(y), F.array_max(y)
    return F.when(
        F.size(box) >= 4,
        F.struct(
            left.alias("left"), right.alias("right"), top.alias("top"), bottom.alias("bottom"), ((left + right) / 2).alias("x"), ((top + bottom) / 2).alias("y"),
            F.greatest(F.lit(1.0), right - left).alias("w"), F.greatest(F.lit(1.0), bottom - top).alias("h"),
        ),
    )


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of the axis-parallel boxes; 0 where there is no area."""

    def edges(box: Column) -> tuple[Column, ...]:
        x, y = _axis(box, 0), _axis(box, 1)
        return F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)

    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = edges(a), edges(b)
    zero = F.lit(0.0)
    common = F.greatest(zero, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(zero, F.least(ay1, by1) - F.greatest(ay0, by0))
    area = F.greatest(zero, ax1 - ax0) * F.greatest(zero, ay1 - ay0) + F.greatest(zero, bx1 - bx0) * F.greatest(zero, by1 - by0) - common
    return F.coalesce(F.when(area > 0, common / area), zero)


def centre_distance(a: Column, b: Column) -> Column:
    p, q = centre(a), centre(b)
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def relative_distance(a: Column, b: Column) -> Column:
    """Distance of mid-points over the larger height, 20 at least; 9999 where an extent is missing."""
    scale = F.greatest(F.lit(20.0), a["h"], b["h"])
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.when(a.isNotNull() & b.isNotNull(), F.sqrt(dx * dx + dy * dy) / scale).otherwise(F.lit(9999.0))


def same_region(a: Column, b: Column, dy: float = 55, dx: float = 500) -> Column:
    near = (F.abs(a["y"] - b["y"]) <= dy) & (F.abs(a["x"] - b["x"]) <= dx)
    return F.coalesce(near, F.lit(False))


def height_or(a: Column, default: float = 20.0) -> Column:
    return F.coalesce(a["h"], F.lit(default))
