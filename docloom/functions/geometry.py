"""Rectangles as columns: structs (x, y, w, h) of doubles, y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def normalized(r: Column) -> Column:
    """Negative extents turned over."""
    return rect(F.least(r["x"], r["x"] + r["w"]), F.least(r["y"], r["y"] + r["h"]), F.abs(r["w"]), F.abs(r["h"]))


def clamped(r: Column) -> Column:
    """The part inside the unit square."""
    left, top = F.greatest(r["x"], F.lit(0.0)), F.greatest(r["y"], F.lit(0.0))
    right, bottom = F.least(r["x"] + r["w"], F.lit(1.0)), F.least(r["y"] + r["h"], F.lit(1.0))
    return rect(left, top, F.greatest(right - left, F.lit(0.0)), F.greatest(bottom - top, F.lit(0.0)))


def expanded(r: Column, dx: float, dy: float) -> Column:
    return rect(r["x"] - dx, r["y"] - dy, r["w"] + 2 * dx, r["h"] + 2 * dy)


def scaled(r: Column, width: Column, height: Column) -> Column:
    return rect(r["x"] * width, r["y"] * height, r["w"] * width, r["h"] * height)


def overlap(a: Column, b: Column) -> Column:
    """Area that two rectangles share."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def intersects(a: Column, b: Column) -> Column:
    return overlap(a, b) > 0


def contains(a: Column, x: Column, y: Column) -> Column:
    return (x >= a["x"]) & (x <= a["x"] + a["w"]) & (y >= a["y"]) & (y <= a["y"] + a["h"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area by the area of the smaller one; 0 for an empty one."""
    smaller = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when(smaller > 0, overlap(a, b) / smaller).otherwise(0.0)


def union_all(r: Column) -> Column:
    """Aggregate: the rectangle around all."""
    x, y = F.min(r["x"]), F.min(r["y"])
    return rect(x, y, F.max(r["x"] + r["w"]) - x, F.max(r["y"] + r["h"]) - y)
