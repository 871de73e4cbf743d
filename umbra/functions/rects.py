"""Rectangles as structs: points, origin top left, y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def inflate(r: Column, by: float) -> Column:
    return rect(r["x"] - by, r["y"] - by, r["w"] + 2 * by, r["h"] + 2 * by)


def scale(r: Column, by: float) -> Column:
    return rect(r["x"] * by, r["y"] * by, r["w"] * by, r["h"] * by)


def intersects(a: Column, b: Column) -> Column:
    """Strictly: shared edges don't count."""
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def shared_area(a: Column, b: Column) -> Column:
    width = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    height = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def union_of(rects: Column) -> Column:
    """The smallest rectangle around an array of rectangles; null for none."""
    left, top = F.array_min(F.transform(rects, lambda r: r["x"])), F.array_min(F.transform(rects, lambda r: r["y"]))
    right, bottom = F.array_max(F.transform(rects, lambda r: r["x"] + r["w"])), F.array_max(F.transform(rects, lambda r: r["y"] + r["h"]))
    return F.when(F.size(rects) > 0, rect(left, top, right - left, bottom - top))


def rotated(r: Column, rotation: Column, page_w: Column, page_h: Column) -> Column:
    """A rectangle of an unrotated page as it lies after the page's rotation by quarter turns; other angles leave it."""
    return (
        F.when(rotation == 90, rect(page_h - r["y"] - r["h"], r["x"], r["h"], r["w"]))
        .when(rotation == 180, rect(page_w - r["x"] - r["w"], page_h - r["y"] - r["h"], r["w"], r["h"]))
        .when(rotation == 270, rect(r["y"], page_w - r["x"] - r["w"], r["h"], r["w"]))
        .otherwise(r)
    )
