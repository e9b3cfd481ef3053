"""Measures of points, lines and rings as Column expressions; a line or ring is an array of structs (x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def _steps(line: Column) -> Column:
    """Pairs of consecutive points."""
    return F.arrays_zip(F.slice(line, 1, F.size(line) - 1).alias("a"), F.slice(line, 2, F.size(line) - 1).alias("b"))


def length(line: Column) -> Column:
    """Length of a line; 0 for fewer than two points."""
    total = F.aggregate(_steps(line), F.lit(0.0), lambda s, p: s + distance(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))
    return F.when(F.size(line) < 2, 0.0).otherwise(total)


def area(ring: Column) -> Column:
    """Area inside a closed ring (first point = last point), by the shoelace formula."""
    twice = F.aggregate(_steps(ring), F.lit(0.0), lambda s, p: s + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]))
    return F.when(F.size(ring) < 4, 0.0).otherwise(F.abs(twice) / 2)


def centroid(ring: Column) -> tuple[Column, Column]:
    """(x, y) of the middle of the area inside a closed ring; of a ring without an area, the mean of its corners. Nulls for fewer than two points."""
    o = ring[0]
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, p: Column) -> Column:
        ax, ay, bx, by = p["a"]["x"] - o["x"], p["a"]["y"] - o["y"], p["b"]["x"] - o["x"], p["b"]["y"] - o["y"]
        w = ax * by - bx * ay
        return F.struct((s["a"] + w).alias("a"), (s["x"] + (ax + bx) * w).alias("x"), (s["y"] + (ay + by) * w).alias("y"))

    total = F.aggregate(_steps(ring), start, add)
    mean = lambda axis: F.aggregate(F.slice(ring, 1, F.size(ring) - 1), F.lit(0.0), lambda s, p: s + p[axis]) / (F.size(ring) - 1)
    middle = lambda axis: F.when(F.size(ring) > 1, F.coalesce(o[axis] + F.try_divide(total[axis], 3 * total["a"]), mean(axis)))
    return middle("x"), middle("y")


def extension(line: Column) -> Column:
    """Distance between the ends of a line."""
    a, b = F.element_at(line, 1), F.element_at(line, -1)
    return distance(a["x"], a["y"], b["x"], b["y"])


def linearity(line: Column) -> Column:
    return F.try_divide(extension(line), length(line))


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)), F.lit(360.0))


def compactness(perimeter: Column, area: Column, height: Column) -> Column:
    """(P h + A) / (A h)^(2/3)."""
    return F.try_divide(perimeter * height + area, F.pow(area * height, F.lit(2 / 3)))


def fractal_dimension(perimeter: Column, area: Column) -> Column:
    """2 ln(P / 4) / ln A."""
    return F.try_divide(2 * F.ln(perimeter / 4), F.ln(area))


def hex_cell(x: Column, y: Column, size: float) -> Column:
    """``q:r`` of the pointy-top hexagon of circumradius ``size`` around (x, y), by cube rounding. Not an H3 index."""
    q, r = (math.sqrt(3) / 3 * x - y / 3) / size, (2 / 3 * y) / size
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    cq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    cr = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return F.concat_ws(":", cq.cast("string"), cr.cast("string"))


def hex_corners(cell: Column, size: float) -> Column:
    """The six corners of a cell of hex_cell, then the first again."""
    q, r = (F.element_at(F.split(cell, ":"), k).cast("double") for k in (1, 2))
    x, y = size * math.sqrt(3) * (q + r / 2), size * 1.5 * r
    corner = lambda k: F.struct((x + size * math.cos(math.radians(60 * k - 30))).alias("x"), (y + size * math.sin(math.radians(60 * k - 30))).alias("y"))
    return F.array(*[corner(k % 6) for k in range(7)])


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a closed ring, by ray casting; points on a right or top edge are outside."""
    crosses = F.aggregate(
        _steps(ring),
        F.lit(0),
        lambda n, p: n + F.when(((p["a"]["y"] > y) != (p["b"]["y"] > y)) & (x < (p["b"]["x"] - p["a"]["x"]) * F.try_divide(y - p["a"]["y"], p["b"]["y"] - p["a"]["y"]) + p["a"]["x"]), 1).otherwise(0),
    )
    return crosses % 2 == 1


def to_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(x, y, x1 + t * dx, y1 + t * dy)
