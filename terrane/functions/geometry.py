"""Geometry as Column expressions. A ring is a closed array<struct<x,y>>, a polygon an array of rings (the outer first)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, km2

RING = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def unit_square(x, y, size: float = 1.0) -> Column:
    x, y = col(x).cast("double"), col(y).cast("double")
    return F.array(*(point(x + a, y + b) for a, b in ((0, 0), (size, 0), (size, size), (0, size), (0, 0))))


def once(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it; a plain expression is computed anew at each place."""
    return F.transform(F.array(value), f)[0]


def pairs(ring) -> Column:
    """Edges of a closed ring: struct<a,b> of neighbouring points."""
    def edges(r):
        n = F.size(r) - 1
        return F.when(n > 0, F.zip_with(F.slice(r, 1, n), F.slice(r, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))

    return once(col(ring), edges)


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda t, e: t + f(e))


def ring_area(ring) -> Column:
    """Signed area; positive for counter-clockwise rings (y up)."""
    return _sum(pairs(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def polygon_area(polygon) -> Column:
    """Outer ring less holes."""
    areas = F.transform(col(polygon), lambda r, i: F.abs(ring_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0))
    return F.aggregate(areas, F.lit(0.0), lambda t, a: t + a)


def perimeter(ring) -> Column:
    return _sum(pairs(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def compactness(ring) -> Column:
    """4 pi area / perimeter squared: 1 for a circle."""
    return once(perimeter(ring), lambda p: F.when(p > 0, 4 * math.pi * F.abs(ring_area(ring)) / (p * p)).otherwise(0.0))


def centroid(ring) -> Column:
    """Area centroid; the middle of the bounds for a ring without area."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    a = ring_area(ring)
    cx = _sum(pairs(ring), lambda e: (e["a"]["x"] + e["b"]["x"]) * cross(e)) / (6 * a)
    cy = _sum(pairs(ring), lambda e: (e["a"]["y"] + e["b"]["y"]) * cross(e)) / (6 * a)
    b = bbox(ring)
    return F.when(F.abs(a) > 1e-12, point(cx, cy)).otherwise(point((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2))


def bbox(ring) -> Column:
    xs, ys = (F.transform(col(ring), _field(k)) for k in ("x", "y"))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _field(name: str):
    return lambda p: p[name]


def bbox_area(ring) -> Column:
    b = bbox(ring)
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def wound(ring, clockwise: bool = True) -> Column:
    """The ring turned the given way (outer rings are clockwise, y up)."""
    a = ring_area(ring)
    return F.when((a > 0) if clockwise else (a < 0), F.reverse(col(ring))).otherwise(col(ring))


def inside(x, y, ring) -> Column:
    """Even-odd test, half-open at the lower end of each edge."""
    px, py = col(x), col(y)

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.aggregate(pairs(ring), F.lit(False), lambda t, e: t != F.coalesce(crosses(e), F.lit(False)))


def inside_polygon(x, y, polygon) -> Column:
    """In the outer ring and in no hole."""
    return F.aggregate(F.transform(col(polygon), lambda r: inside(x, y, r)), F.lit(False), lambda t, v: t != v)


def corner_cut(ring) -> Column:
    """One pass of Chaikin smoothing of a closed ring."""
    def two(e):
        a, b = e["a"], e["b"]
        return F.array(point(a["x"] * 0.75 + b["x"] * 0.25, a["y"] * 0.75 + b["y"] * 0.25), point(a["x"] * 0.25 + b["x"] * 0.75, a["y"] * 0.25 + b["y"] * 0.75))

    open_ring = F.flatten(F.transform(pairs(ring), two))
    return F.concat(open_ring, F.slice(open_ring, 1, 1))


def decimate(ring, eps: float) -> Column:
    """Keeps a point if it is at least eps from the last one kept; the first and last points stay.

    Rings of fewer than 5 points, and those of which fewer than 4 would stay, are left as they are.
    """
    r = col(ring)
    empty = F.array().cast(RING)

    def step(kept, p):
        last = F.element_at(kept, -1)
        return F.when((F.size(kept) == 0) | (F.hypot(p["x"] - last["x"], p["y"] - last["y"]) >= eps), F.concat(kept, F.array(p))).otherwise(kept)

    kept = F.concat(F.aggregate(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), empty, step), F.slice(r, -1, 1))
    return F.when((F.size(r) < 5) | (F.size(kept) < 4), r).otherwise(kept)


def rounded(ring, digits: int) -> Column:
    return F.transform(col(ring), lambda p: point(F.bround(p["x"], digits), F.bround(p["y"], digits)))


def moved(ring, dx: float, dy: float, sx: float = 1.0, sy: float = 1.0) -> Column:
    """Scaled, then moved."""
    return F.transform(col(ring), lambda p: point(p["x"] * sx + dx, p["y"] * sy + dy))


def turned_parts(polygon, width: float = 360.0) -> Column:
    """Rings moved by whole turns so that their middle lies in -180..180."""
    def one(r):
        b = bbox(r)
        middle = (b["x0"] + b["x1"]) / 2
        shift = F.when(middle > width / 2, -width).when(middle < -width / 2, width).otherwise(0.0)
        return F.transform(r, lambda p: point(p["x"] + shift, p["y"]))

    return F.transform(col(polygon), one)


def clean_ring(ring, digits: int = 7) -> Column:
    """Points on a grid, repeated neighbours dropped; null if fewer than four points or no area are left."""
    r = rounded(ring, digits)
    empty = F.array().cast(RING)
    out = F.aggregate(r, empty, lambda kept, p: F.when((F.size(kept) > 0) & (F.element_at(kept, -1) == p), kept).otherwise(F.concat(kept, F.array(p))))
    return once(out, lambda o: F.when((F.size(o) >= 4) & (F.abs(ring_area(o)) > 1e-12), o))


def is_needle(ring, least: float = 1e-5, thin_area: float = 0.006, thinness: float = 0.07) -> Column:
    """Rings too small or too thin to show."""
    return once(col(ring), lambda r: once(F.abs(ring_area(r)), lambda a: (a <= least) | ((a < thin_area) & (compactness(r) < thinness))))


def shown_on_coast(ring) -> Column:
    """Coast rings worth drawing, in screen units."""
    return once(col(ring), lambda r: once(F.abs(ring_area(r)), lambda a: ~((a < 3) | ((compactness(r) < 0.06) & (a < 80)))))


def area_km2(ring) -> Column:
    return km2(F.abs(ring_area(ring)), centroid(ring)["y"])


def parse_path(path) -> Column:
    """Rings of an SVG path of M, L and Z commands; parts of fewer than three points are dropped."""
    parts = F.split(F.regexp_replace(col(path), "[Zz]", ""), "[Mm]")
    numbers = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"-?\d+(?:\.\d+)?"), 0), lambda v: v.cast("double"))

    def open_ring(v):
        n = F.floor(F.size(v) / 2).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(v[2 * i], v[2 * i + 1])))

    def ring(s):
        return once(once(numbers(s), open_ring), lambda o: F.concat(o, F.slice(o, 1, 1)))

    return F.filter(F.transform(parts, ring), lambda r: r.isNotNull() & (F.size(r) > 3))


def path_text(polygon) -> Column:
    """SVG path with one decimal."""
    one = lambda r: F.concat(F.lit("M"), F.array_join(F.transform(F.slice(r, 1, F.size(r) - 1), lambda p: F.format_string("%.1f,%.1f", p["x"], p["y"])), "L"), F.lit("Z"))
    return F.array_join(F.transform(col(polygon), one), "")


def picks_projection(x0, y0, x1, y1) -> Column:
    """geographic where all bounds are degrees, else planar."""
    return F.when((col(x0) >= -180.5) & (col(x1) <= 180.5) & (col(y0) >= -90.5) & (col(y1) <= 90.5), "geographic").otherwise("planar")


def mean_inside(line, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Whether the mean of a line's points lies inside a window, rims left out; a line without points does not."""
    p, n = col(line), F.size(col(line))
    mean = lambda k: F.try_divide(F.aggregate(p, F.lit(0.0), lambda t, q: t + q[k]), n)
    return F.coalesce((mean("x") > x0) & (mean("x") < x1) & (mean("y") > y0) & (mean("y") < y1), F.lit(False))
