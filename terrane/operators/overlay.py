"""Union, intersection and difference of polygons, and what is built on them: spatial joins by area, cuts and drawing.

A polygon is a list of closed rings with its inside on the left: outer rings counter-clockwise,
holes clockwise. Edges of both polygons are split where they meet, each part is kept or dropped by
the side of the other polygon on which its middle lies, and the kept parts are traced to rings.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shapes import Point, area

Polygon = list[list[Point]]
DIGITS = 9
LEAST = 1e-12
POLYGON = "array<array<struct<x:double,y:double>>>"


def trace(starts: list, ends: list) -> list[list[tuple]]:
    """Closed rings from directed edges; at a crossing the sharpest left turn is taken, so rings touch but don't cross."""
    leaving = defaultdict(list)
    for a, b in zip(starts, ends, strict=True):
        leaving[a].append(b)
    rings = []
    for first in sorted(leaving):
        while leaving[first]:
            ring, at = [first], leaving[first].pop()
            before = first
            while at != first and leaving[at]:
                ring.append(at)
                dx, dy = at[0] - before[0], at[1] - before[1]
                turn = lambda p, at=at, dx=dx, dy=dy: _angle(dx, dy, p[0] - at[0], p[1] - at[1])
                best = max(leaving[at], key=turn)
                leaving[at].remove(best)
                before, at = at, best
            rings.append([*ring, first])
    return rings


def _angle(dx, dy, ex, ey) -> float:
    return math.atan2(dx * ey - dy * ex, dx * ex + dy * ey)


def oriented(rings: Polygon) -> Polygon:
    """Rings turned by how many others hold them; snapped to the grid."""
    snapped = [[(round(x, DIGITS), round(y, DIGITS)) for x, y in r] for r in rings if len(r) > 3]
    out = []
    for i, r in enumerate(snapped):
        depth = sum(j != i and _holds(other, _inner(r)) for j, other in enumerate(snapped))
        out.append(r if (area(r) > 0) == (depth % 2 == 0) else r[::-1])
    return [r for r in out if abs(area(r)) > LEAST]


def _inner(ring: list[Point]) -> Point:
    """A point just inside a ring, beside the middle of its longest edge."""
    p, q = max(zip(ring[:-1], ring[1:], strict=True), key=lambda e: math.dist(*e))
    size, side = math.dist(p, q) or 1.0, 1e-7 if area(ring) > 0 else -1e-7
    return (p[0] + q[0]) / 2 - (q[1] - p[1]) / size * side, (p[1] + q[1]) / 2 + (q[0] - p[0]) / size * side


def _holds(ring: list[Point], p: Point) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
        if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def inside(polygon: Polygon, p: Point) -> bool:
    return sum(_holds(r, p) for r in polygon) % 2 == 1


def _edges(polygon: Polygon) -> list[tuple[Point, Point]]:
    return [(p, q) for r in polygon for p, q in zip(r[:-1], r[1:], strict=True) if p != q]


def _meet(p: Point, q: Point, a: Point, b: Point) -> Iterator[Point]:
    """Points of the edge pq where the edge ab meets it."""
    dx, dy, ex, ey = q[0] - p[0], q[1] - p[1], b[0] - a[0], b[1] - a[1]
    cross = dx * ey - dy * ex
    if abs(cross) > 1e-14:
        s = ((a[0] - p[0]) * ey - (a[1] - p[1]) * ex) / cross
        t = ((a[0] - p[0]) * dy - (a[1] - p[1]) * dx) / cross
        if -1e-12 <= s <= 1 + 1e-12 and -1e-12 <= t <= 1 + 1e-12:
            yield p[0] + s * dx, p[1] + s * dy
    else:
        size = dx * dx + dy * dy
        for c in (a, b):
            if abs((c[0] - p[0]) * dy - (c[1] - p[1]) * dx) <= 1e-9 * math.sqrt(size) and 0 < (c[0] - p[0]) * dx + (c[1] - p[1]) * dy < size:
                yield c


def _split(edges: list, others: list) -> list[tuple[Point, Point]]:
    out = []
    for p, q in edges:
        x0, x1, y0, y1 = min(p[0], q[0]), max(p[0], q[0]), min(p[1], q[1]), max(p[1], q[1])
        near = [(a, b) for a, b in others if min(a[0], b[0]) <= x1 and max(a[0], b[0]) >= x0 and min(a[1], b[1]) <= y1 and max(a[1], b[1]) >= y0]
        cuts = {(round(x, DIGITS), round(y, DIGITS)) for a, b in near for x, y in _meet(p, q, a, b)} | {p, q}
        line = sorted(cuts, key=lambda c, p=p: (c[0] - p[0]) ** 2 + (c[1] - p[1]) ** 2)
        out += zip(line[:-1], line[1:], strict=True)
    return out


def overlay(left: Polygon, right: Polygon, kind: str) -> Polygon:
    """`union`, `intersection` or `difference` of two polygons."""
    a, b = oriented(left), oriented(right)
    ea, eb = _edges(a), _edges(b)
    sa, sb = _split(ea, eb), _split(eb, ea)
    set_a, set_b = set(sa), set(sb)
    middle = lambda e: ((e[0][0] + e[1][0]) / 2, (e[0][1] + e[1][1]) / 2)
    turned = lambda e: (e[1], e[0])
    inner = kind == "intersection"
    kept = []
    for e in sa:
        if e in set_b:
            kept += [e] * (kind != "difference")
        elif turned(e) in set_b:
            kept += [e] * (kind == "difference")
        elif inside(b, middle(e)) == inner:
            kept.append(e)
    for e in sb:
        if e not in set_a and turned(e) not in set_a and inside(a, middle(e)) == (kind != "union"):
            kept.append(turned(e) if kind == "difference" else e)
    kept = list(dict.fromkeys(kept))
    rings = trace([p for p, _ in kept], [q for _, q in kept])
    return [r for r in rings if len(r) > 3 and r[0] == r[-1] and abs(area(r)) > LEAST]


def size(polygon: Polygon) -> float:
    return sum(area(r) for r in polygon)


def polyline_cut(polygon: Polygon, line: list[Point], half_width: float = 0.012) -> list[Polygon]:
    """Parts left after a strip along a line is taken out; each outer ring is a part of its own."""
    rest = polygon
    for p, q in zip(line[:-1], line[1:], strict=True):
        length = math.dist(p, q)
        if length:
            ux, uy = (q[0] - p[0]) / length * half_width, (q[1] - p[1]) / length * half_width
            strip = [(p[0] - ux + uy, p[1] - uy - ux), (q[0] + ux + uy, q[1] + uy - ux), (q[0] + ux - uy, q[1] + uy + ux), (p[0] - ux - uy, p[1] - uy + ux)]
            rest = overlay(rest, [[*strip, strip[0]]], "difference")
    holes = [r for r in rest if area(r) < 0]
    return [[outer, *(h for h in holes if _holds(outer, _inner(h)))] for outer in rest if area(outer) > 0]


def _read(polygon) -> Polygon:
    return [[(p["x"], p["y"]) for p in ring] for ring in polygon]


def _write(polygon: Polygon) -> list:
    return [[{"x": x, "y": y} for x, y in ring] for ring in polygon]


def overlay_pairs(df: DataFrame, left: str, right: str, kind: str, out: str = "polygon") -> DataFrame:
    """Rows of two polygons with the overlay of both and its area; the inputs are dropped, rows without a result too.

    The rows are dealt to all tasks: an overlay is long work for the few bytes by which tasks are made of rows.
    """
    from ..storage import spread

    keep = [f for f in df.schema.fields if f.name not in (left, right)]
    schema = StructType([*keep, *StructType.fromDDL(f"{out} {POLYGON}, {out}_area double").fields])

    def run(frames):
        for pdf in frames:
            rows = []
            for row in pdf.to_dict("records"):
                got = overlay(_read(row[left]), _read(row[right]), kind)
                if got:
                    rows.append(tuple(row[f.name] for f in keep) + (_write(got), size(got)))
            yield pd.DataFrame(rows, columns=schema.names)

    return spread(df).mapInPandas(run, schema)


def cut_out(features: DataFrame, drawn: DataFrame, least: float = 1e-4) -> DataFrame:
    """Features (id, polygon) that a drawn polygon touches, less the drawn part; what is left of nearly nothing is dropped.

    drawn is one row (polygon); it is small and broadcast.
    """
    one = drawn.select(F.col("polygon").alias("drawn")).limit(1)
    pairs = features.join(F.broadcast(one)).where("drawn is not null")  # one row
    return overlay_pairs(pairs, "polygon", "drawn", "difference").where(F.col("polygon_area") >= least)


def union_by_key(features: DataFrame, key: str, polygon: str = "polygon", fan: int = 16) -> DataFrame:
    """(key, polygon): unions in a tree, `fan` polygons at a time, so no task holds more than that many of a key."""
    from ..storage import stored

    now = features.select(F.col(key).alias("key"), F.col(polygon).alias("polygon"), F.lit(0).cast("long").alias("n"))
    numbered = stored(now.withColumn("n", F.row_number().over(_by("key", F.col("polygon")[0][0]["x"], F.col("polygon")[0][0]["y"])) - 1), "union")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total: Polygon = []
        for p in pdf.sort_values("n")["polygon"]:
            total = overlay(total, _read(p), "union") if total else oriented(_read(p))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "polygon": [_write(total)], "n": [int(pdf["n"].iloc[0]) // fan]})

    schema = f"key {numbered.schema['key'].dataType.simpleString()}, polygon {POLYGON}, n long"
    while numbered.agg(F.max("n")).first()[0]:
        numbered = stored(numbered.withColumn("g", F.floor(F.col("n") / fan)).groupBy("key", "g").applyInPandas(merge, schema), "union")
    return numbered.select(F.col("key").alias(key), "polygon")


def _by(key, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)
