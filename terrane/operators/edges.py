"""Topology from shared edges: borders, coasts, dissolving, outlines, shared lengths and ring tracing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import pairs

EDGE = ("ax", "ay", "bx", "by")


def edges(features: DataFrame, keep: list[str], ring: str = "ring") -> DataFrame:
    """One row per edge, its ends in a canonical order; forward tells whether the ring runs that way."""
    e = features.select(*keep, F.explode(pairs(ring)).alias("e"))
    a, b = F.col("e.a"), F.col("e.b")
    forward = (a["x"] < b["x"]) | ((a["x"] == b["x"]) & (a["y"] < b["y"]))
    low, high = F.when(forward, a).otherwise(b), F.when(forward, b).otherwise(a)
    return e.select(*keep, low["x"].alias("ax"), low["y"].alias("ay"), high["x"].alias("bx"), high["y"].alias("by"), forward.alias("forward"))


def length() -> Column:
    return F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))


def sides(table: DataFrame, unit: str) -> DataFrame:
    """Each edge with its number of sides and the smallest and largest unit beside it; nulls are a unit of their own."""
    u = F.coalesce(F.col(unit).cast("string"), F.lit("\0"))
    return table.groupBy(*EDGE).agg(F.count("*").alias("n"), F.min(u).alias("u0"), F.max(u).alias("u1"))


def coast(table: DataFrame, unit: str) -> DataFrame:
    return sides(table, unit).where("n = 1")


def borders(table: DataFrame, unit: str) -> DataFrame:
    """Edges between two different units."""
    return sides(table, unit).where("n > 1 and u0 <> u1")


def shared_lengths(table: DataFrame, key: str) -> DataFrame:
    """Length of the common border of each pair of neighbours (a < b)."""
    two = table.groupBy(*EDGE).agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count("*").alias("n")).where("n = 2 and a <> b")
    return two.groupBy("a", "b").agg(F.sum(length()).alias("length"))


def dissolved(table: DataFrame, unit: str) -> DataFrame:
    """Boundary edges of each unit's union: those on an odd number of its rings."""
    return table.groupBy(unit, *EDGE).agg(F.count("*").alias("n"), F.max("forward").alias("forward")).where("n % 2 = 1").drop("n")


def dissolved_measures(table: DataFrame, unit: str) -> DataFrame:
    """Perimeter and area of each unit's union."""
    sign = F.when(F.col("forward"), 1.0).otherwise(-1.0)
    area = F.abs(F.sum(sign * (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")))) / 2
    return dissolved(table, unit).groupBy(unit).agg(F.sum(length()).alias("perimeter"), area.alias("area"))


def outlines(table: DataFrame, unit: str) -> DataFrame:
    """Rings of each unit's union, (unit, ring number, ring, signed area), ranked from its boundary edges."""
    from . import rings

    return rings.polygons(rings.ranked(rings.directed(dissolved(table, unit), unit)))


def nested(rings: DataFrame) -> DataFrame:
    """(unit, ring_no, hole_of): holes (turned against outer rings) with the smallest outer ring of their unit that holds them."""
    from ..functions.geometry import inside

    outer = rings.where("area > 0").select("unit", F.col("ring_no").alias("outer_no"), F.col("ring").alias("outer"), F.col("area").alias("outer_area"))
    holes = rings.where("area < 0").select("unit", "ring_no", "ring")
    p = F.col("ring")[0]
    held = holes.join(outer, "unit").where(inside(p["x"], p["y"], "outer") | (F.size(F.array_intersect("ring", "outer")) > 0))
    of = held.groupBy("unit", "ring_no").agg(F.min_by("outer_no", "outer_area").alias("hole_of"))
    return rings.join(of, ["unit", "ring_no"], "left")


def junctions(cells: DataFrame, value: str = "v") -> DataFrame:
    """Lattice points where at least three different values of a raster (r, c, value) meet."""
    corners = cells.select(value, F.explode(F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i in (0, 1) for j in (0, 1)))).alias("p"))
    return corners.groupBy("p.r", "p.c").agg(F.countDistinct(value).alias("n")).where("n >= 3")
