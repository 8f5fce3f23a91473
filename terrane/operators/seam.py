"""Rings cut where they cross the date line: crossing points are put in and the parts are closed along the seam."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rings


def seam_edges(shapes: DataFrame, unit: str = "id", ring: str = "ring", half: float = 180.0, pole: float = 90.0) -> DataFrame:
    """Directed edges (unit, sx, sy, tx, ty) of the parts of each unit, all of them between -half and half.

    `shapes` holds closed rings, holes in rows of their own and turned the other way. An edge longer than `half` goes the
    short way round and crosses the seam. Sorted along the seam, the crossings of a unit bound its inside in pairs, and each pair is
    joined on both sides of it. An odd one has the pole of its hemisphere inside: its seam runs to that pole. A window holds the
    crossings of one unit, not its points.
    """
    r = F.col(ring)
    ends = F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("s"), F.slice(r, 2, F.size(r) - 1).alias("t"))
    edges = shapes.where(F.size(r) > 3).select(F.col(unit).alias("unit"), F.explode(ends).alias("e")).select("unit", *(F.col(f"e.{a}.{b}").alias(f"{a}{b}") for a in "st" for b in "xy"))
    jumps = F.abs(F.col("tx") - F.col("sx")) > half
    side = F.signum("sx")
    reach, rest = half - F.abs("sx"), half - F.abs("tx")
    at = F.when(reach + rest > 0, F.col("sy") + (F.col("ty") - F.col("sy")) * reach / (reach + rest)).otherwise(F.col("sy"))
    crossing = edges.where(jumps).withColumn("at", at).withColumn("side", side)
    edge = lambda *v: F.struct(*(c.cast("double").alias(n) for n, c in zip(rings.EDGE, v, strict=True)))
    east, west = F.lit(half), F.lit(-half)
    halves = F.array(edge(F.col("sx"), F.col("sy"), F.col("side") * half, F.col("at")), edge(-F.col("side") * half, F.col("at"), F.col("tx"), F.col("ty")))
    along = Window.partitionBy("unit").orderBy("at", "side")
    n, middle = F.count("*").over(Window.partitionBy("unit")), F.avg("at").over(Window.partitionBy("unit"))
    south = (n % 2 == 1) & (middle < 0)
    paired = crossing.select("unit", "side", "at", F.floor((F.row_number().over(along) - 1 + south.cast("int")) / 2).alias("pair"), F.when(middle < 0, -pole).otherwise(pole).alias("end"))
    pairs = paired.groupBy("unit", "pair").agg(F.max(F.when(F.col("side") > 0, F.col("at"))).alias("out"), F.max(F.when(F.col("side") < 0, F.col("at"))).alias("back"), F.max("end").alias("end"))
    out, back, end = F.col("out"), F.col("back"), F.col("end")
    closed = (
        F.when(out.isNotNull() & back.isNotNull(), F.array(edge(east, out, east, back), edge(west, back, west, out)))
        .when(out.isNotNull(), F.array(edge(east, out, east, end), edge(east, end, west, end), edge(west, end, west, out)))
        .otherwise(F.array(edge(west, back, west, end), edge(west, end, east, end), edge(east, end, east, back)))
    )
    both = crossing.select("unit", F.explode(halves).alias("e")).unionByName(pairs.select("unit", F.explode(closed).alias("e"))).select("unit", "e.*")
    whole = edges.where(~jumps).select("unit", *(F.col(c).cast("double").alias(c) for c in rings.EDGE))
    return whole.unionByName(both).where("sx <> tx or sy <> ty")


def split_at_seam(shapes: DataFrame, unit: str = "id", ring: str = "ring", half: float = 180.0, pole: float = 90.0) -> DataFrame:
    """(unit, ring, n, place, sx, sy, tx, ty): the edges of `seam_edges` ranked to rings; those without an area, which lie on the seam alone, are left out."""
    ranked = rings.ranked(seam_edges(shapes, unit, ring, half, pole))
    flat = rings.measures(ranked).where("abs(area) < 1e-12").select("unit", "ring")
    return ranked.join(flat, ["unit", "ring"], "left_anti")
