"""Rings from directed boundary edges by list ranking: joins and pointer doubling, no group that holds a unit.

Every edge finds the one that follows it at its end. Doubling these pointers gives each edge the least
edge of its ring in as many rounds as the logarithm of the longest ring; cutting rings there and
doubling once more gives each edge its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept
from .ordered import numbered

EDGE = ("sx", "sy", "tx", "ty")


def directed(boundary: DataFrame, unit: str) -> DataFrame:
    """(unit, sx, sy, tx, ty) from edges in canonical order with `forward`."""
    pick = lambda a, b: F.when(F.col("forward"), F.col(a)).otherwise(F.col(b))
    return boundary.select(F.col(unit).alias("unit"), pick("ax", "bx").alias("sx"), pick("ay", "by").alias("sy"), pick("bx", "ax").alias("tx"), pick("by", "ay").alias("ty"))


def mask_edges(cells: DataFrame) -> DataFrame:
    """(unit, sx, sy, tx, ty): sides of equal cells (r, c, v) in a raster that border on another value, straight ones joined.

    A side belongs to the value on its left. Cells without a value have no sides of their own.
    """
    sides = ((-1, 0, 0, 0, 1, 0), (0, 1, 1, 0, 1, 1), (1, 0, 1, 1, 0, 1), (0, -1, 0, 1, 0, 0))  # neighbour, start and end of each side
    one = cells.where("v is not null").select("r", "c", F.col("v").alias("unit"))
    asked = one.select("unit", F.explode(F.array(*(F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.lit(k).alias("k"), F.col("r").alias("own_r"), F.col("c").alias("own_c")) for k, (dr, dc, *_) in enumerate(sides)))).alias("s")).select("unit", "s.*")
    there = one.select("r", "c", F.col("unit").alias("other"))
    open_ = asked.join(there, ["r", "c"], "left").where("other is null or other <> unit")
    # along a row or column of the raster, sides of one kind that follow each other are one edge
    across, along = F.when(F.col("k") % 2 == 0, F.col("own_r")).otherwise(F.col("own_c")), F.when(F.col("k") % 2 == 0, F.col("own_c")).otherwise(F.col("own_r"))
    lined = open_.select("unit", "k", across.alias("across"), along.alias("along"))
    island = F.col("along") - F.row_number().over(Window.partitionBy("unit", "k", "across").orderBy("along"))
    spans = lined.withColumn("island", island).groupBy("unit", "k", "across", "island").agg(F.min("along").alias("low"), (F.max("along") + 1).alias("high"))
    at = lambda options: F.element_at(F.array(*(F.col(c).cast("double") if d is None else (F.col(c) + d).cast("double") for c, d in options)), F.col("k") + 1)
    return spans.select("unit", at([("low", None), ("across", 1), ("high", None), ("across", None)]).alias("sx"), at([("across", None), ("low", None), ("across", 1), ("high", None)]).alias("sy"), at([("high", None), ("across", 1), ("low", None), ("across", None)]).alias("tx"), at([("across", None), ("high", None), ("across", 1), ("low", None)]).alias("ty"))


def followers(edges: DataFrame) -> DataFrame:
    """(e, next): the edge of the same unit that follows, at a crossing the one with the sharpest left turn, so rings touch but don't cross."""
    ahead = edges.select("unit", F.col("sx").alias("tx"), F.col("sy").alias("ty"), F.col("e").alias("next"), F.col("tx").alias("nx"), F.col("ty").alias("ny"))
    both = edges.join(ahead, ["unit", "tx", "ty"])
    dx, dy, ex, ey = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy"), F.col("nx") - F.col("tx"), F.col("ny") - F.col("ty")
    return both.groupBy("e").agg(F.max_by("next", F.struct(F.atan2(dx * ey - dy * ex, dx * ex + dy * ey), -F.col("next"))).alias("next"))


def ranked(edges: DataFrame) -> DataFrame:
    """The directed edges (unit, sx, sy, tx, ty) with `ring`, the number of its first edge, `place` from 0 and `n`, the edges of the ring.

    Edges must close: as many of a unit begin at a point as end there.
    """
    named = kept(numbered(edges, ["unit", *EDGE], "e"), "edges")
    chain = kept(followers(named), "chain")
    now = chain.select("e", "next", F.col("e").alias("low"))
    while True:
        ahead = now.select(F.col("e").alias("next"), F.col("next").alias("after"), F.col("low").alias("next_low"))
        now = kept(now.join(ahead, "next").select("e", F.col("after").alias("next"), F.least("low", "next_low").alias("low"), (F.col("next_low") < F.col("low")).alias("moved")), "rings")
        if now.where("moved").isEmpty():  # no stretch twice as long holds a lesser edge
            break
    rings = now.select("e", "low")
    now = kept(chain.join(rings, "e").select("e", "low", F.when(F.col("next") != F.col("low"), F.col("next")).alias("next")).withColumn("left", F.col("next").isNotNull().cast("long")), "places")
    while not now.where("next is not null").isEmpty():
        ahead = now.select(F.col("e").alias("next"), F.col("next").alias("after"), F.col("left").alias("more"))
        now = kept(now.join(ahead, "next", "left").select("e", "low", F.col("after").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "places")
    whole = now.where("e = low").select("low", (F.col("left") + 1).alias("n"))
    return named.join(now.select("e", "low", "left"), "e").join(whole, "low").select("unit", *EDGE, F.col("low").alias("ring"), (F.col("n") - 1 - F.col("left")).alias("place"), "n")


def measures(rings: DataFrame) -> DataFrame:
    """(unit, ring, n, length, area) of ranked edges; holes have a negative area."""
    return rings.groupBy("unit", "ring").agg(F.count("*").alias("n"), F.sum(F.hypot(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy"))).alias("length"), (F.sum(F.col("sx") * F.col("ty") - F.col("tx") * F.col("sy")) / 2).alias("area"))


def polygons(rings: DataFrame) -> DataFrame:
    """(unit, ring_no, ring, area): one row for each ring, its points in order and closed; rings of a unit are numbered by their first edge."""
    points = F.array_sort(F.collect_list(F.struct("place", F.col("sx").alias("x"), F.col("sy").alias("y"))))
    whole = rings.groupBy("unit", "ring").agg(points.alias("p"), (F.sum(F.col("sx") * F.col("ty") - F.col("tx") * F.col("sy")) / 2).alias("area"))
    order = rings.where("place = 0").select("unit", "ring").withColumn("ring_no", F.row_number().over(Window.partitionBy("unit").orderBy("ring")) - 1)  # one row for each ring
    ring = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return whole.join(order, ["unit", "ring"]).select("unit", "ring_no", ring.alias("ring"), "area")
