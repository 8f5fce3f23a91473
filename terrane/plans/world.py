"""A world from seeds: seeds on land, growth over entry costs, provinces of a wanted size, names, terrain, outlines.

cells(id, r, c, land, river, ranges, desert, plateau) is the raster; seeds(id, r, c, name) its seeds, in order of id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import unit_square
from ..functions.scalars import octant_name, terrain_class
from ..operators import edges as ed
from ..operators import growth, raster, spatial
from ..operators.ordered import octant_suffix, one_row
from ..storage import kept


def land_seeds(cells: DataFrame, seeds: DataFrame, reach: float) -> DataFrame:
    """Each seed on its nearest land cell, sought first within reach; of seeds on one cell the first stays."""
    left = seeds.select(F.col("id").alias("lid"), (F.col("c") + 0.5).alias("lx"), (F.col("r") + 0.5).alias("ly"))
    right = cells.where("land").select(F.col("id").alias("rid"), (F.col("c") + 0.5).alias("rx"), (F.col("r") + 0.5).alias("ry"))
    near = spatial.nearest_any(left, right, reach).select(F.col("lid").alias("seed"), F.col("rid").alias("id"))
    return near.groupBy("id").agg(F.min("seed").alias("seed"))


def graph(cells: DataFrame) -> DataFrame:
    e = raster.cell_edges(cells.where("land").select("id", "r", "c")).select("a", "b")
    return e.union(e.select("b", "a"))


def territories(cells: DataFrame, seeds: DataFrame, reach: float = 8) -> DataFrame:
    """(id, region): land grown from the seeds over noise and barriers; islands without a seed are regions of their own."""
    e = kept(graph(cells), "graph")
    costs = raster.entry_cost(raster.noise(cells.where("land"))).select("id", "cost")
    grown = growth.grow_tiled(land_seeds(cells, seeds, reach), e, growth.square_tiles(cells), costs).select("id", F.col("seed").cast("long").alias("region"))
    rest = cells.where("land").select("id").join(grown, "id", "left_anti")
    inner = e.join(rest.select(F.col("id").alias("a")), "a", "left_semi").join(rest.select(F.col("id").alias("b")), "b", "left_semi")
    islands = growth.components(rest, inner).select("id", (-F.col("component") - 1).alias("region"))
    return kept(grown.unionByName(islands), "territories")


def provinces(cells: DataFrame, owner: DataFrame, per_part: int = 540, most_cells: int = 4200, most: int = 24) -> DataFrame:
    """(id, region, province): regions of many cells are dealt to several provinces that grow from cells chosen by hash."""
    sizes = owner.groupBy("region").agg(F.count("*").alias("cells")).withColumn("parts", growth.part_count("cells", per_part, most_cells, most))
    ranked = owner.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("id"), "id")))
    centres = ranked.join(sizes, "region").where(F.col("k") <= F.col("parts")).select("id", F.col("id").alias("seed"))
    e = graph(cells).join(owner.select(F.col("id").alias("a"), F.col("region").alias("ra")), "a").join(owner.select(F.col("id").alias("b"), F.col("region").alias("rb")), "b")
    grown = growth.grow_tiled(centres, e.where("ra = rb").select("a", "b").withColumn("w", F.lit(1.0)), growth.square_tiles(cells))
    whole = owner.join(grown.select("id", "seed"), "id", "left").select("id", "region", F.coalesce("seed", F.lit(-1).cast("long")).alias("province"))
    # cells that no centre of their region reaches (parts cut off by water) are one province of the region
    return kept(whole.withColumn("province", F.when(F.col("province") < 0, -F.abs(F.xxhash64("region"))).otherwise(F.col("province"))), "provinces")


def described(cells: DataFrame, dealt: DataFrame, seeds: DataFrame, latitude) -> DataFrame:
    """One row per province: cells, centre, terrain and name (the largest of a region has the seed's name, others an octant)."""
    rows = dealt.join(cells, "id").groupBy("province", "region").agg(
        F.count("*").alias("cells"), F.avg(F.col("c") + 0.5).alias("x"), F.avg(F.col("r") + 0.5).alias("y"),
        *(F.avg(F.col(k).cast("double")).alias(k) for k in ("desert", "ranges", "plateau")),
    )
    middle = dealt.join(cells, "id").groupBy("region").agg(F.avg(F.col("c") + 0.5).alias("mx"), F.avg(F.col("r") + 0.5).alias("my"))
    named = rows.join(middle, "region").join(seeds.select(F.col("id").cast("long").alias("region"), F.col("name").alias("base")), "region", "left").withColumn("base", F.coalesce("base", F.concat(F.lit("Island "), (-F.col("region")).cast("string"))))
    named = named.withColumn("octant", octant_name(F.col("x") - F.col("mx"), F.col("my") - F.col("y")))
    out = octant_suffix(named, "region", "octant", [F.desc("cells"), "province"], "base")
    return out.select("province", "region", F.col("label").alias("name"), "cells", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), terrain_class("desert", "ranges", "plateau", latitude(F.col("y"))).alias("terrain"))


def outlines(cells: DataFrame, dealt: DataFrame, unit: str = "province") -> DataFrame:
    """Rings of each province, outer ones and holes."""
    squares = dealt.join(cells.select("id", "r", "c"), "id").select(unit, unit_square("c", "r").alias("ring"))
    return ed.nested(ed.outlines(ed.edges(squares, [unit]), unit))


def checks(rings: DataFrame, provinces_: DataFrame) -> DataFrame:
    """One row: provinces, repeated names, and by how much outlines and cell counts differ."""
    areas = rings.groupBy("unit").agg(F.sum("area").alias("area"))
    joined = provinces_.join(areas, provinces_["province"] == areas["unit"])
    names = provinces_.groupBy("name").count().agg(F.coalesce(F.sum((F.col("count") > 1).cast("int")), F.lit(0)).alias("repeated_names"))
    return one_row(joined.agg(F.count("*").alias("provinces"), F.max(F.abs(F.col("area") - F.col("cells"))).alias("area_error")), names)
