"""Region layers: imported and custom regions, edit overlays, layers and their members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered
from .ownership import plurality


def resolve(base: DataFrame, edits: DataFrame, custom: DataFrame, attributes: list[str]) -> DataFrame:
    """All regions with edits applied: custom ones as they are, imported ones patched column by column, metadata by key."""
    e = edits.select("id", *(F.col(a).alias(f"new_{a}") for a in attributes), F.col("metadata").alias("new_metadata"))
    merged = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("new_metadata", F.create_map().cast("map<string,string>"))), k)), F.coalesce("new_metadata", F.create_map().cast("map<string,string>")))
    patched = base.join(e, "id", "left").select("id", *(F.coalesce(f"new_{a}", a).alias(a) for a in attributes), merged.alias("metadata"))
    return patched.join(custom, "id", "left_anti").unionByName(custom.select("id", *attributes, "metadata"))


def bridge(regions: DataFrame, provinces: DataFrame) -> DataFrame:
    """(region_id, id, pos) of members that exist."""
    members = regions.select(F.col("id").alias("region_id"), F.posexplode("province_ids").alias("pos", "id"))
    return members.join(provinces, "id", "left_semi")


def region_of_province(members: DataFrame, order: str = "region_id") -> DataFrame:
    """One region for each province; where regions overlap the last one wins."""
    return members.groupBy("id").agg(F.max_by("region_id", order).alias("region_id"))


def smallest_claimant(claims: DataFrame) -> DataFrame:
    """One region for each province: the one with fewest provinces, then the highest id."""
    sizes = claims.groupBy("region_id").agg(F.count("*").alias("size"))
    return claims.join(sizes, "region_id").groupBy("id").agg(F.max_by(F.struct("region_id", "size"), F.struct(-F.col("size"), "region_id")).alias("w")).select("id", "w.region_id", "w.size")


def region_owner(members: DataFrame, owned: DataFrame) -> DataFrame:
    """Plurality owner of each region's provinces."""
    return plurality(members.join(owned.select("id", "owner"), "id"), ["region_id"], "owner", "pos")


def region_terrain(members: DataFrame, provinces: DataFrame) -> DataFrame:
    """Commonest terrain, the first seen of equals."""
    return plurality(members.join(provinces.select("id", "terrain"), "id"), ["region_id"], "terrain", "pos", ties="first")


def provinces_of(members: DataFrame, picked: DataFrame) -> DataFrame:
    return members.join(picked, "region_id", "left_semi").select("id").distinct()


def subtract_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone, ["region_id", "id"], "left_anti")


def delete_regions(regions: DataFrame, layers: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops regions (gone: region_id) and their places in layers(layer_id, region_id)."""
    return regions.join(gone.withColumnRenamed("region_id", "id"), "id", "left_anti"), layers.join(gone, "region_id", "left_anti")


def pick_layer(layers: DataFrame, kind: str) -> DataFrame:
    """The first layer of a type that is neither locked nor built in."""
    return layers.where((F.col("type") == kind) & ~F.col("locked") & ~F.col("builtin")).orderBy("ord").limit(1)


def delete_layer(layers: DataFrame, layer_id: str) -> DataFrame:
    return layers.where((F.col("id") != layer_id) | F.col("builtin"))


def duplicate_layer(members: DataFrame, layer_id: str, new_id: str) -> DataFrame:
    """Members of a copy of a layer; region ids get a suffix."""
    copy = members.where(F.col("layer_id") == layer_id).select(F.lit(new_id).alias("layer_id"), F.concat("region_id", F.lit("_"), F.lit(new_id)).alias("region_id"))
    return members.unionByName(copy)


def coverage_gap(provinces: DataFrame, members: DataFrame) -> DataFrame:
    return provinces.join(members, "id", "left_anti")


def fresh_ids(rows: DataFrame, key: str, order: str, start: int = 1_000_000) -> DataFrame:
    """A repeated id keeps its first row; later rows get ids from `start` on, in order."""
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    again = numbered(ranked.where("n > 1").select(key, "n", order), [key, "n"], "new").withColumn("new", F.col("new") + start)
    return ranked.join(again, [key, "n", order], "left").withColumn(key, F.coalesce("new", key)).drop("n", "new")
