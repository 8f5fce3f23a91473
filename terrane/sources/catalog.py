"""Registry of map kinds: how each is read, what it supports, and the defaults of a new project."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers

Reader = Callable[[SparkSession, dict], DataFrame]
_kinds: dict[str, Reader] = {}

DEFAULTS = {"style": "standard", "border_width": "0.8", "inner_borders": "true", "state_borders": "true", "show_labels": "false"}
#: Builtin layer that a map with regions has.
STATE_LAYER = ("state", "Default State Regions", "state", 0, True, True)
LAYER_SCHEMA = "id string, name string, type string, ord int, builtin boolean, locked boolean"


def kind(name: str):
    def add(fn: Reader) -> Reader:
        _kinds[name] = fn
        return fn

    return add


def load(spark: SparkSession, entry: dict) -> DataFrame:
    """Features of a catalog entry {kind, paths, ...}, by the reader of its kind; unknown kinds are read as GeoJSON."""
    return _kinds.get(entry.get("kind", ""), _kinds["geojson"])(spark, entry)


@kind("geojson")
def _geojson(spark: SparkSession, entry: dict) -> DataFrame:
    return readers.generic_features(readers.polygons(readers.first_readable(spark, entry["paths"], readers.read_geojson)))


@kind("custom")
def _custom(spark: SparkSession, entry: dict) -> DataFrame:
    """An imported collection: ids are c1, c2, ... in its order."""
    return custom_features(readers.first_readable(spark, entry["paths"], readers.read_geojson))


def custom_features(features: DataFrame) -> DataFrame:
    return readers.generic_features(readers.polygons(features)).withColumn("id", F.concat(F.lit("c"), (F.col("pos") + 1).cast("string")))


@kind("pixelgeo")
def _pixel(spark: SparkSession, entry: dict) -> DataFrame:
    return readers.pixel_features(readers.polygons(readers.first_readable(spark, entry["paths"], readers.read_geojson)))


@kind("topo")
def _topo(spark: SparkSession, entry: dict) -> DataFrame:
    texts = readers.first_readable(spark, entry["paths"], lambda s, p: s.read.text(p, wholetext=True))
    return readers.generic_features(readers.topojson_features(texts, entry["object"]))


@kind("hybrid")
def _hybrid(spark: SparkSession, entry: dict) -> DataFrame:
    big = spark.createDataFrame([(c,) for c in entry["big"]], "country string")
    return readers.hybrid(load(spark, entry["countries"]), load(spark, entry["provinces"]), big)


@kind("blank")
def _blank(spark: SparkSession, entry: dict) -> DataFrame:
    return readers.blank(spark)


def physical_layers(spark: SparkSession, paths: dict[str, str], read=readers.read_geojson) -> DataFrame:
    """Rivers, lakes, mountains and so on from a file each, as one table with the name of its file's layer; `read_feature_rows` reads split files."""
    out = None
    for name, path in paths.items():
        one = readers.physical_features(read(spark, path)).withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def supports_regions(entry: dict) -> bool:
    return bool(entry.get("supports_regions"))


def new_project(spark: SparkSession, name: str, entry_id: str, entry: dict) -> DataFrame:
    """One row: names of the map and its data sets, and settings at their defaults."""
    settings = F.create_map(*(F.lit(x) for kv in DEFAULTS.items() for x in kv))
    first = (entry.get("paths") or [None])[0]
    return spark.range(1).select(F.lit(name).alias("name"), F.lit(entry_id).alias("map_id"), F.lit(first).cast("string").alias("dataset"), settings.alias("settings"))


def with_state_layer(layers: DataFrame) -> DataFrame:
    """The layers with the builtin one, which is put first if there is none."""
    spark = layers.sparkSession
    has = layers.where("builtin").limit(1).select(F.lit(True).alias("has"))
    first = spark.createDataFrame([STATE_LAYER], LAYER_SCHEMA).join(has, F.col("has"), "left_anti")  # one row
    return first.unionByName(layers.withColumn("ord", F.col("ord") + 1), allowMissingColumns=True)


def put_over(base: Column, patch: Column) -> Column:
    """The entries of a map with those of another put over them; a missing map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    new = F.coalesce(patch, empty)
    return F.map_concat(F.map_filter(F.coalesce(base, empty), lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def label_overrides(labels: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Overrides (key, label map<string,string>) with a patch for some keys put over them.

    An entry that a patch sets to null goes, and so does a row without entries: only what differs from the defaults is kept. One row a key on both sides.
    """
    both = labels.join(patches.select(key, F.col("label").alias("_patch")), key, "full")
    kept = both.withColumn("label", F.map_filter(put_over(F.col("label"), F.col("_patch")), lambda _, v: v.isNotNull()))
    return kept.where(F.size("label") > 0).drop("_patch")
