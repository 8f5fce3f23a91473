"""Sinks: GeoJSON features, project documents, reports, seed snapshots, patches of built files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = '{"type":"FeatureCollection","features":[', "]}"


def coordinates(polygon: str, digits: int | None = None) -> Column:
    """A polygon's rings as nested arrays of numbers."""
    value = (lambda v: F.bround(v, digits)) if digits is not None else (lambda v: v)
    return F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.array(value(p["x"]), value(p["y"]))))


def feature_lines(df: DataFrame, polygon: str, properties: list[str], id_col: str = "id", digits: int | None = None) -> DataFrame:
    """One GeoJSON feature in each row (newline-delimited GeoJSON: no collection is held in one task)."""
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates(polygon, digits).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(id_col).cast("string").alias("id"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_features(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def collection(lines: DataFrame) -> DataFrame:
    """One text with the whole collection, for maps small enough to be one file."""
    return lines.agg(F.concat(F.lit(HEAD), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit(TAIL)).alias("value"))


def export_layer(features: DataFrame, keep: list[str], geometry: str) -> DataFrame:
    return features.where(F.col(geometry).isNotNull()).select(*keep, geometry)


def effective_export(features: DataFrame, owned: DataFrame, countries: DataFrame) -> DataFrame:
    """Features with their effective owner and its name; name and colour of the region come from its own row."""
    c = countries.select(F.col("country_id").alias("owner"), F.col("name").alias("owner_name"), F.col("color").alias("owner_color"))
    rows = owned.select("id", "owner", "status", F.col("name").alias("own_name"), F.col("color").alias("own_color"))
    joined = features.join(rows, "id", "left").join(c, "owner", "left")
    return joined.select("id", F.coalesce("own_name", "name").alias("name"), "owner", "owner_name", F.coalesce("status", F.lit("core")).alias("status"), F.coalesce("own_color", "owner_color").alias("color"))


def report(pieces: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row of counters."""
    return pieces.agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in flags.items()))


def typed_seeds(seeds: DataFrame, historical: DataFrame, cultural: DataFrame) -> DataFrame:
    """Seeds tagged by the list that names them."""
    h = historical.select("name", F.lit(True).alias("h")).distinct()
    c = cultural.select("name", F.lit(True).alias("c")).distinct()
    return seeds.join(h, "name", "left").join(c, "name", "left").withColumn("type", F.when(F.col("h"), "historical").when(F.col("c"), "cultural").otherwise("geographical")).drop("h", "c")


def renamed(built: DataFrame, names: DataFrame, key: str, placeholder: Column) -> DataFrame:
    """A built table with new names where there are any that are not placeholders; nothing else changes."""
    n = names.withColumnRenamed("name", "new_name")
    return built.join(n, key, "left").withColumn("name", F.when(F.col("new_name").isNotNull() & ~placeholder, F.col("new_name")).otherwise(F.col("name"))).drop("new_name")


def project_texts(projects: DataFrame, columns: list[str]) -> DataFrame:
    """Project documents as JSON texts (column value), one for each row; columns that are null are left out."""
    return projects.select(F.to_json(F.struct(*columns)).alias("value"))
