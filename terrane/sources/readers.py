"""Sources: GeoJSON, TopoJSON, definition tables, state scripts, localisation files, projects, images of provinces."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_of

COORDINATES = "array<array<array<array<double>>>>"
#: Keys of a feature's id, name and country, in order of preference (fixed values).
ID_KEYS = ("adm1_code", "ne_id", "id")
NAME_KEYS = ("name", "NAME", "NAME_EN", "name_en", "title")
COUNTRY_KEYS = ("admin", "ADMIN", "geounit", "owner")


def spellings(path: str, base: str = "") -> list[str]:
    """Ways to write a relative path, in order and each once."""
    bare = path.lstrip("./")
    return list(dict.fromkeys([path, bare, f"/{bare}", f"./{bare}", f"{base.rstrip('/')}/{bare}" if base else bare]))


def first_readable(spark: SparkSession, paths: list[str], read) -> DataFrame:
    """What `read` makes of the first path that can be read; else the last error."""
    error: Exception = FileNotFoundError("no path")
    for path in paths:
        try:
            return read(spark, path)
        except AnalysisException as e:
            error = e
    raise error


def feature_collection(texts: DataFrame, column: str = "value") -> DataFrame:
    """(pos, id, properties, kind, coordinates) from texts that each hold one GeoJSON collection."""
    schema = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    rows = texts.select(F.posexplode(F.from_json(column, schema)["features"]).alias("pos", "f"))
    return rows.select("pos", "f.id", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    return feature_collection(spark.read.text(path, wholetext=True))


def feature_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """The features of newline-delimited GeoJSON, one in each text; `pos` grows with the place in the files, with gaps. Other texts are dropped."""
    schema = "type string, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
    rows = lines.select(F.monotonically_increasing_id().alias("pos"), F.from_json(column, schema).alias("f")).where("f.type = 'Feature'")
    return rows.select("pos", "f.id", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_feature_rows(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited GeoJSON: files split at any line, so no task holds a whole collection."""
    return feature_rows(spark.read.text(path))


def polygons(features: DataFrame) -> DataFrame:
    """The features with their geometry as arrays of polygons, of rings, of struct<x,y>; other kinds have null."""
    multi = F.when(F.col("kind") == "Polygon", F.concat(F.lit("["), F.col("coordinates"), F.lit("]"))).when(F.col("kind") == "MultiPolygon", F.col("coordinates"))
    parsed = F.from_json(multi, COORDINATES)
    return features.withColumn("geom", F.transform(parsed, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))))


def topojson_features(texts: DataFrame, layer: str, column: str = "value") -> DataFrame:
    """Features of one object of a topology, arcs decoded (deltas summed, scaled, reversed where negative) and joined to rings."""
    schema = f"arcs array<array<array<double>>>, transform struct<scale:array<double>,translate:array<double>>, objects struct<`{layer}`:struct<geometries:array<struct<id:string,type:string,properties:map<string,string>,arcs:string>>>>"
    t = texts.select(F.from_json(column, schema).alias("t"))
    scale, move = F.coalesce("t.transform.scale", F.array(F.lit(1.0), F.lit(1.0))), F.coalesce("t.transform.translate", F.array(F.lit(0.0), F.lit(0.0)))
    summed = lambda arc: F.when(
        F.col("t.transform").isNotNull(),
        F.aggregate(arc, F.array().cast("array<array<double>>"), lambda acc, p: F.concat(acc, F.array(F.when(F.size(acc) == 0, F.array(p[0], p[1])).otherwise(F.array(F.element_at(acc, -1)[0] + p[0], F.element_at(acc, -1)[1] + p[1]))))),
    ).otherwise(arc)
    arcs = F.transform("t.arcs", lambda arc: F.transform(summed(arc), lambda p: F.named_struct(F.lit("x"), p[0] * scale[0] + move[0], F.lit("y"), p[1] * scale[1] + move[1])))
    rows = t.select(arcs.alias("arcs"), F.posexplode(f"t.objects.{layer}.geometries").alias("pos", "g"))
    multi = F.when(F.col("g.type") == "Polygon", F.concat(F.lit("["), F.col("g.arcs"), F.lit("]"))).otherwise(F.col("g.arcs"))
    indexed = F.from_json(multi, "array<array<array<int>>>")
    line = lambda i: F.when(i >= 0, F.col("arcs")[i]).otherwise(F.reverse(F.col("arcs")[-i - 1]))
    ring = lambda ids: F.aggregate(F.transform(ids, line), F.array().cast("array<struct<x:double,y:double>>"), lambda acc, arc: F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), arc))
    return rows.select("pos", "g.id", "g.properties", F.col("g.type").alias("kind"), F.transform(indexed, lambda poly: F.transform(poly, ring)).alias("geom"))


def property_of(*keys: str) -> Column:
    return first_of(*(F.col("properties")[k] for k in keys))


def generic_features(features: DataFrame) -> DataFrame:
    """Ids, names and countries by the first key that says something; a repeated id gets its position; no geometry, no feature."""
    named = features.where("geom is not null and size(geom) > 0").select("pos", F.coalesce(first_of("id"), property_of(*ID_KEYS), F.concat(F.lit("f"), F.col("pos").cast("string"))).alias("id"), F.coalesce(property_of(*NAME_KEYS), F.lit("")).alias("name"), property_of(*COUNTRY_KEYS).alias("country"), property_of("name_ru").alias("name_ru"), property_of("terrain").alias("terrain"), property_of("historicalArea").alias("hist_area"), property_of("culturalArea").alias("cult_area"), property_of("color").alias("base_color"), "geom")
    again = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return named.withColumn("again", again).withColumn("id", F.when(F.col("again") > 1, F.concat_ws("_", "id", "pos")).otherwise(F.col("id"))).drop("again")


def pixel_features(features: DataFrame) -> DataFrame:
    """Land provinces of a province image: id p<number>, terrain, coast and continent."""
    p = F.col("properties")
    land = features.where(~F.coalesce(F.lower(p["type"]), F.lit("land")).isin("sea", "lake", "ocean", "lakes"))
    return land.select("pos", F.concat(F.lit("p"), p["provinceId"]).alias("id"), p["provinceId"].cast("int").alias("pid"), property_of("name").alias("name"), p["type"].alias("ptype"), p["terrain"].alias("terrain"), (F.lower(p["coastal"]) == "true").alias("coastal"), p["continent"].alias("continent"), "geom")


def physical_features(features: DataFrame) -> DataFrame:
    """Rivers, lakes, seas and relief: one table, layer by type."""
    kind = property_of("type")
    layer = F.when(kind == "land", "land").when(kind.isin("sea", "strait"), "seas").when(kind == "river", "rivers").when(kind == "lake", "lakes").otherwise("relief")
    return features.select("pos", property_of("id").alias("id"), property_of("name").alias("name"), kind.alias("typ"), layer.alias("layer"), F.coalesce(property_of("importance"), F.lit("minor")).alias("importance"), F.col("properties")["labelX"].cast("double").alias("label_x"), F.col("properties")["labelY"].cast("double").alias("label_y"), "kind", "coordinates")


def state_features(features: DataFrame) -> DataFrame:
    """State regions with their lists of provinces and resources."""
    p = F.col("properties")
    number = F.coalesce(p["regionId"], p["stateId"], p["id"]).cast("int")
    return features.select("pos", F.concat(F.lit("s"), number.cast("string")).alias("id"), number.alias("region_id"), property_of("name").alias("name"), F.transform(F.from_json(p["provinceIds"], "array<int>"), lambda i: F.concat(F.lit("p"), i.cast("string"))).alias("province_ids"), p["owner"].alias("owner"), F.from_json(p["cores"], "array<string>").alias("cores"), F.from_json(p["resources"], "map<string,double>").alias("resources"))


def hybrid(countries: DataFrame, provinces: DataFrame, big: DataFrame) -> DataFrame:
    """Provinces of the big countries (big: country) and all other countries whole."""
    return countries.join(big, "country", "left_anti").unionByName(provinces.join(big, "country", "left_semi"), allowMissingColumns=True)


def blank(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, name string, country string, geom array<array<array<struct<x:double,y:double>>>>")


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """(province_id, r, g, b, type, terrain) from ;-separated rows of at least eight columns; rows that don't parse are dropped."""
    parts = F.split("value", ";")
    rows = spark.read.text(path).where(F.size(parts) >= 8).select(*(F.trim(parts[k]).alias(f"v{k}") for k in range(8)))
    numbers = [F.col(f"v{k}").try_cast("int").alias(n) for k, n in enumerate(("province_id", "r", "g", "b"))]
    return rows.select(*numbers, F.col("v4").alias("type"), F.col("v6").alias("terrain")).where("province_id is not null and r is not null and g is not null and b is not null")


def state_scripts(texts: DataFrame, column: str = "value") -> DataFrame:
    """(id, name, owner, category, provinces) from texts that each hold one state; comments run from # to the line's end."""
    body = F.regexp_replace(column, "#[^\\n]*", "")
    got = texts.withColumn("body", body)
    one = lambda p: F.nullif(F.regexp_extract("body", p, 1), F.lit(""))
    listed = F.regexp_extract("body", r"provinces\s*=\s*\{([^}]*)\}", 1)
    return got.select(one(r"\bid\s*=\s*(\d+)").cast("int").alias("id"), one(r'\bname\s*=\s*"?([\w.-]+)"?').alias("name"), one(r"\bowner\s*=\s*(\w+)").alias("owner"), one(r"\bstate_category\s*=\s*(\w+)").alias("category"), F.transform(F.regexp_extract_all(listed, F.lit(r"\d+"), 0), lambda x: x.cast("int")).alias("provinces")).where("id is not null")


def localisation(lines: DataFrame, column: str = "value", order: str = "pos") -> DataFrame:
    """(key, text): last text that is not empty for each key of lines like KEY:0 "text"."""
    p = r'^\s*([\w.-]+):\d*\s*"(.*)"'
    rows = lines.select(F.regexp_extract(column, p, 1).alias("key"), F.regexp_extract(column, p, 2).alias("text"), order)
    return rows.where("key <> '' and text <> ''").groupBy("key").agg(F.max_by("text", order).alias("text"))


def project(texts: DataFrame, defaults: dict[str, str], column: str = "value") -> DataFrame:
    """Project documents as a map of their top level, over defaults."""
    given = F.from_json(column, "map<string,string>")
    base = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv)) if defaults else F.create_map().cast("map<string,string>")
    rest = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(given), k))
    return texts.select(F.map_concat(rest, given).alias("project"))


def pixels(images: DataFrame, width: int, height: int) -> DataFrame:
    """(path, r, runs) from raw 24-bit RGB images (binaryFile rows): each row as runs of one colour, array<struct<c0,c1,rgb>>."""
    import numpy as np
    import pandas as pd

    def run(frames):
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.frombuffer(content, np.uint8)[: width * height * 3].reshape(height, width, 3).astype(np.int64)
                keys = a[..., 0] << 16 | a[..., 1] << 8 | a[..., 2]
                for r, row in enumerate(keys):
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [width]])
                    out.append((path, r, [{"c0": int(x), "c1": int(y) - 1, "rgb": int(row[x])} for x, y in zip(cut[:-1], cut[1:], strict=True)]))
            yield pd.DataFrame(out, columns=["path", "r", "runs"])

    return images.select("path", "content").mapInPandas(run, "path string, r int, runs array<struct<c0:int,c1:int,rgb:int>>")
