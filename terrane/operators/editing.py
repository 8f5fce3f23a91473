"""Edits of geometry: merging, deleting into a neighbour, snapping, moving vertices, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .overlay import union_by_key
from .ownership import unanimous
from .spatial import cell, largest_near, nearest_any, within_distance


def merge_features(features: DataFrame, picked: DataFrame, new_id: str) -> DataFrame:
    """The picked features (id) become one: the union of their polygons; owner and status stay where all agree."""
    rows = features.join(picked.select("id"), "id", "left_semi").withColumn("key", F.lit(new_id))
    shape = union_by_key(rows, "key")
    agreed = unanimous(rows, ["key"], [c for c in ("owner", "status", "country") if c in features.columns])
    merged = shape.join(agreed, "key").withColumnRenamed("key", "id")
    return features.join(picked.select("id"), "id", "left_anti").unionByName(merged, allowMissingColumns=True)


def delete_into_neighbour(features: DataFrame, boxes: DataFrame, gone: DataFrame, size: float, slack: float = 2.0) -> DataFrame:
    """Deleted features (gone: id) join the largest feature whose bounds come near; those without one leave a hole."""
    target = largest_near(boxes.join(gone, "id", "left_anti").unionByName(boxes.join(gone, "id", "left_semi")), boxes.join(gone, "id", "left_semi"), size, slack)
    target = target.join(gone.withColumnRenamed("id", "rid"), "rid", "left_anti")
    parts = features.join(target.select(F.col("lid").alias("id"), F.col("rid").alias("into")), "id", "left")
    dead = gone.withColumn("dead", F.lit(True))
    kept = parts.join(dead, "id", "left").where("into is not null or dead is null")
    changed = target.select(F.col("rid").alias("id")).distinct()
    touched = kept.withColumn("key", F.coalesce("into", "id")).join(changed.withColumnRenamed("id", "key"), "key", "left_semi")
    shapes = union_by_key(touched, "key").select(F.col("key").alias("id"), F.col("polygon").alias("new_polygon"))
    alive = features.join(gone, "id", "left_anti")
    return alive.join(shapes, "id", "left").withColumn("polygon", F.coalesce("new_polygon", "polygon")).drop("new_polygon")


def snapped(points: DataFrame, vertices: DataFrame, reach: float) -> DataFrame:
    """Points (id, x, y) moved onto the nearest vertex (x, y) within reach; ties to the smaller coordinates."""
    left = points.select(F.col("id").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = vertices.select(F.struct("x", "y").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry")).distinct()
    best = within_distance(left, right, reach).groupBy("lid").agg(F.min(F.struct("d", "rid"))["rid"].alias("to"))
    return points.join(best, F.col("id") == F.col("lid"), "left").withColumns({"x": F.coalesce("to.x", "x"), "y": F.coalesce("to.y", "y")}).drop("lid", "to")


def snap_rings(features: DataFrame, reach: float = 0.025) -> DataFrame:
    """Vertices of rings (id, ring) that lie within reach of a vertex of a feature with a smaller id move onto it, in one pass."""
    v = features.select("id", F.posexplode("ring").alias("pos", "p")).select("id", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    left = v.select(F.struct("id", "pos").alias("lid"), F.col("id").alias("own"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = v.select(F.col("id").alias("other"), F.struct("id", "pos").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = within_distance(left, right, reach).where("other < own")
    best = near.groupBy("lid").agg(F.min(F.struct("d", "rx", "ry")).alias("b")).select("lid.id", "lid.pos", F.col("b.rx").alias("nx"), F.col("b.ry").alias("ny"))
    moved = v.join(best, ["id", "pos"], "left").select("id", "pos", F.named_struct(F.lit("x"), F.coalesce("nx", "x"), F.lit("y"), F.coalesce("ny", "y")).alias("p"))
    rings = moved.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("ring"))
    return features.drop("ring").join(rings, "id")


def move_vertex(ring: str, at, x, y) -> Column:
    """The ring with one vertex (from 0) moved; the first and the last are one."""
    n = F.size(ring) - 1
    point = F.named_struct(F.lit("x"), x, F.lit("y"), y)
    return F.transform(ring, lambda p, i: F.when((i % n) == (at % n), point).otherwise(p))


def insert_vertex(ring: str, after, x, y) -> Column:
    point = F.array(F.named_struct(F.lit("x"), x, F.lit("y"), y))
    return F.concat(F.slice(ring, 1, after + 1), point, F.slice(ring, after + 2, F.size(ring)))


def delete_vertex(ring: str, at) -> Column:
    """The ring without a vertex; triangles stay as they are."""
    n = F.size(ring) - 1
    open_ring = F.filter(F.slice(ring, 1, n), lambda p, i: i != at % n)
    return F.when(n > 3, F.concat(open_ring, F.slice(open_ring, 1, 1))).otherwise(F.col(ring))


def canonical(ring: str) -> Column:
    """One text for all rings over the same vertices in the same cyclic order, whatever their start and direction."""
    def rotated(points: Column) -> Column:
        n = F.size(points)
        starts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.slice(points, i, n), F.slice(points, 1, i - 1)))
        return F.array_min(F.transform(starts, lambda s: F.to_json(s)))

    open_ring = F.slice(ring, 1, F.size(ring) - 1)
    return F.least(rotated(open_ring), rotated(F.reverse(open_ring)))


def distinct_shapes(features: DataFrame, order: str) -> DataFrame:
    """The first of each set of features with the same ring."""
    marked = features.withColumn("shape", F.sha2(canonical("ring"), 256))
    return marked.groupBy("shape").agg(F.min_by(F.struct(*features.columns), order).alias("f")).select("f.*")


def group_labels(members: DataFrame, features: DataFrame) -> DataFrame:
    """(group_id, id, total): where each group's label stands, its largest member, and the area of all."""
    joined = members.join(features.select("id", "area"), "id")
    return joined.groupBy("group_id").agg(F.max_by("id", F.struct("area", -F.col("id"))).alias("id"), F.sum("area").alias("total"))


def semantic_groups(provinces: DataFrame, key: str, k: int, least: float = 0.5, most: float = 1.9) -> DataFrame:
    """(id, name): provinces grouped by an attribute, if its names are about k and few lack it; those go to the nearest group's centre.

    Centres are those of the provinces that have a name, so the result does not depend on an order.
    """
    named = provinces.where(F.coalesce(F.col(key), F.lit("")) != "")
    stats = provinces.agg(F.count("*").alias("all"), F.count_if(F.coalesce(F.col(key), F.lit("")) == "").alias("missing"), F.countDistinct(F.nullif(key, F.lit(""))).alias("names")).first()
    if stats["names"] < 2 or stats["missing"] > 0.25 * stats["all"] or not k * least <= stats["names"] <= k * most:
        return provinces.select("id", F.lit(None).cast("string").alias("name"))
    centres = named.groupBy(F.col(key).alias("name")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    rest = provinces.where(F.coalesce(F.col(key), F.lit("")) == "").select("id", "x", "y")
    d = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    near = rest.join(F.broadcast(centres)).groupBy("id").agg(F.min_by("name", F.struct(d, "name")).alias("name"))  # at most k * most centres
    return named.select("id", F.col(key).alias("name")).unionByName(near)


def lloyd(points: DataFrame, sites: DataFrame, reach: float, rounds: int = 2) -> DataFrame:
    """(id, site): each point's nearest site after sites (site, x, y) moved to the middle of their points, so many times.

    `reach` is the distance that is looked at first; points with no site in it look further.
    """

    left = points.select(F.col("id").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    for k in range(rounds + 1):
        right = sites.select(F.col("site").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
        near = left.join(nearest_any(left, right, reach).select("lid", F.col("rid").alias("site")), "lid")
        if k < rounds:
            sites = near.groupBy("site").agg(F.avg("lx").alias("x"), F.avg("ly").alias("y"))
    return near.select(F.col("lid").alias("id"), "site")


def cover_ratio(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, ratio): covered share of each feature's area; parts hold areas that do not overlap."""
    return whole.join(parts.groupBy("id").agg(F.sum("area").alias("covered")), "id", "left").select("id", (F.coalesce("covered", F.lit(0.0)) / F.col("area")).alias("ratio"))


def tally(rows: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """Counts of values, commonest first."""
    out = rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value)
    return out.limit(most) if most else out


def median_colours(pixels: DataFrame, key: str) -> DataFrame:
    """Median of each channel of a blob's pixels, truncated."""
    return pixels.groupBy(key).agg(*(F.percentile(c, 0.5).cast("int").alias(c) for c in ("r", "g", "b")))


def look_up(pixels: DataFrame, definitions: DataFrame) -> DataFrame:
    """Province of each pixel's colour key, 0 for colours that are not defined."""
    return pixels.join(definitions.select("key", "province_id"), "key", "left").withColumn("province_id", F.coalesce("province_id", F.lit(0)))


def state_names(states: DataFrame, localised: DataFrame) -> DataFrame:
    """Localised name, else the name in the file's name, else "State n"."""
    from_file = F.nullif(F.trim(F.regexp_extract("file", r"-(.*)", 1)), F.lit(""))
    useful = F.when(F.lower(from_file) != "state", from_file)
    return states.join(localised, states["name"] == localised["key"], "left").select("id", F.coalesce("text", useful, F.concat(F.lit("State "), F.col("id").cast("string"))).alias("name"))


def buckets(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"cx": cell("x", size), "cy": cell("y", size)})
