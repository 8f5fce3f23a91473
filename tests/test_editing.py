import json

import pytest
from pyspark.sql import functions as F

from terrane.functions import display
from terrane.functions.geometry import polygon_area, unit_square
from terrane.operators import editing
from terrane.sources import catalog


@pytest.fixture(scope="module")
def row(spark):
    """Three unit squares in a row, the last one apart."""
    cells = [("a", 0.0, "P", "core"), ("b", 1.0, "P", "puppet"), ("c", 9.0, "Q", "core")]
    return spark.createDataFrame(cells, "id string, x double, owner string, status string").withColumn("polygon", F.array(unit_square("x", F.lit(0)))).drop("x")


def areas(df):
    return {r["id"]: r["a"] for r in df.withColumn("a", polygon_area("polygon")).collect()}


def test_merge_keeps_what_all_share(spark, row):
    out = editing.merge_features(row, spark.createDataFrame([("a",), ("b",)], "id string"), "m")
    assert areas(out) == {"m": 2, "c": 1}
    m = out.where("id = 'm'").first()
    assert (m["owner"], m["status"]) == ("P", None)


def test_deleted_features_join_a_neighbour(spark):
    cells = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 9.0)], "id long, x double").withColumn("polygon", F.array(unit_square("x", F.lit(0))))
    boxes = cells.select("id", F.col("x").alias("x0"), F.lit(0.0).alias("y0"), (F.col("x") + 1).alias("x1"), F.lit(1.0).alias("y1"), F.lit(1.0).alias("area"))
    gone = spark.createDataFrame([(2,), (3,)], "id long")
    assert areas(editing.delete_into_neighbour(cells.drop("x"), boxes, gone, 4.0, 0.5)) == {1: 2}


def test_vertices(spark):
    ring = spark.range(1).select(unit_square(F.lit(0), F.lit(0)).alias("ring"))
    points = lambda c: [tuple(p) for p in ring.select(c.alias("r")).first()["r"]]
    assert points(editing.move_vertex("ring", F.lit(0), F.lit(-1.0), F.lit(-1.0))) == [(-1, -1), (1, 0), (1, 1), (0, 1), (-1, -1)]
    assert points(editing.insert_vertex("ring", F.lit(0), F.lit(0.5), F.lit(0.0)))[:3] == [(0, 0), (0.5, 0), (1, 0)]
    assert points(editing.delete_vertex("ring", F.lit(0))) == [(1, 0), (1, 1), (0, 1), (1, 0)]
    both = ring.select(editing.canonical("ring").alias("a"), F.reverse("ring").alias("ring"))
    assert both.select("a", editing.canonical("ring").alias("b")).where("a = b").count() == 1


def test_snapping(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 1.01)], "id long, x double").withColumn("ring", unit_square("x", F.lit(0)))
    got = {r["id"]: [p["x"] for p in r["ring"]] for r in editing.snap_rings(a, 0.025).collect()}
    assert got[1] == [0, 1, 1, 0, 0] and got[2] == [1, 2.01, 2.01, 1, 1]


def test_display(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first()["v"]
    assert v(display.label_shown(F.lit(300), F.lit(None).cast("boolean"))) is True and v(display.label_shown(F.lit(100), F.lit(False))) is False
    assert v(display.region_fill(F.lit("#010203"), F.lit("core"), F.lit("#ffffff"), F.lit("x"), F.lit(None))) == "#010203"
    assert v(display.region_fill(F.lit(None), F.lit("core"), F.lit("#ffffff"), F.lit("x"), F.lit(None))) == "#ffffff"
    assert v(display.region_fill(F.lit(None), F.lit("core"), F.lit(None).cast("string"), F.lit("x"), F.lit(None))).startswith("#")
    assert v(display.province_fill("stateRegion", F.lit("x"), F.lit(None), F.lit("#ffffff"), F.lit(None))) > v(display.province_fill("province", F.lit("x"), F.lit(None), F.lit(None), F.lit(None)))
    x, y = display.fitted(F.lit(0.0), F.lit(0.0), (-10, -5, 10, 5))
    assert (v(x), v(y)) == (1000, 510)
    px, py = display.miller_to_pixels(F.lit(180.0), F.lit(85.0))
    assert (v(px), round(v(py), 6)) == (4096, 0)
    ring = F.array(F.named_struct(F.lit("x"), F.lit(2.0), F.lit("y"), F.lit(3.0)))
    assert tuple(v(display.from_pixels(ring, [1.0, 1.0], [0.0, 0.0, 1.0]))[0]) == (3, 9)


def test_catalog(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    feature = lambda p: {"type": "Feature", "id": "q", "properties": p, "geometry": {"type": "Polygon", "coordinates": square}}
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature({"name": "A", "admin": "A"}), feature({"name": "B", "admin": "B"})]}))
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature({"name": "B1", "admin": "B", "type": "river"})]}))
    path = lambda n: [f"file://{tmp_path}/{n}.json"]
    assert [r["id"] for r in catalog.load(spark, {"kind": "custom", "paths": path("c")}).orderBy("pos").collect()] == ["c1", "c2"]
    mixed = catalog.load(spark, {"kind": "hybrid", "big": ["B"], "countries": {"paths": path("c")}, "provinces": {"paths": path("p")}})
    assert sorted(r["name"] for r in mixed.collect()) == ["A", "B1"]
    assert catalog.load(spark, {"kind": "blank"}).count() == 0
    assert catalog.physical_layers(spark, {"rivers": path("p")[0]}).first()["layer"] == "rivers"
    assert catalog.new_project(spark, "n", "m", {"paths": ["d"]}).first()["dataset"] == "d"
    layers = spark.createDataFrame([("x", "X", "custom", 0, False, False)], catalog.LAYER_SCHEMA)
    once = catalog.with_state_layer(layers)
    assert [r["id"] for r in once.orderBy("ord").collect()] == ["state", "x"]
    assert catalog.with_state_layer(once).where("builtin").count() == 1
