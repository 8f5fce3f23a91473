import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from terrane import queries as own
from terrane.sources import readers, writers
from terrane.streaming import events

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = float(v)
        return int(v) if v == int(v) else round(v, 8)
    return v


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    df = own.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in own.ORACLE_SQL:
        cursor = con.execute(own.ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == cols
        assert got == sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_geojson(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]
    features = [
        {"type": "Feature", "id": "x", "properties": {"NAME": "Ex", "admin": "Land", "provinceIds": [1, 2]}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"type": "Feature", "id": "x", "properties": {"name": ""}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}},
        {"type": "Feature", "properties": {"adm1_code": "A-1", "name": "Why"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"type": "Feature", "id": "none", "properties": {}, "geometry": None},
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    read = readers.first_readable(spark, [f"file://{tmp_path}/missing", f"file://{tmp_path}/a.geojson"], readers.read_geojson)
    got = readers.generic_features(readers.polygons(read)).orderBy("pos").collect()
    assert [(r["id"], r["name"], r["country"], len(r["geom"])) for r in got] == [("x", "Ex", "Land", 1), ("x_1", "", None, 2), ("A-1", "Why", None, 1)]
    assert readers.state_features(read.where("pos = 0")).first()["province_ids"] == ["p1", "p2"]
    assert readers.spellings("data/a.json", "http://h") == ["data/a.json", "/data/a.json", "./data/a.json", "http://h/data/a.json"]


def test_topojson(spark):
    topology = {
        "arcs": [[[0, 0], [10, 0], [0, 10]], [[10, 10], [-10, 0], [0, -10]]], "transform": {"scale": [0.1, 0.1], "translate": [1, 2]},
        "objects": {"land": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "id": "a", "properties": {"name": "A"}, "arcs": [[0, 1]]}, {"type": "MultiPolygon", "id": "b", "properties": {}, "arcs": [[[-2, -1]]]}]}},
    }
    got = readers.topojson_features(spark.createDataFrame([(json.dumps(topology),)], "value string"), "land").orderBy("pos").collect()
    points = [(round(p["x"], 6), round(p["y"], 6)) for p in got[0]["geom"][0][0]]
    assert points == [(1, 2), (2, 2), (2, 3), (1, 3), (1, 2)]
    assert [(round(p["x"], 6), round(p["y"], 6)) for p in got[1]["geom"][0][0]] == points[::-1]


def test_text_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text("1;10;20;30;land;x;forest;y\nbad;1\nz;1;2;3;a;b;c;d\n2;1;2;3;sea;x;ocean;1;extra\n")
    assert [tuple(r) for r in readers.definitions(spark, f"file://{tmp_path}/d.csv").orderBy("province_id").collect()] == [(1, 10, 20, 30, "land", "forest"), (2, 1, 2, 3, "sea", "ocean")]
    script = 'state = {\n id = 12 # id = 99\n name = "STATE_12"\n owner = GER\n state_category = town\n provinces = { 1 2\n 3 } }'
    assert readers.state_scripts(spark.createDataFrame([(script,)], "value string")).first()[:] == (12, "STATE_12", "GER", "town", [1, 2, 3])
    lines = spark.createDataFrame([(0, ' STATE_1:0 "Old"'), (1, 'STATE_1:1 "New"'), (2, 'STATE_1:0 ""'), (3, "junk")], "pos int, value string")
    assert [tuple(r) for r in readers.localisation(lines).collect()] == [("STATE_1", "New")]
    project = readers.project(spark.createDataFrame([('{"name": "mine", "x": 1}',)], "value string"), {"name": "new", "lang": "en"}).first()["project"]
    assert project == {"name": "mine", "lang": "en", "x": "1"}
    image = spark.createDataFrame([("i", bytearray([1, 2, 3] * 2 + [9, 9, 9] + [0, 0, 0] * 3))], "path string, content binary")
    assert [[tuple(x) for x in r["runs"]] for r in readers.pixels(image, 3, 2).orderBy("r").collect()] == [[(0, 1, 0x010203), (2, 2, 0x090909)], [(0, 2, 0)]]


def test_layers(spark):
    kinds = [(k, {"type": v, "provinceId": str(k)}) for k, v in enumerate(["land", "Sea", "lake", "river", "desert"])]
    features = spark.createDataFrame([(k, None, p, "Point", "[]") for k, p in kinds], "pos int, id string, properties map<string,string>, kind string, coordinates string").withColumn("geom", F.lit(None))
    assert [r["id"] for r in readers.pixel_features(features).orderBy("pos").collect()] == ["p0", "p3", "p4"]
    assert [r["layer"] for r in readers.physical_features(features).orderBy("pos").collect()] == ["land", "relief", "lakes", "rivers", "relief"]
    c = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, country string")
    assert sorted(r["id"] for r in readers.hybrid(c, spark.createDataFrame([("p1", "A"), ("p2", "C")], "id string, country string"), c.where("id = 'a'").select("country")).collect()) == ["b", "p1"]
    seeds = spark.createDataFrame([("x",), ("y",), ("z",)], "name string")
    assert {r["name"]: r["type"] for r in writers.typed_seeds(seeds, seeds.where("name = 'x'"), seeds.where("name <> 'z'")).collect()} == {"x": "historical", "y": "cultural", "z": "geographical"}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/log")
    log = events.read_log(spark, f"{tmp_path}/log", batch.schema, 10)
    events.start(events.windowed(log), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got, want = spark.read.parquet(f"{tmp_path}/out"), events.windowed(batch)
    assert 0 < got.count() <= want.count()
    assert got.select("start", "event_type", "n").exceptAll(want.select("start", "event_type", "n")).count() == 0
