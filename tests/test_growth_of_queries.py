"""What keeps the memory and time of queries in proportion to their input."""

import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from terrane import queries, storage
from terrane.functions import geometry
from terrane.operators import clusters, growth, overlay, raster, rings, seam, spatial
from terrane.plans import merged_regions


@pytest.mark.parametrize("name", ["adjacency_knn", "point_in_polygon", "overlap_areas", "largest_near_box"])
def test_cells_are_not_broadcast(spark, sf_dir, name):
    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_points_of_one_position_meet_polygons_once(spark):
    """A polygon is tested against positions, however many points share them."""
    points = spark.range(600).selectExpr("id AS point_id", "IF(id % 5 = 4, NULL, (id % 5) * 1.0) AS px", "IF(id < 600, 0.5D, 1.5D) AS py")
    areas = spark.range(6).select(F.col("id").alias("ord"), F.array(geometry.unit_square(F.col("id") - 1.5, F.lit(0.0), 2.0)).alias("polygon"))
    found = spatial.point_in_polygon(points, areas, 1.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [px#") == 2 and "Aggregate [point_id#" not in plan
    got = {r.point_id: r.ord for r in found.collect()}
    assert len(got) == 600 and all(got[k] == (0, 1, 2, 3, None)[k % 5] for k in got)


def test_strategic_map_as_its_sql_has_it(spark, tmp_path):
    """35 units and an area for 26 clusters, of which the SQL makes 24."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'p' || i AS p_name, 'Brand#11' AS p_brand, 'A' AS p_type, (80 + i % 13)::INT AS p_size, 1.0::DOUBLE AS p_retailprice FROM range(1400) r(i)")
    con.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    want = con.execute(__spark_entry__.oracle_sql()["strategic_map"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["strategic_map"](spark, str(tmp_path)).collect()]
    assert len(want) == 24 and sorted(got) == sorted(want)


def _parts(df, caps, **kw):
    out = {}
    for r in clusters.size_controlled(df, caps, **kw).collect():
        out.setdefault((r.grp, r.part), []).append(r.id)
    return sorted(sorted(v) for v in out.values())


def test_parts_of_many_clusters(spark, monkeypatch):
    """A group of 400 clusters is cut in few rounds: in tasks and in rounds alike, and to the cap."""
    rng = random.Random(3)
    rows = [("g", i, i % 40, i // 40, rng.randrange(1, 9)) for i in range(4000)] + [("h", 9000 + i, 5, 5, 7) for i in range(9)]
    df = spark.createDataFrame(rows, "grp string, id long, x long, y long, size long")
    caps, size = df.select("grp").distinct().withColumn("cap", F.lit(60.0)), {r[1]: r[4] for r in rows}
    written = []
    monkeypatch.setattr(clusters, "stored", lambda d, name="step": written.append(name) or storage.stored(d, name))
    parts = _parts(df, caps)
    assert len(written) < 12
    assert sorted(i for p in parts for i in p) == sorted(size)
    assert all(sum(size[i] for i in p) <= 60 for p in parts if p[0] < 9000)
    assert [p for p in parts if p[0] >= 9000] == [list(range(9000, 9009))]  # nine in one place can't be told apart
    few = df.where("id % 40 < 6 and id < 600")
    assert _parts(few, caps, one_task=1) == _parts(few, caps)


def test_equal_positions_are_searched_once(spark, monkeypatch):
    """Many points and places in few positions: what is searched and stored grows with the positions."""
    sizes = []
    real = storage.kept
    monkeypatch.setattr(storage, "kept", lambda d, name="step": sizes.append((out := real(d, name)).count()) or out)
    points = spark.range(3000).selectExpr("id AS point_id", "(id % 6) * 20.0 AS plon", "(id % 3) * 10.0 AS plat")
    places = spark.range(500).selectExpr("id", "(id % 5) * 30.0 AS lon", "(id % 5) * 7.0 AS lat")
    got = {r.point_id: r.id for r in spatial.nearest_place(points, places).collect()}
    assert max(sizes) <= 6 and len(got) == 3000
    assert all(got[k] == got[k % 6] < 5 for k in got)
    sizes.clear()
    left = points.selectExpr("point_id AS lid", "plon AS lx", "plat AS ly", "point_id % 2 AS country")
    right = places.selectExpr("id AS rid", "lon AS rx", "lat AS ry", "id % 2 AS country")
    got = {r.lid: r.rid for r in spatial.nearest_any(left, right, 5.0, None, ("country",)).collect()}
    assert max(sizes) <= 12 and len(got) == 3000
    for k in range(6):
        at = lambda n: ((n % 5) * 30.0 - (k % 6) * 20.0) ** 2 + ((n % 5) * 7.0 - (k % 3) * 10.0) ** 2  # noqa: B023, E731
        assert got[k] == min((n for n in range(500) if n % 2 == k % 2), key=lambda n: (at(n), n))


def test_no_frame_is_read_anew_for_every_row(spark, sf_dir):
    plan = __spark_entry__.queries()["fill_nearest_gaps"](spark, sf_dir)
    cells = spark.range(60000).selectExpr("id", "id AS r", "0L AS c", "IF(id % 30000 = 7, id, NULL) AS v")
    began = time.time()
    filled = {r.id: r.v for r in raster.fill_nearest(cells).collect()}
    assert time.time() - began < 40 and len(filled) == 60000
    assert all(filled[k] == (7 if k <= 15007 else 30007) for k in filled)
    assert plan.where("v is null").isEmpty()


@pytest.mark.parametrize("name", ["river_mask", "moved_rings", "cleaned_rings", "needles_and_coasts"])
def test_rows_of_much_work_are_spread(spark, sf_dir, name):
    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_expressions_of_rings_name_their_input_once(spark):
    text = F.upper("path")
    plan = spark.createDataFrame([("M0,0L1,0L1,1Z",)], "path string").select(geometry.ring_area(geometry.parse_path(text)[0]).alias("area"), geometry.clean_ring(geometry.parse_path(text)[0]).alias("ring"))
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("regexp_extract_all") == 2
    assert plan.first()["area"] == 0.5 and len(plan.first()["ring"]) == 4


def test_kept_rows_are_not_broadcast(spark):
    """Few bytes in files, any number of rows once they are joined on."""
    a, b = (storage.kept(spark.range(1000).withColumnRenamed("id", "k")) for _ in range(2))
    assert "Broadcast" not in a.join(b.select(F.col("k").alias("j")), F.col("k") == F.col("j"))._jdf.queryExecution().executedPlan().toString()
    assert growth.kept is rings.kept is raster.kept is storage.kept


def test_boxes_of_one_place_are_laid_once(spark, tmp_path, monkeypatch):
    """Suppliers 828 apart have the same box: its overlays are made once, by all tasks, and given to each."""
    met = []
    real = overlay.overlay_pairs
    monkeypatch.setattr(overlay, "overlay_pairs", lambda df, *a, **b: met.append((df.count(), out := real(df, *a, **b))) or out)
    spark.range(400).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size", "1.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(60).selectExpr("id % 20 + id div 20 * 828 AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()["overlap_areas"](spark, str(tmp_path)).collect()]
    assert 0 < met[0][0] < len(got)  # pairs that only touch count too
    assert "REPARTITION_BY_NUM" in met[0][1]._jdf.queryExecution().executedPlan().toString()
    firsts = {(i, s, a) for i, s, a in got if s < 828}
    assert set(got) == {(i, s + n * 828, a) for i, s, a in firsts for n in range(3)}


def test_units_of_one_shape_are_cut_once(spark, tmp_path, monkeypatch):
    """Parts 2730 apart (30, 13 and 7 divide it) have the same U."""
    met = []
    real = seam.split_at_seam
    monkeypatch.setattr(seam, "split_at_seam", lambda df, *a, **b: met.append(df.count()) or real(df, *a, **b))
    spark.range(75).selectExpr("id % 25 + id div 25 * 2730 AS p_partkey", "CAST(id % 25 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.id: r[1:] for r in __spark_entry__.queries()["date_line_parts"](spark, str(tmp_path)).collect()}
    assert met == [25] and len(got) == 75
    assert all(got[k] == got[k % 2730] for k in got)


def test_atoms_give_borders_once(spark, sf_dir, monkeypatch):
    """Rounds of merging read the borders of pieces, not the edges of all atoms."""
    asked = []
    real = merged_regions._borders
    monkeypatch.setattr(merged_regions, "_borders", lambda atoms, unit: asked.append(unit) or real(atoms, unit))
    atoms = queries.atoms(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    out = merged_regions.merged(atoms)
    assert asked == ["piece_id"]
    assert out.count() == atoms.count() and out.select("region").distinct().count() > 1
