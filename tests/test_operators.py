import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions.geometry import unit_square
from terrane.operators import edges as ed
from terrane.operators import georef, growth, ordered, ownership, raster, regions, shapes, spatial, timeline
from terrane.plans import merged_regions, world


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def quads(spark):
    """4 x 4 unit squares, a quarter for each owner; (0, 0) is unowned."""
    cells = [(y * 4 + x, float(x), float(y), None if (x, y) == (0, 0) else "ABCD"[(x >= 2) + 2 * (y >= 2)]) for y in range(4) for x in range(4)]
    return spark.createDataFrame(cells, "id long, x double, y double, owner string").withColumn("ring", unit_square("x", "y"))


def test_borders_and_dissolving(quads):
    e = ed.edges(quads, ["id", "owner"])
    assert ed.coast(e, "owner").count() == 16
    assert ed.sides(e, "owner").where("n = 2").count() == 24
    assert ed.borders(e, "owner").count() == 10
    assert rows(ed.dissolved_measures(e, "owner").where("owner is not null"), "owner", "perimeter", "area") == [("A", 8, 3), ("B", 8, 4), ("C", 8, 4), ("D", 8, 4)]
    lengths = ed.shared_lengths(e, "id")
    assert lengths.count() == 24 and lengths.agg(F.sum("length")).first()[0] == 24
    outlines = ed.outlines(e.where("owner is not null"), "owner")
    assert rows(outlines, "unit", "area") == [("A", 3), ("B", 4), ("C", 4), ("D", 4)]
    assert all(r["ring"][0] == r["ring"][-1] for r in outlines.collect())


def test_holes_are_nested(spark):
    ring = [(y * 3 + x, float(x), float(y)) for y in range(3) for x in range(3) if (x, y) != (1, 1)]
    squares = spark.createDataFrame(ring, "id long, x double, y double").select(F.lit("a").alias("u"), unit_square("x", "y").alias("ring"))
    got = ed.nested(ed.outlines(ed.edges(squares, ["u"]), "u")).collect()
    assert sorted(r["area"] for r in got) == [-1, 9]
    hole, outer = sorted(got, key=lambda r: r["area"])
    assert hole["hole_of"] == outer["ring_no"] and outer["hole_of"] is None


def test_effective_ownership(spark):
    own = spark.createDataFrame([("r1", "P", "core", "g"), ("r2", "P", "core", "gone"), ("r3", "P", "core", "h"), ("r4", None, "core", None)], "id string, owner string, status string, group_id string")
    groups = spark.createDataFrame([("g", "Q", "puppet"), ("h", None, "core")], "group_id string, owner string, status string")
    assert [(r["id"], r["owner"], r["status"]) for r in ownership.effective(own, groups).orderBy("id").collect()] == [("r1", "Q", "puppet"), ("r2", "P", "core"), ("r3", None, "core"), ("r4", None, "core")]
    changes = spark.createDataFrame([("r1", "Z"), ("r2", None), ("new", "Y")], "id string, owner string")
    table, changed = ownership.assign(own, groups, changes)
    got = {r["id"]: (r["owner"], r["status"]) for r in table.collect()}
    assert got["r1"] == ("P", "core") and got["new"] == ("Y", "core") and got["r2"] == (None, "core")
    assert {r["group_id"]: r["owner"] for r in changed.collect()} == {"g": "Z", "h": None}
    assert "r4" not in got  # says nothing, so it is dropped


def test_plurality_ties(spark):
    df = spark.createDataFrame([(1, v, k) for k, v in enumerate("XYYX")], "k int, v string, pos int")
    assert ownership.plurality(df, ["k"], "v", "pos").first()["v"] == "Y"
    assert ownership.plurality(df, ["k"], "v", "pos", ties="first").first()["v"] == "X"


def test_groups_and_edits(spark):
    own = spark.createDataFrame([("a", None, "core", None), ("b", "Q", "puppet", None), ("c", "R", "core", "old")], "id string, owner string, status string, group_id string")
    members = spark.createDataFrame([("old", "c", 0), ("old", "d", 1)], "group_id string, id string, pos int")
    picked = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, pos int")
    table, all_members, group = ownership.merge_group(own, members, picked, "new")
    assert group.first()[:] == ("new", "Q", "puppet")
    assert rows(all_members, "group_id", "id") == [("new", "a"), ("new", "b"), ("new", "c"), ("old", "d")]
    freed, groups, left = ownership.ungroup(table, group, all_members, "new")
    assert {r["id"]: (r["owner"], r["group_id"]) for r in freed.collect()} == {"a": ("Q", None), "b": ("Q", None), "c": ("Q", None)}
    assert groups.count() == 0 and rows(left, "id") == [("d",)]
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, n string")
    out = ownership.apply_edits(base, base.where("id = 2").select("id"), spark.createDataFrame([(3, "C"), (4, "d")], "id int, n string"))
    assert rows(out, "id", "n") == [(1, "a"), (3, "C"), (4, "d")]
    toggled = ownership.toggle(base.where("id < 3"), base.where("id > 1"))
    assert rows(toggled, "id") == [(1,), (3,)]
    assert rows(ownership.patch(base, "id", spark.createDataFrame([(1, "z"), (9, "n")], "id int, n string")), "id", "n") == [(1, "z"), (2, "b"), (3, "c"), (9, "n")]


def test_region_overlays(spark):
    base = spark.createDataFrame([("s1", "One", {"a": "1", "b": "2"}), ("s2", "Two", None)], "id string, name string, metadata map<string,string>")
    edits = spark.createDataFrame([("s1", None, {"b": "9"})], "id string, name string, metadata map<string,string>")
    custom = spark.createDataFrame([("s2", "Mine", {"c": "3"})], "id string, name string, metadata map<string,string>")
    got = {r["id"]: (r["name"], r["metadata"]) for r in regions.resolve(base, edits, custom, ["name"]).collect()}
    assert got == {"s1": ("One", {"a": "1", "b": "9"}), "s2": ("Mine", {"c": "3"})}
    again = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c")], "sid long, file string")
    assert rows(regions.fresh_ids(again, "sid", "file"), "sid", "file") == [(7, "a"), (8, "c"), (1_000_000, "b")]


def test_ordered(spark):
    line = spark.createDataFrame([(0, k, float(x)) for k, x in enumerate((170, 178, -178, -170))], "l int, k int, x double")
    assert [r["unwrapped"] for r in ordered.unwrap(line, ["l"], ["k"], "x").orderBy("k").collect()] == [170, 178, 182, 190]
    values = spark.createDataFrame([(0, v) for v in range(25)], "k int, v int")
    assert tuple(ordered.indexed_percentiles(values, ["k"], "v").first()) == (0, 0, 2, 12, 22, 24, 25)
    many = spark.range(1000).withColumn("v", F.xxhash64("id"))
    assert [r["n"] for r in ordered.numbered(many, ["v"]).orderBy("v").collect()] == list(range(1000))
    log = spark.createDataFrame([(1, k, k) for k in range(70)], "u int, ts int, e int")
    assert timeline.undo_stack(log, "u", ["ts", "e"]).agg(F.min("e"), F.count("*")).first()[:] == (10, 60)


def test_years(spark, tmp_path):
    snap = spark.createDataFrame([(1, "a", 1900), (2, "b", 1910)], "id int, v string, year int")
    again = timeline.add_year(snap, 1910, spark.createDataFrame([(3, "c")], "id int, v string"))
    assert rows(again, "id", "year") == [(1, 1900), (3, 1910)]
    assert timeline.at_year(again, 1905).count() == 0
    path = f"file://{tmp_path}/years"
    timeline.write_years(snap, path)
    timeline.write_years(timeline.at_year(again, 1910), path)
    assert rows(spark.read.parquet(path), "id", "year") == [(1, 1900), (3, 1910)]


def test_nearest_and_wrap(spark):
    rng = random.Random(1)
    pts = [(k, rng.uniform(0, 40), rng.uniform(0, 20)) for k in range(120)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    left, right = df.toDF("lid", "lx", "ly"), df.toDF("rid", "rx", "ry")
    d = lambda a, b: np.hypot(min(abs(a[1] - b[1]), 40 - abs(a[1] - b[1])), a[2] - b[2])
    want = sorted((a[0], b[0]) for a in pts for b in pts if d(a, b) <= 3)
    assert rows(spatial.within_distance(left, right, 3.0, 40.0), "lid", "rid") == want
    got = spatial.nearest_within(left.where("lid < 10"), right.where("rid >= 10"), 6.0, 2, 40.0)
    for r in got.where("rank = 1").collect():
        assert r["rid"] == min(pts[10:], key=lambda b: (d(pts[r["lid"]], b), b[0]))[0]


def test_growth_and_components(spark):
    n = 12
    cells = raster.grid(spark, n, n).select((F.col("r") * n + F.col("c")).cast("long").alias("id"), "r", "c")
    e = raster.cell_edges(cells).select("a", "b")
    both = e.union(e.select("b", "a"))
    cost = cells.select("id", (F.col("id") * 7 % 5 + 1).cast("double").alias("cost"))
    got = {r["id"]: (r["dist"], r["seed"]) for r in growth.grow(spark.createDataFrame([(0, 0), (143, 1), (77, 2)], "id long, seed long"), both, cost).collect()}
    best = {0: (0.0, 0), 143: (0.0, 1), 77: (0.0, 2)}
    pairs = [(r["a"], r["b"]) for r in both.collect()]
    for _ in range(n * n):
        for a, b in pairs:
            if a in best:
                offer = (best[a][0] + b * 7 % 5 + 1, best[a][1])
                if b not in best or offer < best[b]:
                    best[b] = offer
    assert got == best
    tiles = growth.square_tiles(cells, 5)
    tiled = growth.grow_tiled(spark.createDataFrame([(0, 0), (143, 1), (77, 2)], "id long, seed long"), both, tiles, cost)
    assert {r["id"]: (r["dist"], r["seed"]) for r in tiled.collect()} == best
    split = both.where("floor(a / 12) = floor(b / 12)")
    assert rows(growth.components(cells, split), "id", "component") == [(k, k // 12 * 12) for k in range(144)]


def test_small_pieces_merge(spark):
    pieces = spark.createDataFrame([(1, 10.0, "a"), (2, 1.0, "a"), (3, 20.0, "b"), (4, 1.0, "c")], "id long, size double, country string")
    borders = spark.createDataFrame([(1, 2, 1.0), (2, 3, 5.0), (3, 4, 1.0)], "a long, b long, length double")
    assert rows(growth.merge_small(pieces, borders, 5.0), "id", "root") == [(1, 1), (2, 2), (3, 2), (4, 2)]
    assert rows(growth.merge_small(pieces, borders, 5.0, same="country"), "id", "root") == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_kmeans(spark):
    pts = [(k, [float(k % 3 * 10 + k % 2), 0.0]) for k in range(30)]
    got = growth.kmeans(spark.createDataFrame(pts, "id long, v array<double>"), 3)
    assert got.groupBy("cluster").count().orderBy("cluster").select("count").collect() == [(10,)] * 3


def test_raster(spark):
    cells = raster.grid(spark, 3, 5).withColumn("v", (F.col("c") == 2) & (F.col("r") == 1))
    assert raster.dilate(cells).where("v").count() == 5
    assert raster.erode(raster.dilate(cells)).where("v").count() >= 1
    assert raster.close(cells).where("v").count() >= 1 and raster.opened(cells).where("v").count() == 0
    gaps = cells.withColumn("id", (F.col("r") * 5 + F.col("c")).cast("long")).withColumn("v", F.when(F.col("id").isin(0, 14), F.col("id")))
    assert raster.fill_gaps(gaps).where("v is null").count() == 0
    square = F.array(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1, 0), (3, 0), (3, 2), (1, 2), (1, 0)))))
    polygon = spark.range(1).select(F.lit(7).alias("v"), F.lit(1).alias("ord"), square.alias("polygon"))
    assert raster.rasterise(raster.grid(spark, 3, 5), polygon).where("v = 7").count() == 4
    noisy = raster.noise(raster.grid(spark, 20, 20)).agg(F.min("noise"), F.max("noise")).first()
    assert 0 <= noisy[0] < noisy[1] <= 1


UNIT = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)]


def test_shapes():
    assert [abs(shapes.area(r)) for r in shapes.middle_cut(UNIT)] == [4, 4]
    assert len(shapes.subdivide(UNIT, 1.0)) == 8 and sum(abs(shapes.area(r)) for r in shapes.subdivide(UNIT, 1.0)) == 8
    assert abs(shapes.area(shapes.clip_convex(UNIT, [(1, 1), (5, 1), (5, 5), (1, 5), (1, 1)]))) == 3
    assert sorted(abs(shapes.area(r)) for r in shapes.line_cut(UNIT, (0, 0), (4, 2))) == [4, 4]
    line = [(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)]
    assert shapes.thin_line(line, 0.1) == [(0, 0), (2, 0), (3, 5), (4, 0)] == shapes.thin_line(line[::-1], 0.1)[::-1]
    dense = [(k / 10, 0.0) for k in range(40)] + [(4.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    assert abs(shapes.area(shapes.thin_ring(dense, 0.01))) == pytest.approx(7.9) and len(shapes.thin_ring(dense, 0.01)) == 5
    assert len(shapes.visvalingam(dense, 0.2)) < len(dense) and shapes.guarded(UNIT, UNIT[:2]) == UNIT
    assert shapes.crosses_itself([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]) and not shapes.crosses_itself(UNIT)
    cells = shapes.voronoi_cells(UNIT, [(1, 1), (3, 1), (2, 0.1)])
    assert sum(abs(shapes.area(c)) for c in cells) == pytest.approx(8)
    x, y = shapes.interior_point([(0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4), (0, 0)])
    assert 0 < x < 1 or 3 < x < 4


def test_shapes_on_tables(quads):
    halves = shapes.map_rings(quads.select("id", "ring"), "ring", shapes.middle_cut)
    assert halves.count() == 32
    inner = shapes.with_interior_point(quads.select("id", "x", "ring"), "ring").first()
    assert inner["x"] < inner["inner_point"]["x"] < inner["x"] + 1
    assert shapes.valid_only(quads, "ring").count() == 16


def test_georeferencing(spark):
    rng = np.random.default_rng(0)
    control = [(float(a), float(b), float(a / 10 - 5 + b * b / 900), float(b / 8)) for a, b in rng.uniform(0, 100, (20, 2))]
    df = spark.createDataFrame(control, "px double, py double, lon double, lat double")
    got = georef.warp(df.select("px", "py", F.col("lon").alias("want")), georef.fit_plate(df)).collect()
    assert max(abs(r["lon"] - r["want"]) for r in got) < 1e-6
    pts = [(float(x), 1 + 2.0 * x - 0.1 * x * x + (50 if x == 7 else 0)) for x in range(30)]
    c, kept = georef.fit_without_outliers(spark.createDataFrame(pts, "x double, y double"), "x", "y", 2)
    assert np.allclose(c, [1, 2, -0.1]) and kept.count() == 29
    assert georef.residuals(kept, "x", "y", c).first()["max_residual"] < 1e-6


def test_merged_regions_keep_all_area(spark):
    cells = [(y * 20 + x, float(x), float(y), 1.0, 1500.0, x // 10, (x * 3 + y) // 9 if x < 12 else None) for y in range(20) for x in range(20)]
    atoms = spark.createDataFrame(cells, "id long, x double, y double, size double, area double, atlas long, state long")
    merged = merged_regions.merged(atoms)
    names = spark.createDataFrame([("atlas", 0, "West"), ("atlas", 1, "East")], "kind string, key long, name string")
    out = merged_regions.regions(merged, names)
    assert out.agg(F.sum("area_km2")).first()[0] == 400 * 1500
    assert out.agg(F.min("area_km2")).first()[0] >= merged_regions.SLIVER
    assert [r["id"] for r in out.orderBy("id").collect()] == list(range(1, out.count() + 1))
    report = merged_regions.report(atoms, merged, out).first()
    assert report["atlas_regions"] == 2 and report["final_regions"] == out.count()


def test_world_covers_all_land(spark):
    cells = raster.grid(spark, 16, 20).select((F.col("r") * 20 + F.col("c")).cast("long").alias("id"), "r", "c").withColumn("land", F.col("c") != 9)
    cells = cells.withColumns({k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(6)) == 0 for k in ("river", "ranges", "desert", "plateau")})
    seeds = spark.createDataFrame([(1, 3, 3, "Alda"), (2, 12, 4, "Bryn")], "id long, r int, c int, name string")
    dealt = world.provinces(cells, world.territories(cells, seeds), per_part=40)
    assert dealt.count() == cells.where("land").count() == dealt.select("id").distinct().count()
    described = world.described(cells, dealt, seeds, lambda y: 60 - y)
    check = world.checks(world.outlines(cells, dealt), described).first()
    assert check["provinces"] == described.count() > 4 and check["area_error"] < 1e-9 and check["repeated_names"] == 0


def box(x, y, w, h):
    return [(float(x), float(y)), (x + w, float(y)), (x + w, y + h), (float(x), y + h), (float(x), float(y))]


@pytest.mark.parametrize("seed", range(6))
def test_overlay_agrees_with_cells(seed):
    """Random unions of boxes on a grid: areas of all operations equal counts of cells."""
    from terrane.operators.overlay import overlay, size

    rng = random.Random(seed)

    def made():
        polygon, cells = [], set()
        for _ in range(4):
            x, y, w, h = rng.randrange(8), rng.randrange(8), rng.randrange(1, 5), rng.randrange(1, 5)
            polygon = overlay(polygon, [box(x, y, w, h)], "union") if polygon else [box(x, y, w, h)]
            cells |= {(a, b) for a in range(x, x + w) for b in range(y, y + h)}
        return polygon, cells

    (a, ca), (b, cb) = made(), made()
    assert size(a) == pytest.approx(len(ca)) and size(b) == pytest.approx(len(cb))
    assert size(overlay(a, b, "union")) == pytest.approx(len(ca | cb))
    assert size(overlay(a, b, "intersection")) == pytest.approx(len(ca & cb))
    assert size(overlay(a, b, "difference")) == pytest.approx(len(ca - cb))


def test_overlay_of_slanted_shapes():
    from terrane.operators.overlay import overlay, polyline_cut, size

    diamond = [[(2.0, 0.0), (4.0, 2.0), (2.0, 4.0), (0.0, 2.0), (2.0, 0.0)]]
    square = [box(1, 1, 2.0, 2.0)]
    assert size(overlay(diamond, square, "intersection")) == pytest.approx(4)
    assert size(overlay(diamond, square, "difference")) == pytest.approx(4)
    ring = overlay([box(0, 0, 3.0, 3.0)], [box(1, 1, 1.0, 1.0)], "difference")
    assert len(ring) == 2 and size(ring) == pytest.approx(8)
    parts = polyline_cut([box(0, 0, 4.0, 4.0)], [(-1.0, 2.0), (2.0, 2.0), (2.0, 5.0)], 0.01)
    assert len(parts) == 2 and sum(size(p) for p in parts) == pytest.approx(16 - 4 * 0.02, abs=0.01)


def test_overlay_on_tables(spark, quads):
    from terrane.operators.overlay import cut_out, union_by_key

    squares = quads.select("id", F.coalesce("owner", F.lit("none")).alias("owner"), F.array("ring").alias("polygon"))
    got = union_by_key(squares, "owner", fan=2)
    from terrane.functions.geometry import polygon_area

    assert rows(got.withColumn("a", polygon_area("polygon")), "owner", "a") == [("A", 3), ("B", 4), ("C", 4), ("D", 4), ("none", 1)]
    drawn = spark.range(1).select(F.array(unit_square(F.lit(0.5), F.lit(0.5), 1.0)).alias("polygon"))
    left = cut_out(squares, drawn)
    assert left.agg(F.sum("polygon_area")).first()[0] == pytest.approx(15) and left.count() == 16


def test_exclusive_seeds_take_turns(spark):
    rng = random.Random(2)
    pts = [(k, rng.uniform(0, 10), rng.uniform(0, 10)) for k in range(60)]
    seeds = spark.createDataFrame(pts[:25], "id long, x double, y double")
    nodes = spark.createDataFrame([(k + 100, x + 0.1, y) for k, x, y in pts[20:]], "id long, x double, y double")
    got = {r["seed"]: r["node"] for r in spatial.exclusive_nearest(seeds, nodes, 3.0).collect()}
    free, want = {k + 100: (x + 0.1, y) for k, x, y in pts[20:]}, {}
    for k, x, y in pts[:25]:
        near = sorted((np.hypot(x - a, y - b), n) for n, (a, b) in free.items() if np.hypot(x - a, y - b) <= 3)
        if near:
            want[k] = near[0][1]
            del free[near[0][1]]
    assert got == want


def test_home_names(spark):
    regions_ = spark.createDataFrame([(1, "A", 0.0, 0.0, 7), (2, "B", 5.0, 5.0, 7), (3, "C", 9.0, 9.0, 7)], "id long, country string, x double, y double, seed long")
    seeds = spark.createDataFrame([(7, "A", 0.0, 1.0, "Alda"), (8, "B", 6.0, 5.0, "Bryn"), (9, "B", 9.0, 5.0, "Far")], "id long, country string, x double, y double, name string")
    assert rows(spatial.home_names(regions_, seeds), "id", "name") == [(1, "Alda"), (2, "Bryn"), (3, "Alda")]
