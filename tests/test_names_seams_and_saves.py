"""Distinct names, rings cut at the date line, lines in rasters, as-of reads and autosave against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry, scalars
from terrane.operators import naming, raster, rings, seam, timeline
from terrane.sources import catalog, readers
from terrane.streaming import autosave


def plain_names(rows, taken):
    used, out = set(taken), {}
    for order, base, suffix in sorted(rows):
        if base is None:
            out[order] = None
            continue
        k, name = 0, base
        while name in used:
            k += 1
            name = f"{base} ({suffix}{f' {k}' if k > 1 else ''})" if suffix else f"{base} ({k + 1})"
        used.add(name)
        out[order] = name
    return out


@pytest.mark.parametrize("seed", range(3))
def test_free_names(spark, seed):
    rng = random.Random(seed)
    bases = ["a", "b", "a (E)", "a (E 2)", "a (2)", "a (3)", "", None]
    rows = [(k, rng.choice(bases), rng.choice(["E", "W", "", None])) for k in rng.sample(range(10**6), 250)]
    taken = ["b", "a (E 3)", "a (E 4)", "a (W)", "b (2)", None]
    got = naming.free_names(spark.createDataFrame(rows, "k long, base string, suffix string"), "base", "suffix", "k", spark.createDataFrame([(x,) for x in taken], "name string"))
    assert {r.k: r.name for r in got.collect()} == plain_names(rows, taken)


def test_free_names_of_one_list_and_of_nothing(spark):
    rows = spark.range(3000).select("id", F.lit("x").alias("base"), F.lit("N").alias("suffix"))
    got = {r.id: r.name for r in naming.free_names(rows, "base", "suffix", "id").collect()}
    assert got == plain_names([(k, "x", "N") for k in range(3000)], [])
    assert naming.free_names(rows.where("id < 0"), "base", "suffix", "id").count() == 0


def test_guarded_renames(spark):
    rng = random.Random(4)
    names = [f"n{k}" for k in range(30)]
    curated, fixes = {"n1": "c", "n2": "n5", "n3": "z"}, {"n4": "n6", "n7": "z", "n8": "y", "n9": "y", "n10": None, "n11": "c"}
    rows = [(k, rng.choice([*names, None])) for k in range(200)]
    existing, used, want = {n for _, n in rows}, set(), {}
    for k, n in rows:
        want[k] = n
        new = curated.get(n) or fixes.get(n)
        if new and (n in curated or new not in existing and new not in used):
            want[k] = new
            used.add(new)
    table = lambda d: spark.createDataFrame(list(d.items()), "name string, new_name string")
    got = naming.renamed_guarded(spark.createDataFrame(rows, "k long, name string"), "name", "k", table(curated), table(fixes))
    assert {r.k: r.new_name for r in got.collect()} == want


def _ring(points):
    return [{"x": float((x + 180) % 360 - 180 if abs(x) != 180 else x), "y": float(y)} for x, y in points]


def test_rings_at_the_date_line(spark):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    shapes = [
        ("inside", box(10, 0, 20, 5)), ("across", box(170, 0, 190, 5)), ("touching", box(170, 0, 180, 5)),
        ("holed", box(160, -20, 200, 20)), ("holed", box(170, -10, 190, 10)[::-1]),
        ("comb", [(170, 0), (185, 0), (185, 1), (175, 1), (175, 2), (185, 2), (185, 3), (175, 3), (175, 4), (185, 4), (185, 5), (170, 5), (170, 0)]),
        ("north", [(-120, 60), (0, 60), (120, 60), (-120, 60)]), ("south", [(120, -60), (0, -60), (-120, -60), (120, -60)]), ("flat", [(1, 1), (2, 2), (1, 1)]),
    ]
    df = spark.createDataFrame([(n, _ring(p)) for n, p in shapes], "id string, ring array<struct<x:double,y:double>>")
    cut = seam.split_at_seam(df)
    assert cut.where("abs(sx) > 180 or abs(tx) > 180 or abs(tx - sx) > 180 and abs(sy) < 90").count() == 0
    got = {}
    for r in rings.measures(cut).collect():
        got.setdefault(r.unit, []).append(round(r.area, 6))
    # a cap around a pole is what lies between its line of latitude and the pole
    assert {k: sorted(v) for k, v in got.items()} == {"inside": [50], "across": [50, 50], "touching": [50], "holed": [600, 600], "comb": [5, 5, 5, 40], "north": [10800], "south": [10800]}


def plain_line(x0, y0, x1, y1):
    dx, dy, cells, x, y = abs(x1 - x0), abs(y1 - y0), [], x0, y0
    sx, sy = (x1 > x0) - (x1 < x0), (y1 > y0) - (y1 < y0)
    long, short = max(dx, dy), min(dx, dy)
    error = 2 * short - long
    for _ in range(long + 1):
        cells.append((y, x))
        if error >= 0 and long:
            x, y = (x, y + sy) if dx > dy else (x + sx, y)
            error -= 2 * long
        x, y = (x + sx, y) if dx > dy else (x, y + sy)
        error += 2 * short
    return cells


def test_lines_to_cells(spark):
    rng = random.Random(2)
    lines = [(k, [{"x": rng.uniform(-20, 20), "y": rng.uniform(-20, 20)} for _ in range(rng.randrange(0, 5))]) for k in range(60)] + [(60, [{"x": 1.0, "y": 1.0}] * 2), (61, None)]
    df = spark.createDataFrame(lines, "id long, line array<struct<x:double,y:double>>")
    want = {k: set() for k, _ in lines}
    for k, line in lines:
        cut = [(int(p["x"] // 1), int(p["y"] // 1)) for p in line or []]
        for a, b in zip(cut, cut[1:]):
            want[k] |= set(plain_line(*a, *b))
    got = {k: set() for k, _ in lines}
    for r in raster.line_cells(df).collect():
        got[r.id].add((r.r, r.c))
    assert got == want
    flat = spark.createDataFrame([(1, [{"x": 0.0, "y": 5.0}, {"x": 3.0, "y": 5.0}])], df.schema)
    assert {(r.r, r.c) for r in raster.line_cells(flat, width=4).collect()} == {(r, c) for r in (4, 5, 6, 7) for c in range(4)}


def test_predicates(spark):
    rows = spark.createDataFrame([(5, "a"), (0, "b"), (None, None), (9, "a")], "rank int, cls string")
    assert [tuple(r) for r in rows.select(scalars.within_rank("rank", 5), scalars.within_rank("rank", 9), scalars.of_class("cls", ("a", "c"))).collect()] == [(True, True, True), (False, True, False), (False, True, False), (False, True, True)]
    lines = spark.createDataFrame([([{"x": 0.0, "y": 1.0}, {"x": 4.0, "y": 1.0}],), ([],), (None,)], "line array<struct<x:double,y:double>>")
    assert [r[0] for r in lines.select(geometry.mean_inside("line", 1, 3, 0, 2)).collect()] == [True, False, False]
    assert not lines.limit(1).select(geometry.mean_inside("line", 2, 3, 0, 2)).first()[0]


def test_as_of(spark):
    rng = random.Random(9)
    facts = [(rng.choice(["a", "b", None, "hot"]), rng.randrange(2000), rng.randrange(9)) for _ in range(1500)]
    asked = [(rng.choice(["a", "b", None, "hot", "none"]), rng.randrange(-5, 2005), k) for k in range(800)]
    got = timeline.as_of(spark.createDataFrame(asked, "k string, year int, n int"), spark.createDataFrame(facts, "k string, year int, v int"), "k", "year").collect()
    want = {n: max(((y, v) for c, y, v in facts if c == k and y <= year), default=None) for k, year, n in asked}
    assert {r.n: r.fact and tuple(r.fact) for r in got} == want and len(got) == len(asked)


def test_autosave_counts_each_batch_once(spark, tmp_path):
    path, schema = f"file://{tmp_path}/saved", "k string, n long, v string"
    assert autosave.saved(spark, path) is None and autosave.tidied(spark, path) == 0
    rng, state = random.Random(1), {}
    for number in range(6):
        edits = [(rng.choice("abcdefgh"), 10 * number + i, f"{number}.{i}") for i in range(rng.randrange(5))]
        batch = spark.createDataFrame(edits, schema)
        autosave.save(batch, number, path, "k", ["n"], 4)
        if number % 2:
            autosave.save(batch, number, path, "k", ["n"], 4)  # run again after a failure
        state |= {k: v for k, _, v in edits}
        if number == 4:
            autosave.tidied(spark, path)
        got = autosave.saved(spark, path)
        assert (got is None and not state) or {r.k: r.v for r in got.collect()} == state
    late = spark.createDataFrame([("a", -1, "late")], schema)
    autosave.save(late, 6, path, "k", ["n"], 4)
    assert {r.k: r.v for r in autosave.saved(spark, path).collect()} == {"a": "late"} | state


def test_feature_rows(spark):
    lines = spark.createDataFrame([('{"type":"Feature","id":"1","properties":{"name":"n"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}',), ("",), (None,), ("{broken",), ('{"type":"Other"}',)], "value string")
    rows = readers.polygons(readers.feature_rows(lines)).collect()
    assert len(rows) == 1 and rows[0].id == "1" and rows[0].properties["name"] == "n" and len(rows[0].geom[0][0]) == 4


def test_label_overrides(spark):
    schema = "id long, label map<string,string>"
    labels = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "1"}), (3, None), (4, {"c": "3"})], schema)
    patches = spark.createDataFrame([(1, {"a": None, "c": "9"}), (2, {"a": None}), (4, None), (5, {"d": "4"}), (6, {"d": None})], schema)
    assert {r.id: r.label for r in catalog.label_overrides(labels, patches).collect()} == {1: {"b": "2", "c": "9"}, 4: {"c": "3"}, 5: {"d": "4"}}
