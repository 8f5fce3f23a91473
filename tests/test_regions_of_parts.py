"""Clusters, territories, rings and histories against plain Python."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import clusters, editing, growth, raster, regions, rings, spatial, timeline
from terrane.operators import edges as ed


def plain_kmeans(points, k, rounds, first):
    """points: (id, x, y, w) in order of id."""
    seeds = [min(points, key=first)]
    while len(seeds) < k:
        far = max(points, key=lambda p: (min((p[1] - s[1]) ** 2 + (p[2] - s[2]) ** 2 for s in seeds), -p[0]))
        seeds.append(far)
    at = [(s[1], s[2]) for s in seeds]
    near = lambda p: min(range(k), key=lambda j: ((p[1] - at[j][0]) ** 2 + (p[2] - at[j][1]) ** 2, j))
    for _ in range(rounds):
        own = [[p for p in points if near(p) == j] for j in range(k)]
        at = [(sum(p[1] * p[3] for p in m) / sum(p[3] for p in m), sum(p[2] * p[3] for p in m) / sum(p[3] for p in m)) if m else at[j] for j, m in enumerate(own)]
    return {p[0]: near(p) for p in points}


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(6)
    return {f"g{k}": [(100 * k + i, rng.randrange(50), rng.randrange(50), rng.randrange(1, 9)) for i in range(rng.randrange(1, 40))] for k in range(7)}


def test_grouped_kmeans(spark, groups):
    df = spark.createDataFrame([(g, *p) for g, ps in groups.items() for p in ps], "grp string, id long, x long, y long, w long")
    wanted = {g: min(len(ps), 1 + k) for k, (g, ps) in enumerate(groups.items())}
    got = clusters.grouped_kmeans(df, spark.createDataFrame(list(wanted.items()), "grp string, k int")).collect()
    for g, ps in groups.items():
        assert {r.id: r.cluster for r in got if r.grp == g} == plain_kmeans(ps, wanted[g], 12, lambda p: (-p[3], p[0]))


def test_size_control(spark, groups):
    df = spark.createDataFrame([(g, *p) for g, ps in groups.items() for p in ps], "grp string, id long, x long, y long, size long")
    got = clusters.size_controlled(df, df.select("grp").distinct().withColumn("cap", F.lit(30.0))).collect()

    def cut(points, depth=0):
        total = sum(p[3] for p in points)
        if total <= 30 or len(points) < 2 or depth > 5:
            return [sorted(p[0] for p in points)]
        k = min(len(points), max(2, math.ceil(total / 22.5)))
        of = plain_kmeans([(*p[:3], 1) for p in points], k, 14, lambda p: p[0])
        return [x for j in range(k) if (part := [p for p in points if of[p[0]] == j]) for x in cut(part, depth + 1)]

    for g, ps in groups.items():
        parts = {}
        for r in got:
            if r.grp == g:
                parts.setdefault(r.part, []).append(r.id)
        assert sorted(map(sorted, parts.values())) == sorted(cut(ps))


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "grp string, id long, x double, y double, w double, size double")
    caps = spark.createDataFrame([], "grp string, cap double")
    assert clusters.grouped_kmeans(none, spark.createDataFrame([], "grp string, k int")).count() == 0
    assert clusters.size_controlled(none, caps).count() == 0


def test_strategic_modes(spark):
    cells = [(i, f"a/{i}", "A", 10 * i, 0, 20_000) for i in range(3)]  # hardly more units than wanted: kept
    cells += [(100 + i, "b/0", "B", i, 9, 90_000) for i in range(8)]  # one unit of 720,000 km2: cut in 4
    cells += [(200 + i, f"c/{i}", "C", 5 * i, 20, 1000) for i in range(20)]  # 20,000 km2: three regions of 20 units
    df = spark.createDataFrame(cells, "id long, unit string, country string, x long, y long, area long")
    units = df.groupBy("unit", "country").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum("area").alias("area")).withColumn("name", F.col("unit"))
    placed, named = clusters.strategic(df.drop("country"), units)
    found = {r.region: r for r in named.collect()}
    assert sorted(r.name for r in found.values() if r.country == "A") == ["a/0", "a/1", "a/2"]
    assert [r.name for r in found.values() if r.country == "B"] == ["B"]
    assert sorted(r.units for r in found.values() if r.country == "C") == [6, 7, 7]
    parts = placed.where("whole = 'B/b/0'").groupBy("region").count().collect()
    assert len(parts) == 4 and sum(r["count"] for r in parts) == 8


def plain_inside(cells, region_of, k, least):
    """Parts of each region as the operator's docstring has them, with unit costs."""
    out = {}
    steps = ((-1, 0), (1, 0), (0, -1), (0, 1))
    for region in set(region_of.values()):
        own = {p for p, i in cells.items() if region_of[i] == region}
        left, pieces = set(own), []
        while left:
            todo = [min(left, key=lambda p: cells[p])]
            piece = set(todo)
            while todo:
                r, c = todo.pop()
                new = [(r + i, c + j) for i, j in steps if (r + i, c + j) in left - piece]
                piece |= set(new)
                todo += new
            left -= piece
            pieces.append(piece)
        main = max(pieces, key=lambda p: (len(p), -min(cells[x] for x in p)))
        seeds = [min(main)]
        while len(seeds) < min(k, len(main)):
            seeds.append(max(main, key=lambda p: (min((p[0] - s[0]) ** 2 + (p[1] - s[1]) ** 2 for s in seeds), p)))
        part, heap = {}, [(0, n, s) for n, s in enumerate(seeds)]
        while heap:
            d, n, p = heapq.heappop(heap)
            if p not in part:
                part[p] = n
                for i, j in steps:
                    if (q := (p[0] + i, p[1] + j)) in main and q not in part:
                        heapq.heappush(heap, (d + 1, n, q))
        for piece in pieces:
            if piece is not main:
                mr, mc = sum(p[0] for p in piece) / len(piece), sum(p[1] for p in piece) / len(piece)
                near = min(range(len(seeds)), key=lambda n: ((seeds[n][1] - mc) ** 2 + (seeds[n][0] - mr) ** 2, n))
                part |= dict.fromkeys(piece, near)
        sizes = {n: list(part.values()).count(n) for n in part.values()}
        tiny = {p for p, n in part.items() if sizes[n] < least and len(sizes) > 1}
        while True:
            moves = {p: next((part[q] for i, j in steps if (q := (p[0] + i, p[1] + j)) in part and q not in tiny), None) for p in tiny}
            moves = {p: n for p, n in moves.items() if n is not None}
            if not moves:
                break
            part |= moves
            tiny -= set(moves)
        out |= {cells[p]: n for p, n in part.items()}
    return out


@pytest.mark.parametrize("least", [0, 14])
def test_growth_inside_regions(spark, least):
    rng = random.Random(11)
    cells = {(r, c): 100 * r + c for r in range(16) for c in range(16) if rng.random() < 0.8}
    region_of = {i: ("w" if c < 8 else "e") + ("n" if r < 9 else "s") for (r, c), i in cells.items()}
    df = spark.createDataFrame([(i, r, c) for (r, c), i in cells.items()], "id long, r int, c int")
    owner = spark.createDataFrame(list(region_of.items()), "id long, region string")
    e = raster.cell_edges(df).select("a", "b")
    got = growth.grow_inside(df, owner, owner.select("region").distinct().withColumn("k", F.lit(4)), e.union(e.select("b", "a")), least=least)
    assert {r.id: r.part for r in got.collect()} == plain_inside(cells, region_of, 4, least)


def test_rings_of_a_mask(spark):
    picture = ["#####..", "#.#.#..", "#####.#", "..#..##", "###...."]
    cells = spark.createDataFrame([(r, c, x) for r, line in enumerate(picture) for c, x in enumerate(line)], "r int, c int, v string")
    ranked = rings.ranked(rings.mask_edges(cells.where("v = '#'")))
    found = sorted((r.n, r.length, r.area) for r in rings.measures(ranked).collect())
    assert found == [(4, 4.0, -1.0), (4, 4.0, -1.0), (6, 8.0, 3.0), (10, 24.0, 19.0)]
    ordered = rings.polygons(ranked).collect()
    assert all(r.ring[0] == r.ring[-1] and abs(sum(p.x * q.y - q.x * p.y for p, q in zip(r.ring, r.ring[1:], strict=False)) / 2 - r.area) < 1e-9 for r in ordered)
    assert rings.measures(rings.ranked(rings.mask_edges(cells.limit(0)))).count() == 0


def test_rings_touch_but_do_not_cross(spark):
    cells = spark.createDataFrame([(0, 0, "a"), (1, 1, "a"), (0, 1, "b")], "r int, c int, v string")
    assert sorted((r.unit, r.n, r.area) for r in rings.measures(rings.ranked(rings.mask_edges(cells))).collect()) == [("a", 4, 1.0), ("a", 4, 1.0), ("b", 4, 1.0)]


def test_long_ring_in_few_rounds(spark):
    table = spark.range(500).select(F.lit("u").alias("unit"), F.array(*(F.struct((F.col("id") + a).cast("double").alias("x"), F.lit(b).cast("double").alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))).alias("ring"))
    out = ed.outlines(ed.edges(table, ["unit"]), "unit").collect()
    assert len(out) == 1 and len(out[0].ring) == 1003 and out[0].area == 500


def plain_history(commands, size):
    now, undo, redo = None, [], []
    for what, value in commands:
        if what == "edit":
            undo = [*undo, now][-size:]
            redo, now = [], value
        elif what == "undo" and undo:
            redo.append(now)
            now = undo.pop()
        elif what == "redo" and redo:
            undo.append(now)
            now = redo.pop()
    return now, len(undo), len(redo)


def test_histories(spark):
    rng = random.Random(9)
    log = [(u, n, rng.choice(["edit", "edit", "undo", "undo", "redo", "look"]), 1000 * u + n) for u in range(12) for n in range(rng.randrange(60))] + [(50, 1, "undo", 1), (None, 1, "edit", 2)]
    df = spark.createDataFrame(log, "user long, n int, what string, v long").repartition(5)
    got = {r.user: (r.v, r.n_undo, r.n_redo) for r in timeline.histories(df, "user", ["n"], "what", "v", 5).collect()}
    assert got == {u: plain_history([(w, v) for x, n, w, v in sorted(r for r in log if r[0] is not None) if x == u], 5) for u in {r[0] for r in log if r[0] is not None}}


def test_no_point_is_lost(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 5.0), (3, -4000.0, 70.0)], "id long, x double, y double")
    sites = spark.createDataFrame([(7, 1.0, 1.0), (8, 60.0, 0.0)], "site long, x double, y double")
    assert {r.id: r.site for r in editing.lloyd(points, sites, 2.0, 0).collect()} == {1: 7, 2: 8, 3: 7}
    left, right = points.toDF("lid", "lx", "ly"), sites.toDF("rid", "rx", "ry")
    assert spatial.within_distance(left.where("lid = 1"), right, 50.0, 40.0).count() == 2
    assert spatial.nearest_any(left, right.limit(0), 1.0).count() == 0


def test_fresh_ids_in_many_tasks(spark):
    rows_ = spark.createDataFrame([(i % 20, i) for i in range(200)], "sid long, file long").repartition(4)
    got = sorted((r.sid, r.file) for r in regions.fresh_ids(rows_, "sid", "file").collect())
    again = sorted((i % 20, i) for i in range(20, 200))
    assert got == sorted([(i, i) for i in range(20)] + [(1_000_000 + k, i) for k, (_, i) in enumerate(again)])
