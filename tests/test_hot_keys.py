"""Operators that must not gather a key in a task, against plain Python."""

import random

import numpy as np

from terrane.operators import growth, ordered, spatial


def plain_components(nodes, links):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_between_tasks(spark):
    deal = random.Random(5)
    for n, m in ((60, 30), (40, 0)):
        links = [(deal.randrange(n), deal.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(n // 2, n - 1)]
        links += links[:3]
        nodes = spark.range(n)
        edges = spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long").repartition(7)
        want = plain_components(range(n), links)
        for one_task in (0, 1 << 18):
            got = growth.components(nodes, edges, one_task)
            assert {r.id: r.component for r in got.collect()} == want
    assert growth.components(nodes.limit(0), edges.limit(0)).count() == 0
    small = spark.createDataFrame([(1,), (2,)], "id int")
    assert growth.components(small, spark.createDataFrame([(2, 1)], "a int, b int")).schema["component"].dataType.simpleString() == "int"


def test_a_hub_of_many_nodes_stays_spread(spark):
    n = 3000
    edges = spark.createDataFrame([(k, 0) for k in range(1, n)] + [(k, n + k) for k in range(n)], "a long, b long").repartition(12)
    got = growth.components(spark.range(2 * n), edges, 0)
    assert got.where("component <> 0").isEmpty() and got.count() == 2 * n


def test_kmeans_with_weights_and_odd_vectors(spark):
    deal = np.random.default_rng(3)
    v, w = deal.normal(size=(300, 5)), deal.integers(1, 5, 300).astype(float)
    rows = [(k, v[k].tolist(), float(w[k])) for k in range(300)]
    df = spark.createDataFrame([*rows, (900, None, 1.0), (901, [1.0, None, 0.0, 0.0, 0.0], 1.0)], "id long, v array<double>, w double").repartition(5)
    got = {r.id: (r.cluster, r.d2) for r in growth.kmeans(df, 4, 6, "w").collect()}
    at = [0]
    d2 = lambda c: ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    while len(at) < 4:
        at.append(int(d2(v[at]).min(axis=1).argmax()))
    centres = v[at]
    for _ in range(6):
        near = d2(centres).argmin(axis=1)
        centres = np.array([np.average(v[near == k], axis=0, weights=w[near == k]) if (near == k).any() else centres[k] for k in range(4)])
    near = d2(centres)
    assert {k: got[k][0] for k in range(300)} == dict(enumerate(near.argmin(axis=1).tolist()))
    assert np.allclose([got[k][1] for k in range(300)], near.min(axis=1))
    assert got[900] == got[901] == (None, None)
    assert growth.kmeans(df.limit(0), 3, weight="w").count() == 0


def test_percentiles_across_ranges(spark):
    deal = random.Random(7)
    values = [(deal.choice(["a", "b", None]), deal.choice([None, *range(40)])) for _ in range(900)] + [("one", 5), ("none", None)]
    got = ordered.indexed_percentiles(spark.createDataFrame(values, "k string, v int").repartition(6), ["k"], "v")
    want = {}
    for key in {k for k, x in values if x is not None}:
        s = sorted(x for k, x in values if k == key and x is not None)
        n = len(s)
        want[key] = (s[0], s[n // 10], s[n // 2], s[9 * n // 10], s[-1], n)
    assert {r.k: (r.low, r.p10, r.median, r.p90, r.high, r.n) for r in got.collect()} == want


def test_nearest_of_the_same_key(spark):
    deal = random.Random(11)
    place = lambda: (float(deal.randrange(60)), float(deal.randrange(60)))
    regions = [(k, deal.choice("ABCD"), *place(), deal.randrange(14)) for k in range(80)]
    seeds = [(k, "ABC"[k % 3], *place(), f"s{k}") for k in range(12)] + [(12, "A", 5000.0, -5000.0, "far"), (13, "E", 0.0, 0.0, "only")]
    odd = [(100, "A", None, 1.0, 13), (101, None, 1.0, 1.0, 13), (102, "E", 9.0, 9.0, 0), (103, "E", float("nan"), 9.0, 0)]
    r = spark.createDataFrame(regions + odd, "id long, country string, x double, y double, seed long")
    s = spark.createDataFrame(seeds, "id long, country string, x double, y double, name string")
    want = {100: "only", 101: "only", 102: "only", 103: "s0"}
    for k, country, x, y, seed in regions:
        near = sorted((float(np.hypot(x - a, y - b)), i, name) for i, c, a, b, name in seeds if c == country)
        want[k] = near[0][2] if near and seeds[seed][1] != country else seeds[seed][4]
    assert {x.id: x.name for x in spatial.home_names(r, s).collect()} == want
    assert {x.id: x.name for x in spatial.home_names(r, s.limit(0)).collect()} == dict.fromkeys(want)
