"""Groups of near copies that are linked only through others, and components with and without star steps."""

import random

import pytest

from terrane.llm import graph, minhash


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("one_task", [0, 40, 1 << 18])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    links = [x for x in links if x[0] != x[1]]
    assert got == plain_components({n for x in links for n in x}, links)


@pytest.mark.parametrize("pivots", [1, 32])
def test_near_copies_linked_through_others(spark, monkeypatch, pivots):
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(2 + i % 2):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(x.split()[k : k + 5]) for k in range(116)} for _, x in rows]
    links = [(i, j) for i in range(260) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain_components(range(260), links)
    assert 1 < len(set(got.values())) < 260 or len(links) > 260
