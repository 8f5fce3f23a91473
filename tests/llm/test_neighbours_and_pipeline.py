"""Neighbours against brute force, components, and the pipeline end to end."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import graph, minhash, neighbours, pii


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    for i, v in ok:
        if i % 20 == 0:
            yield i, sorted((-float((v * w).sum()), j) for j, w in ok if j != i and len(w) == len(v))[:k]


@pytest.mark.parametrize("n", [60, 150])
def test_ties_and_odd_vectors(spark, n):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(n)]
    rows += [(200 + i, rows[20][1]) for i in range(60)]  # copies: ties
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [math.nan] * 8), (504, [None] * 8), (505, [math.inf] * 8), (None, rows[0][1]), (520, [1.0, 2.0]), (521, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("score", F.lit("x"))
    got = {}
    for r in neighbours.contract(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = dict(brute(rows, 20))
    assert set(got) == {i for i, found in want.items() if found}
    vectors, hit = dict(rows), 0
    for i, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[i]) + 1))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert np.allclose([s for _, _, s in found], [np.dot(vectors[i], vectors[v]) for _, v, _ in found])
        hit += sum(v == j for (_, v, _), (_, j) in zip(found, want[i]))
    total = sum(map(len, want.values()))
    assert hit == total if n == 60 else hit > 0.9 * total  # so few vectors are all verified
    assert neighbours.contract(df.limit(0)).count() == 0


@pytest.mark.parametrize("block, query_block", [(16384, 2048), (700, 40)])
def test_recall_of_the_query(spark, block, query_block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", query_block)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], [float(v) for v in r["embedding"]]) for r in df.collect()]
    want = {(i, j) for i, found in brute(rows, 20) for _, j in found}
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.contract(df).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.93 * len(want)


def test_few_entries_are_looked_at():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12000, 32)) * rng.uniform(0.5, 2, (12000, 1))
    index, hit, verified = neighbours.Index(x), 0, 0
    for q, found, score in index.search(x[:50], 21):
        assert np.allclose(score, x[found] @ x[q])
        hit += len(set(found.tolist()) & set(np.argsort(-(x @ x[q]))[:21].tolist()))
    assert hit / (50 * 21) >= 0.93
    assert index.entered / (50 * neighbours.PROJECTIONS * len(x)) < 0.05 and index.entered / (50 * neighbours.USED * len(x)) < 0.35
    verified = [len(found) for _, found in index.candidates(x[:50], 21)]
    assert np.mean(verified) < 0.25 * len(x)


@pytest.mark.parametrize("links", [[(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (2, 1)], [(1, 1)], []])
def test_components(spark, links):
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == ({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7} if len(links) > 1 else {})


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == docs.columns and now.dtypes == docs.dtypes, name
        counts.append(now.count())
    assert docs.count() > counts[0] > counts[1] >= counts[2] == counts[3]
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    assert minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).where("not kept").count() <= 3
    assert not any(pii.find_base(x) for x in texts.values())
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r[0] for r in out.select("doc_id").distinct().collect()} == set(texts)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_stages_on_odd_rows(spark, sf_dir):
    """Null and empty cells, ties, repeated ids with the same and with other texts, clashing names, empty tables."""
    long = " ".join(f"w{i}" for i in range(60)) + ". "
    filler = [" ".join(f"f{k}x{i}" for i in range(80)) + "." for k in range(4)]
    rows = [(1, filler[0] + " " + long), (2, filler[1] + " " + long), (3, long), (4, None), (5, ""), (6, " \n"), (7, filler[2]), (7, filler[2]), (7, filler[3] + " mail a@b.co"), (None, filler[2]), (None, None), (8, "b" * 3000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, n_removed double, id int, kept boolean, c0 string, spans string, score int, gone int, cut int"
    docs = spark.createDataFrame([(i, x, None, None, None if x is None else len(x), "q", 0.5, 1, None, "c", "s", 3, 4, 5) for i, x in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes, name
        got = out.collect()
        assert all(tuple(r)[5:] == ("q", 0.5, 1, None, "c", "s", 3, 4, 5) for r in got)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        texts = [(r["doc_id"], r["text"]) for r in got]
        if name == "near_copies":
            assert sorted(texts, key=str) == sorted(rows, key=str)
        elif name == "passages":
            assert [i for i, _ in texts if i == 3] == [] and len(texts) == len(rows) - 1
            assert all(x.startswith(filler[1]) and x.count("w") < 25 for i, x in texts if i == 2)
            assert [x for i, x in texts if i == 7].count(filler[2]) == 2 and (None, filler[2]) in texts and (1, rows[0][1]) in texts
        elif name == "personal_data":
            assert sorted(texts, key=str) == sorted(((i, x and x.replace("a@b.co", "<EMAIL>")) for i, x in rows), key=str)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).where("doc_id = 4").collect()[0]["doc_tokens"] == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
