"""Connected components of a table of links, with union-find inside tasks and star steps between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spaces import written


ONE_TASK = 1 << 18


class UnionFind:
    """Disjoint sets over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches):
    """The links of a partition as stars: each node and the smallest node that it reaches there."""
    held = [np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if held:
        links = np.concatenate(held)
        nodes, at = np.unique(links, return_inverse=True)
        sets = UnionFind(len(nodes))
        for a, b in at.reshape(links.shape).tolist():
            sets.union(a, b)
        root = nodes[[sets.find(k) for k in range(len(nodes))]]
        moved = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(root[moved])], names=["u", "v"])


def _star(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step; links lead from the larger to the smaller node."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
    return small.select("x.u", "x.v").where("u <> v").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of the links (two long columns): root is the smallest node that it reaches.

    Once no more than ONE_TASK links are left of what the tasks have joined, a single task joins those.
    """
    a, b = links.columns
    now, mark = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").mapInArrow(_forest, "u long, v long"), name), None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == mark:
            break
        mark = n, total
        if n <= ONE_TASK:
            now = written(now.coalesce(1).mapInArrow(_forest, "u long, v long"), name)
            break
        now = written(_star(now.mapInArrow(_forest, "u long, v long")), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
