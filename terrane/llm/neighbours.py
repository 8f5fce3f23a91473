"""Approximate nearest neighbours by inner product: collision counting over single-projection arrays.

A block of vectors is projected on PROJECTIONS random directions and each projection is sorted. A query
takes part in the USED arrays in which it stands furthest from the middle, where few vectors are near and
a collision tells most, and opens a window around its own projection in each. Virtual rehashing widens
its windows by GROWTH: what lies between the old and the new ends of a window enters it and counts one
collision more; nothing else is looked at. A vector that collides in THRESHOLD of the windows has
collided often enough. When CANDIDATES * n ** 0.75 of a block of n vectors have (and at least four times the
number wanted), these are verified exactly. Largest inner product becomes nearest distance by one more
coordinate, sqrt(M^2 - |x|^2), for M the largest norm of the block.

Equal vectors are one class, of which the k + 1 smallest ids are kept: no other can be among k
neighbours. Every block of classes meets every block of distinct query vectors in one task, of
bounded size; the k + 1 best of each are merged. Rows whose id or vector is null, and vectors that
are empty, zero or not finite, take no part; vectors of other lengths than a query's are not its
candidates. Rows that repeat an id and a vector count once. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spaces import written

PROJECTIONS = 512
USED = 64
THRESHOLD = 0.2
FIRST_WINDOW = 0.5
GROWTH = 1.1
CANDIDATES = 1.2
BLOCK = 16384
QUERY_BLOCK = 2048
_TOGETHER = 128


class Index:
    """Sorted projections of a block of vectors of one length."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.vectors = vectors
        norm = np.sqrt((vectors**2).sum(1))
        self.largest = norm.max()
        long = np.column_stack([vectors, np.sqrt(np.maximum(self.largest**2 - norm**2, 0))]).astype(np.float32)
        self.directions = np.random.default_rng(seed).normal(size=(PROJECTIONS, long.shape[1])).astype(np.float32)
        p = self.directions @ long.T
        order = np.argsort(p, axis=1)
        self.sorted, self.order = np.take_along_axis(p, order, 1), order.astype(np.int32)
        #: Entries of the arrays that entered a window, of all queries so far.
        self.entered = 0

    def places(self, arrays: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many entries of an array are less than x, for each array and x, by bisection of all at once."""
        low, high = np.zeros(x.shape, np.int64), np.full(x.shape, self.sorted.shape[1])
        while (low < high).any():
            middle = low + high >> 1
            less = (self.sorted[arrays, np.minimum(middle, self.sorted.shape[1] - 1)] < x) & (low < high)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        return low

    def candidates(self, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query, vectors) that collide often enough, after as much widening as each query needs."""
        n = len(self.vectors)
        wanted, need = min(n, max(4 * k, int(CANDIDATES * n**0.75))), int(np.ceil(THRESHOLD * USED))
        scaled = queries * (self.largest / np.sqrt((queries**2).sum(1)))[:, None]
        at = self.directions[:, :-1] @ scaled.T.astype(np.float32)
        for first in range(0, len(queries), _TOGETHER):
            waiting = np.arange(first, min(first + _TOGETHER, len(queries)))
            own = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, at[:, waiting], strict=True)])
            used = np.argsort(-np.abs(2 * own - n), axis=0, kind="stable")[:USED].T
            x, low = np.take_along_axis(at[:, waiting].T, used, 1), np.take_along_axis(own.T, used, 1)
            high, counts, half = low, np.zeros((len(waiting), n), np.uint8), FIRST_WINDOW * self.largest
            while len(waiting):
                new_low, new_high = self.places(used, x - half), self.places(used, np.nextafter(x + half, np.float32(np.inf)))
                late = np.zeros(len(waiting), bool)
                for c, q in enumerate(waiting.tolist()):
                    cuts = zip(used[c].tolist(), new_low[c].tolist(), low[c].tolist(), high[c].tolist(), new_high[c].tolist(), strict=True)
                    entered = np.concatenate([y for j, s, t, u, v in cuts for y in (self.order[j, s:t], self.order[j, u:v])])
                    self.entered += len(entered)
                    counts[q - first] += np.bincount(entered, minlength=n).astype(np.uint8)
                    found = np.flatnonzero(counts[q - first] >= need)
                    late[c] = len(found) < wanted and (new_high[c] - new_low[c]).min() < n
                    if not late[c]:
                        yield q, found
                waiting, used, x, low, high, half = waiting[late], used[late], x[late], new_low[late], new_high[late], half * GROWTH

    def search(self, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, best, scores): the k best of the candidates by exact inner product, ties to the smaller position.

        Single precision picks which candidates are scored in double precision, with a margin above its error.
        """
        short = self.vectors.astype(np.float32)
        margin = 1e-5 * self.largest
        for q, found in self.candidates(queries, k):
            query = queries[q]
            if len(found) > k:
                rough = short[found] @ query.astype(np.float32)
                least = np.partition(rough, len(found) - k)[len(found) - k] - margin * np.sqrt((query**2).sum())
                found = found[rough >= least]
            score = (self.vectors[found] * query).sum(1)
            order = np.lexsort((found, -score))[:k]
            yield q, found[order], score[order]


def _valid(batches):
    """Rows with a usable vector: id, digest of the vector, its length and its bytes as doubles."""
    import hashlib

    for batch in batches:
        rows = []
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = x.values
            if i is None or values is None or not len(values) or values.null_count:
                continue
            v = values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
            if np.isfinite(v).all() and v.any():
                raw = v.tobytes()
                rows.append((i, hashlib.md5(raw).digest(), len(v), raw))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["id", "key", "size", "vec"])


def nearest(vectors: DataFrame, queries: str, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each row that `queries`, a condition on the column id, selects."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = written(source.mapInArrow(_valid, "id long, key binary, size int, vec binary").dropDuplicates(["id", "key"]), "vectors")
    asked = rows.where(queries).select("id", "key")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = first.groupBy("key", "size").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec"))
    classes = written(classes.join(asked.select("key").distinct().withColumn("asked", F.lit(True)), "key", "left"), "classes")
    n, q = classes.agg(F.count("*"), F.count("asked")).first()
    n_blocks, q_blocks = max(1, -(-n // BLOCK)), max(1, -(-q // QUERY_BLOCK))
    spread = F.xxhash64("key")
    left = classes.select(F.pmod(spread, F.lit(n_blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), "size", "ids", "vec")
    right = classes.where("asked").select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), F.pmod(F.shiftright(spread, 20), F.lit(q_blocks)).cast("int").alias("q"), "size", "key", "vec")

    def search(table: pa.Table, wanted: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if table.num_rows and wanted.num_rows:
            sizes, query_sizes = table.column("size").to_numpy(), wanted.column("size").to_numpy()
            for size in np.unique(query_sizes).tolist():
                at = np.flatnonzero(sizes == size)
                part = table.take(at)
                ids = part.column("ids").to_pylist()
                order = sorted(range(len(ids)), key=lambda i: ids[i][0])
                ids = [ids[i] for i in order]
                for a in range(0, len(ids), 2 * BLOCK):
                    matrix = np.frombuffer(b"".join(part.column("vec")[i].as_py() for i in order[a : a + 2 * BLOCK]), "<f8").reshape(-1, size)
                    index = Index(matrix)
                    rows = wanted.take(np.flatnonzero(query_sizes == size)).to_pylist()
                    queries_ = np.frombuffer(b"".join(row["vec"] for row in rows), "<f8").reshape(-1, size)
                    for at_, found, score in index.search(queries_, k + 1):
                        row, best = rows[at_], sorted((-s, i) for f, s in zip(found.tolist(), score.tolist(), strict=True) for i in ids[a + f])[: k + 1]
                        out[0].extend([row["key"]] * len(best))
                        out[1].extend(i for _, i in best)
                        out[2].extend(-s for s, _ in best)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.float64()), strict=True)], names=["key", "id", "score"])

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(search, "key binary, id long, score double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    lists = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("found"))
    own = asked.withColumnRenamed("id", "query_id").join(lists, "key")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("id"), "x.score")


def contract(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, "id % 20 = 0", 20).withColumnRenamed("id", "vec_id")
