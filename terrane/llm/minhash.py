"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Each element of a set throws values j + r (r uniform in [0, 1)) at slots in the order of a random
permutation of its own, j = 0, 1, ...; a slot keeps its minimum. All elements of all documents of a
block throw at once, and a document stops as soon as every slot holds less than j.

Texts with the same set are one class. A class goes to one bucket for each band of its signature. In
each bucket every member is verified against one pivot; links so found give components. Where the
other members of a bucket are not yet all in one component, rounds follow: some members outside its
largest component, drawn by hash, are pivots for all members of other components, and links found
give larger components. Each round takes eight times the pivots of the last and ends for a bucket when
it is one component, or when all members outside the largest one have been pivots. So near copies that
are linked only through others cost a few times their number, not its square. Pairs whose signatures
agree in enough slots are verified on their full sets. A large group of copies is sent once, however
many members it has. No bucket is capped and no pair is written out unverified.

A text without words, or null, has an empty set and is linked with nothing. Rows with a null id are
linked with nothing and kept. Rows that share an id count as one document in links. An empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as t
from .graph import UnionFind, components
from .spaces import map_blocks, written

BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
#: Pairs whose signatures agree in fewer slots than the threshold less this share are not verified (six standard deviations).
MARGIN = 0.2
GROUP = 256
#: Pivots of a bucket in the first of the later rounds; each round takes eight times as many.
PIVOTS = 32


def signatures(h: np.ndarray, doc: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each document's distinct elements, as 16-bit values (n x slots)."""
    best = np.full(n * slots, np.inf)
    alive = np.arange(len(h))
    order = None
    for j in range(slots):
        draw = t.mix(h[alive] + np.uint64((j + 1) * int(t.BASE) & (1 << 64) - 1))
        value = j + (draw >> np.uint64(20)).astype(np.float64) * 2.0**-44
        k = j + (t.mix(draw) % np.uint64(slots - j)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            row = np.arange(len(alive))
            slot = order[row, k].astype(np.int64)
            order[row, k] = order[:, j]
        np.minimum.at(best, doc[alive] * slots + slot, value)
        full = best.reshape(n, slots).max(1) < j + 1
        stay = ~full[doc[alive]]
        if j == 0:
            alive, k = alive[stay], k[stay]
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(alive), 1))
            order[np.arange(len(alive)), k] = 0
        elif not stay.all():
            alive, order = alive[stay], order[stay]
        if not len(alive):
            break
    return (t.mix(best.view(np.uint64)) >> np.uint64(48)).astype(np.uint16).reshape(n, slots)


def shingle_sets(block: t.Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with their documents, sorted, and where each document's begin."""
    low = block.lower()
    s, e, doc = t.words(low)
    h, doc = t.distinct(*t.shingles(t.hashes(t.prefix_hash(low.data), s, e), doc, len(block), size))
    return h, doc, np.searchsorted(doc, np.arange(len(block) + 1))


def enough(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(a), len(b)))
    return 100 * low >= percent * high and enough(common(a, b), len(a), len(b), percent)


def _verify(percent: int):
    def run(batches):
        for b in batches:
            sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(k)] for k in (2, 3)]
            keep = [similar(x, y, percent) for x, y in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


def _compare(percent: int):
    """Links between different components: a block of pivots (side 0) against a block of all members (side 1)."""

    def run(table: pa.Table) -> pa.Table:
        ids, roots, side, pivot = (table.column(c).to_numpy() for c in ("rep", "root", "side", "pivot"))
        sig = np.frombuffer(b"".join(x.as_py() for x in table.column("sig")), np.uint16).reshape(len(ids), SLOTS)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        nodes, of = np.unique(roots, return_inverse=True)
        joined, found, pairs = UnionFind(len(nodes)), [], []
        cols = np.flatnonzero(side == 1)
        for x in np.flatnonzero(side == 0):
            agree = (sig[x] == sig[cols]).sum(1)
            # two pivots meet in two groups and count in one
            near = (agree >= (percent / 100 - MARGIN) * SLOTS) & (roots[x] != roots[cols]) & (~pivot[cols] | (ids[x] < ids[cols]))
            pairs += zip((-agree[near]).tolist(), [int(x)] * int(near.sum()), cols[near].tolist(), strict=True)
        for _, x, y in sorted(pairs):
            if joined.find(of[x]) != joined.find(of[y]) and similar(sets[x], sets[y], percent):
                joined.union(of[x], of[y])
                found.append((ids[x], ids[y]))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _compared(placed: DataFrame, sets: DataFrame, wanted: int, percent: int) -> DataFrame:
    """Links that pivots of buckets find: about `wanted` members outside the largest component, or all where these are no more."""
    outside = F.col("root") != F.col("largest")
    drawn = F.pmod(F.xxhash64(F.lit(wanted), "rep"), F.greatest("few", F.lit(1))) < wanted
    rows = placed.withColumn("pivot", outside & drawn).select("bucket", "rep", "root", "pivot", F.ceil(F.least("few", F.lit(wanted)) / GROUP).cast("int").alias("heads"), F.ceil(F.col("n") / GROUP).cast("int").alias("all"))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("pivot").select("bucket", "rep", "root", "pivot", F.lit(0).alias("side"), place("heads").alias("i"), every("all").alias("j"))
    right = rows.select("bucket", "rep", "root", "pivot", F.lit(1).alias("side"), every("heads").alias("i"), place("all").alias("j"))
    return left.unionByName(right).join(sets, "rep").groupBy("bucket", "i", "j").applyInArrow(_compare(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id it reaches by links) and kept."""

    def sign(block, rows):
        n = len(block)
        h, doc, cut = shingle_sets(block, words)
        sums = np.zeros((2, len(h) + 1), np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(t.mix(h), out=sums[0, 1:], dtype=np.uint64)
            np.cumsum(t.mix(h ^ t.BASE), out=sums[1, 1:], dtype=np.uint64)
            f = sums[:, cut[1:]] - sums[:, cut[:-1]]
        sig = signatures(h, doc, n)
        keys = np.empty((n, BANDS), np.uint64)
        for b in range(BANDS):
            part = [sig[:, b * ROWS + r].astype(np.uint64) for r in range(ROWS)]
            keys[:, b] = t.combine(np.full(n, b, np.uint64), *part)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
        return [rows.column(0), np.diff(cut), f[0].view(np.int64), f[1].view(np.int64), bands]

    signed = written(map_blocks(docs.withColumn(id_col, F.col(id_col).cast("long")), text_col, [id_col], "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>", sign), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    ordered = F.struct(F.xxhash64("rep").alias("h"), "rep")
    pivots = members.groupBy("bucket").agg(F.min(ordered)["rep"].alias("pivot"), F.count("*").alias("n")).where("n > 1")
    shared = written(members.join(pivots, "bucket").where("rep <> pivot").select("bucket", "rep", "pivot"), "shared")
    wanted = shared.select(F.explode(F.array("rep", "pivot")).alias("rep")).distinct()

    def gather(block, rows):
        h, doc, cut = shingle_sets(block, words)
        sig = signatures(h, doc, len(block))
        return [rows.column(0), [s.tobytes() for s in sig], [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]]

    chosen = docs.select(docs[id_col].cast("long").alias("rep"), docs[text_col].alias("text")).join(wanted, "rep", "left_semi")
    sets = written(map_blocks(chosen, "text", ["rep"], "rep long, sig binary, shingles binary", gather), "sets")

    pairs = shared.select("rep", "pivot").distinct()
    own = sets.select("rep", F.col("shingles").alias("x"))
    other = sets.select(F.col("rep").alias("pivot"), F.col("shingles").alias("y"))
    links = written(pairs.join(own, "rep").join(other, "pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"), "x", "y").mapInArrow(_verify(percent), "a long, b long"), "verified")
    roots = written(components(links), "roots")

    open_, pivots_wanted = shared.select("bucket", "rep"), PIVOTS
    while True:
        placed = open_.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
        each = placed.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("mark"))
        unsure = each.groupBy("bucket").agg(F.sum("k").alias("n"), F.sum("mark").alias("mark"), F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
        unsure = unsure.groupBy("mark", "n").agg(F.min(F.struct("bucket", "top")).alias("x"))  # buckets with the same members
        unsure = written(unsure.select("x.bucket", F.col("x.top.root").alias("largest"), (F.col("n") - F.col("x.top.k")).alias("few"), "n"), "unsure")
        if unsure.isEmpty():
            break
        placed = written(placed.join(unsure, "bucket"), "placed")
        found = written(_compared(placed, sets, pivots_wanted, percent), "late")
        joined = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = written(components(joined.unionByName(found)), "roots")
        open_ = placed.where(F.col("few") > pivots_wanted).select("bucket", "rep")
        pivots_wanted *= 8

    named = classes.select("f1", "f2", "n_shingles", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def contract(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, words=3, percent=85)
