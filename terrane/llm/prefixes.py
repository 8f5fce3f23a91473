"""The prefix trie of conversations: a count-min sketch proves prefixes single, only the rest is grouped.

Turns become digests at once (two 64-bit hashes of role and text), so no text is shuffled. The digest
of a prefix is the exclusive or of its turns' digests, each hashed with its place; it comes from
running folds that also cross tasks, so a conversation may have any number of turns. All prefixes go
into a count-min sketch of DEPTH rows whose counters stop at two; its width follows the number of
prefixes, up to 2**MOST_BITS counters a row, and what is broadcast is one bit for each counter. An
estimate of one proves that a single conversation has the prefix, and so all its longer ones: these
tails are emitted where they are, without a shuffle of their own. Only prefixes shorter than the first
one proven single are grouped exactly. A wider input than the sketch is made for leaves more to group
and changes no result.

Leaves and saved tokens of subtrees need no walk down the tree: every node is counted with its
smallest member, so a node's sums are sums over its members, less what its own smallest member
counts above it.

Turns are ordered by number, null first, turns of one number by their digests. Null roles and texts
are empty. Rows without a conversation id take no part; repeated rows are turns of their own. An empty
table gives no rows, not even a root; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as t
from .packed import pack_keys, unpack_keys
from .spaces import written

DEPTH = 3
MOST_BITS = 27
CHUNK_BITS = 20
NODE = ["d", "a", "b"]


def running(rows: DataFrame, key: str, order: list[str], folds: dict[str, str], name: str) -> DataFrame:
    """The rows with columns folded ("sum" or "bit_xor") along an order within each key, up to and with each row.

    Rows are dealt by ranges of key and order; what a key has in earlier ranges is added to its later ones.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, key, *order).withColumn("part", F.spark_partition_id()), name)
    fold = lambda c: getattr(F, folds[c])(c)
    upto = Window.partitionBy(key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select(*[c for c in rows.columns if c not in folds], "part", *(fold(c).over(upto).alias(c) for c in folds))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(key, "part").agg(*(fold(c).alias(c) for c in folds))  # one row for each range that a key reaches into
    carried = ends.select(key, "part", *(fold(c).over(earlier).alias(f"was_{c}") for c in folds)).where(f"was_{next(iter(folds))} is not null")
    both = lambda c: F.coalesce(F.col(c) + F.col(f"was_{c}") if folds[c] == "sum" else F.col(c).bitwiseXOR(F.col(f"was_{c}")), F.col(c)).alias(c)
    return local.join(carried, [key, "part"], "left").select(*(both(c) if c in folds else c for c in rows.columns))


def digested(turns: DataFrame) -> DataFrame:
    """(c, pos, a, b, n): the turns of each conversation, numbered from 0, as digests and code points."""
    role, text = (F.coalesce(turns[x].cast("string"), F.lit("")) for x in ("role", "text"))
    rows = turns.select(turns["conv_id"].cast("long").alias("c"), turns["turn"].alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.length(text).cast("long").alias("n"), F.lit(1).cast("long").alias("pos"))
    counted = running(rows.where("c is not null"), "c", ["turn", "a", "b"], {"pos": "sum"}, "turns")
    return counted.select("c", (F.col("pos") - 1).alias("pos"), "a", "b", "n")


def cells(keys: np.ndarray, bits: int) -> np.ndarray:
    """The counters of each key, a line for each row of the sketch."""
    return np.stack([t.mix(keys ^ np.uint64((k * int(t.BASE)) & (1 << 64) - 1)) >> np.uint64(64 - bits) for k in range(1, DEPTH + 1)])


def _keys(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    return t.combine(a, b)


def sketch(prefixes: DataFrame, bits: int) -> np.ndarray:
    """One bit for each counter (DEPTH lines of 2**bits), set where it counts more than one."""
    chunk_bits = min(bits, CHUNK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_keys(b) for b in batches if b.num_rows]
        if not held:
            return
        for line, cell in enumerate(cells(np.concatenate(held), bits)):
            used, times = np.unique(cell, return_counts=True)
            chunk, begin = np.unique(used >> np.uint64(chunk_bits), return_index=True)
            for k, a, b in zip(chunk.tolist(), begin, [*begin[1:], len(used)], strict=True):
                yield pa.RecordBatch.from_pydict({"line": pa.array([line], pa.int32()), "chunk": pa.array([k], pa.int32()), "used": pa.array([pack_keys(used[a:b])], pa.binary()), "twice": pa.array([np.packbits(times[a:b] > 1).tobytes()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        times = np.zeros(1 << chunk_bits, np.uint8)
        for used, twice in zip(table.column("used").to_pylist(), table.column("twice").to_pylist(), strict=True):
            cell = (unpack_keys(used) & np.uint64((1 << chunk_bits) - 1)).astype(np.int64)
            more = 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(cell))
            times[cell] = np.minimum(times[cell] + more, 2)  # counters stop at two
        return pa.table({"line": table.column("line").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(times > 1).tobytes()], pa.binary())})

    counted = prefixes.select("a", "b").mapInArrow(count, "line int, chunk int, used binary, twice binary")
    out = np.zeros((DEPTH, max(1, (1 << bits) // 8)), np.uint8)
    size = max(1, (1 << chunk_bits) // 8)
    for row in counted.groupBy("line", "chunk").applyInArrow(merge, "line int, chunk int, bits binary").toLocalIterator():  # of a size bounded by MOST_BITS
        out[row["line"], row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def screened(prefixes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The prefixes with `single`, true where the sketch proves that one conversation alone has them."""
    bits = min(most_bits, max(3, int(4 * prefixes.count() + 1).bit_length()))
    shared = prefixes.sparkSession.sparkContext.broadcast(sketch(prefixes, bits))
    names = prefixes.columns

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            twice = np.ones(batch.num_rows, bool)
            for line, cell in zip(shared.value, cells(_keys(batch), bits), strict=True):
                at = cell.astype(np.int64)
                twice &= (line[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(~twice)], names=[*names, "single"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema)
    return prefixes.mapInArrow(estimate, f"{kinds}, single boolean")


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the decimal ids of each node in ascending order, joined by commas.

    Ids are sorted in ranges, so a node's may lie in many tasks. These pass on what they hold of the
    first and last node as text, and the digest of such a node runs over its texts one by one.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.repartitionByRange(parts, *NODE, "c").sortWithinPartitions(*NODE, "c").withColumn("part", F.spark_partition_id())
    schema = "d long, a long, b long, part int, ends_sha256 string, ids binary"

    def lists(batches):
        """(node, ids of one batch) in order."""
        for batch in batches:
            if batch.num_rows:
                node = np.stack([batch.column(c).to_numpy() for c in NODE])
                ids, part = batch.column("c").to_pylist(), batch.column("part")[0].as_py()
                begin = [0, *(np.flatnonzero((node[:, 1:] != node[:, :-1]).any(0)) + 1).tolist(), len(ids)]
                for x, y in zip(begin, begin[1:], strict=False):
                    yield tuple(node[:, x].tolist()), part, ",".join(map(str, ids[x:y])).encode()

    def row(node, part, digest, ids):
        return pa.RecordBatch.from_pydict({**{c: pa.array([v], pa.int64()) for c, v in zip(NODE, node, strict=True)}, "part": pa.array([part], pa.int32()), "ends_sha256": pa.array([digest], pa.string()), "ids": pa.array([ids], pa.binary())})

    def inner(batches):
        first, node, state, done = None, None, None, []
        for at, part, ids in lists(batches):
            first = first or at
            if at != node:
                if state is not None and node != first:
                    done.append((node, part, state.hexdigest()))
                state, node, pending = hashlib.sha256(), at, None
                if len(done) >= 5000:
                    yield whole(done)
                    done = []
            if at == first:
                yield row(at, part, None, ids)
                continue
            if pending is None:
                pending = []
                state.update(ids)
            else:
                state.update(b"," + ids)
            pending.append(ids)
        if done:
            yield whole(done)
        if node is not None and node != first:
            for ids in pending:  # the last node may go on in the next task
                yield row(node, part, None, ids)

    def whole(done):
        cols = {c: pa.array([x[0][k] for x in done], pa.int64()) for k, c in enumerate(NODE)}
        return pa.RecordBatch.from_pydict({**cols, "part": pa.array([x[1] for x in done], pa.int32()), "ends_sha256": pa.array([x[2] for x in done], pa.string()), "ids": pa.array([None] * len(done), pa.binary())})

    def chained(batches):
        node, state = None, None
        out = []
        for batch in batches:
            for d, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if (d, a, b) != node:
                    if state is not None:
                        out.append((node, 0, state.hexdigest()))
                    node, state = (d, a, b), hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            if len(out) >= 5000:
                yield whole(out).select([*NODE, "ends_sha256"])
                out = []
        if state is not None:
            out.append((node, 0, state.hexdigest()))
        if out:
            yield whole(out).select([*NODE, "ends_sha256"])

    found = written(dealt.mapInArrow(inner, schema), "ends")
    crossing = found.where("ids is not null").select(*NODE, "part", "ids")
    order = F.substring_index(F.substring("ids", 1, 24).cast("string"), ",", 1).cast("long")
    crossing = crossing.withColumn("least", order).repartition(parts, *NODE).sortWithinPartitions(*NODE, "part", "least")
    return found.where("ids is null").select(*NODE, "ends_sha256").unionByName(crossing.mapInArrow(chained, "d long, a long, b long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, lengths: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The nodes of the trie of turns(c, pos, a, b, n); lengths(c, turns) names every conversation, those without turns too.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    d = F.col("pos") + 1
    places = turns.select("c", d.alias("d"), F.xxhash64("a", d).alias("a"), F.xxhash64("b", d).alias("b"), "n")
    own = places.select("c", "d", "n", F.col("a").alias("own_a"), F.col("b").alias("own_b"), "a", "b")
    folded = running(own, "c", ["d"], {"a": "bit_xor", "b": "bit_xor"}, "places")
    prefixes = written(folded.select("c", "d", "n", "a", "b", F.col("a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("up_b")), "prefixes")
    judged = written(screened(prefixes, most_bits), "judged")

    first = judged.where("single").groupBy("c").agg(F.min("d").alias("single_from"))
    convs = written(lengths.join(first, "c", "left").select("c", F.col("turns").alias("len"), "single_from"), "lengths")
    placed = judged.drop("single").join(convs, "c")
    root = convs.select("c", F.lit(0).cast("long").alias("d"), *(F.lit(0).cast("long").alias(x) for x in ("n", "a", "b", "up_a", "up_b")), "len", "single_from")
    grouped = written(placed.where("single_from is null or d < single_from").select(root.columns).unionByName(root), "grouped")
    tails = placed.where("d >= single_from")

    nodes = written(grouped.groupBy(*NODE).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("len").alias("deepest"), *(F.min(x).alias(x) for x in ("n", "up_a", "up_b"))), "nodes")
    worth = nodes.select("conv_id", *NODE, ((F.col("n_convs") - 1) * F.col("n")).alias("value"))
    above = running(worth.withColumn("own", F.col("value")), "conv_id", ["d"], {"value": "sum"}, "worth").select(*NODE, (F.col("value") - F.col("own")).alias("above"))
    per_conv = convs.join(worth.groupBy(F.col("conv_id").alias("c")).agg(F.sum("value").alias("worth")), "c", "left").join(nodes.where("deepest = d").select(F.col("conv_id").alias("c"), F.lit(1).alias("leaf")), "c", "left")
    per_conv = per_conv.select("c", F.coalesce("worth", F.lit(0)).alias("worth"), F.when(F.col("single_from").isNotNull(), 1).otherwise(F.coalesce("leaf", F.lit(0))).cast("long").alias("leaf"))
    sums = grouped.select("c", *NODE).join(per_conv, "c").groupBy(*NODE).agg(F.sum("worth").alias("worth"), F.sum("leaf").alias("n_leaves"))
    up = lambda df: df.select((F.col("d") - 1).alias("d"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    children = up(nodes.where("d > 0")).unionByName(up(tails.where("d = single_from"))).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    named = nodes.select((F.col("d") + 1).alias("d"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    ends = id_digests(grouped.where("d = len").select(*NODE, "c"))

    empty = F.sha2(F.lit("").cast("binary"), 256)
    inside = nodes.join(sums, NODE).join(above, NODE).join(children, NODE, "left").join(ends, NODE, "left").join(named, ["d", "up_a", "up_b"], "left")
    inside = inside.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", (F.col("worth") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tail = lambda df, parent: df.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), (F.col("d") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(F.col("d") == F.col("len"), F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(empty).alias("ends_sha256"))
    edge = tail(tails.where("d = single_from").join(named, ["d", "up_a", "up_b"], "left"), F.col("parent_conv_id"))
    return inside.unionByName(edge).unionByName(tail(tails.where("d > single_from"), F.col("c")))


def lengths_of(turns: DataFrame) -> DataFrame:
    return turns.groupBy("c").agg(F.count("*").alias("turns"))


def trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns = written(digested(conversations), "digested")
    return prefix_trie(turns, lengths_of(turns))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: the first turns of conversation c - c % 100 (the remainder has the sign of c), then the own ones after as many."""
    h: Column = F.crc32(F.col("c").cast("string").cast("binary")) % 6
    own = lengths_of(turns)
    convs = own.select("c", F.col("turns").alias("n_own"), h.alias("h"), (F.col("c") - F.col("c") % 100).alias("base"))
    convs = convs.join(own.select(F.col("c").alias("base"), F.col("turns").alias("n_base")), "base", "left")
    convs = convs.select("c", "base", "h", "n_own", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    kept = turns.join(convs, "c").where("pos >= h").select("c", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "a", "b", "n")
    heads = turns.where("pos < 5 and c % 100 = 0").withColumnRenamed("c", "base").join(convs, "base").where("pos < taken").select("c", "pos", "a", "b", "n")
    return heads.unionByName(kept), convs.select("c", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("turns"))


def contract(conversations: DataFrame) -> DataFrame:
    return prefix_trie(*rebuilt(written(digested(conversations), "digested")))
