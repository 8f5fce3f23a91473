"""LM scoring: cross-entropy difference between matched target and background models of words.

The target model learns from the documents labelled good, the background from all documents; both
count the same vocabulary, lower-cased words by their hashes (64 bits, pairs of them 56), and both are mixtures in the log
domain of a unigram model (weight 1 - MIX) and a bigram model (weight MIX), smoothed additively, the
background in proportion to its size, so what neither has seen costs the same in both. Of each token
the loss under the target less the loss under the background is taken, the end of a text being a
token too; the score of a document is the mean (below 0: closer to the target).

Every document is scored by what all other documents hold: its own counts are taken off both models
before the logarithm (leave one out), so no text is scored by a model that has seen it, while a copy
of it elsewhere counts.

A block of documents sends each pair (document, bigram) and (document, word) once, with its count,
packed and cut by hash into parts whose number follows the tokens. A part adds up its counts over all
documents and sends back, for each document, one sum of logarithms. Nothing of the vocabulary is
gathered on the driver or broadcast; every exchange grows in proportion to the tokens. The ids of good
documents are broadcast if they are counted to be BROADCAST_IDS numbers at most; more are joined.

Null and empty texts have no tokens and score 0. Rows with a null id are scored alike, and are no
target; repeated rows count as often as they occur; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import textops as t
from .packed import pack_keys, pack_numbers, unpack_keys, unpack_numbers
from .spaces import map_blocks

#: Number of words that additive smoothing of the bigram model reckons with.
VOCABULARY = 1 << 20
SMOOTHING = 1.0
MIX = 0.5
BLOCK_BYTES = 4 << 20
PART_TOKENS = 1 << 20
BROADCAST_IDS = 1 << 21
KEY_BITS = 56


class Entries:
    """What a block of documents holds: distinct (key, document) with their counts, by key.

    An even key is a bigram, an odd one a word; the word 0 is the place before the first and after the last word.
    """

    def __init__(self, block: t.Block):
        low = block.lower()
        s, e, doc = t.words(low)
        word = np.maximum(t.hashes(t.prefix_hash(low.data), s, e), np.uint64(1))
        self.words = np.bincount(doc, minlength=len(block))
        full = np.flatnonzero(self.words)
        ends = np.cumsum(self.words[full])
        after, owner = np.insert(word, ends, np.uint64(0)), np.insert(doc, ends, full)
        before = np.roll(after, 1)  # each text begins behind an end
        pair, single = (t.combine(*x) >> np.uint64(64 - KEY_BITS) for x in ((before, after), (after,)))
        pair, single = pair & ~np.uint64(1), single | np.uint64(1)
        key, owner = np.concatenate([pair, single]), np.concatenate([owner, owner])
        order = np.argsort(key, kind="stable")  # documents ascend within a key if they ascend in both halves
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        self.key, self.doc, self.count = key[start], owner[start], np.diff(start, append=len(key))


def log_ratio(key: np.ndarray, background: np.ndarray, target: np.ndarray, ratio: float) -> np.ndarray:
    """A key's share of one loss difference; `ratio` is background size / target size."""
    up = lambda s: np.log(background + s * ratio) - np.log(target + s)
    return np.where(key & np.uint64(1), (1 - MIX) * up(SMOOTHING) - MIX * up(SMOOTHING * VOCABULARY), MIX * up(SMOOTHING))


def lm_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, n_tokens (words) and score, the mean loss difference per token."""
    id_kind = docs.schema[id_col].dataType.simpleString()
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast(id_kind).alias("good")).where("good is not null").distinct()
    if id_kind in ("int", "bigint") and good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def flagged(df, *columns):
        return df.join(good, F.col("doc_id") == F.col("good"), "left").select("doc_id", F.col("good").isNotNull().alias("target"), *columns)

    counted = map_blocks(texts, "text", ["doc_id"], f"doc_id {id_kind}, n long", lambda block, rows: [rows.column(0), [n + (n > 0) for n in np.bincount(t.words(block)[2], minlength=len(block)).tolist()]])
    sizes = {r["target"]: r["n"] for r in flagged(counted, "n").groupBy("target").agg(F.sum("n").alias("n")).collect()}  # two rows
    seen, total = sizes.get(True, 0), sum(sizes.values())
    ratio = (total + 1) / (seen + 1)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART_TOKENS + 1)

    sent = StructType.fromDDL("part int, block long, keys binary, times binary, docs binary, counts binary, n int")
    about = StructType.fromDDL(f"ids array<{id_kind}>, target array<boolean>, words array<long>")
    back = StructType.fromDDL("block long, docs binary, sums binary")

    def send(batches):
        schema = to_arrow_schema(StructType([*sent.fields, *about.fields]))
        block_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in t.blocks(batch.column(2), BLOCK_BYTES):
                e, rows = Entries(block), batch.slice(block.first, len(block))
                target = rows.column(1).to_numpy(zero_copy_only=False)
                part = ((e.key >> np.uint64(KEY_BITS - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                used, start = np.unique(part, return_index=True)
                columns: tuple[list, ...] = ([], [], [], [])
                for a, b in zip(start, [*start[1:], len(part)], strict=True):
                    new = np.flatnonzero(np.append(True, e.key[a + 1 : b] != e.key[a : b - 1]))
                    packed = pack_keys(e.key[a:b][new]), pack_numbers(np.diff(new, append=b - a)), pack_numbers(2 * e.doc[a:b] + target[e.doc[a:b]]), pack_numbers(e.count[a:b])
                    for column, x in zip(columns, packed, strict=True):
                        column.append(x)
                n = np.diff(start, append=len(part))
                head = [[int(block_id % parts)], [block_id], [None], [None], [None], [None], [0], [rows.column(0).to_pylist()], [target.tolist()], [e.words.tolist()]]
                body = [used, [block_id] * len(used), *columns, n, *([None] * len(used) for _ in about.fields)]
                yield pa.RecordBatch.from_arrays([pa.array([*a, *b], f.type) for a, b, f in zip(head, body, schema, strict=True)], schema=schema)
                block_id += 1
        pa.default_memory_pool().release_unused()

    def answer(table: pa.Table) -> pa.Table:
        heads = table.filter(pa.compute.is_null(table.column("keys"))).select(["block", "ids", "target", "words"])
        table = table.filter(pa.compute.is_valid(table.column("keys")))
        columns = [heads.column("block"), *([pa.nulls(heads.num_rows, pa.binary())] * 2), *heads.columns[1:]]
        heads = pa.Table.from_arrays(columns, schema=to_arrow_schema(StructType([*back.fields, *about.fields])))
        if not table.num_rows:
            return heads
        sizes = table.column("n").to_numpy()
        keys = [unpack_keys(x.as_py()) for x in table.column("keys")]
        times = np.concatenate([unpack_numbers(x.as_py(), len(k)) for x, k in zip(table.column("times"), keys, strict=True)])
        doc, count = (np.concatenate([unpack_numbers(x.as_py(), n) for x, n in zip(table.column(c), sizes, strict=True)]) for c in ("docs", "counts"))
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        of = np.repeat(of, times)
        own = count * (doc & 1)
        background, target = np.bincount(of, count, len(distinct)), np.bincount(of, own, len(distinct))
        value = count * log_ratio(distinct[of], background[of] - count, target[of] - own, ratio)
        place = np.repeat(np.arange(len(sizes)), sizes) << 40 | doc >> 1
        order = np.argsort(place, kind="stable")
        start = np.flatnonzero(np.diff(place[order], prepend=-1))
        sums, place = np.add.reduceat(value[order], start), place[order][start]
        cuts = np.searchsorted(place >> 40, np.arange(len(sizes) + 1))
        pieces = [(pack_numbers(place[a:b] & (1 << 40) - 1), sums[a:b].astype("<f4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = [table.column("block"), *(pa.array(x, pa.binary()) for x in zip(*pieces, strict=True)), *(pa.nulls(len(sizes), f.type) for f in list(heads.schema)[3:])]
        return pa.concat_tables([heads, pa.Table.from_arrays(columns, schema=heads.schema)])

    def score(table: pa.Table) -> pa.Table:
        head = table.filter(pa.compute.is_valid(table.column("ids")))
        ids, target, words = (head.column(c).combine_chunks().flatten() for c in ("ids", "target", "words"))
        words, target = words.to_numpy(), target.to_numpy(zero_copy_only=False)
        total_ = np.zeros(len(words))
        for docs_, sums in zip(table.column("docs").to_pylist(), table.column("sums").to_pylist(), strict=True):
            if sums is not None:
                values = np.frombuffer(sums, "<f4")
                total_[unpack_numbers(docs_, len(values))] += values
        n = words + 1
        sizes_ = np.log(seen - n * target + SMOOTHING * VOCABULARY) - np.log(total - n + SMOOTHING * VOCABULARY * ratio)
        mean = np.where(words > 0, total_ / n + (1 - MIX) * sizes_, 0.0)
        return pa.table({"doc_id": ids, "n_tokens": pa.array(words), "score": pa.array(mean)})

    asked = flagged(texts, "text").mapInArrow(send, StructType([*sent.fields, *about.fields]))
    answered = asked.groupBy("part").applyInArrow(answer, StructType([*back.fields, *about.fields]))
    return answered.groupBy("block").applyInArrow(score, f"doc_id {id_kind}, n_tokens long, score double")


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores, and whether the text is closer to the target than to the background."""
    return lm_scores(docs, labels).withColumn("closer_to_target", F.col("score") < 0)
