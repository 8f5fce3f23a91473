"""Packing token ids into sequences: vector bin packing by the dot-product heuristic.

A piece has a vector of demands (tokens, segments, loss-bearing tokens) and a sequence has limits on
all three. The open sequence takes the piece whose demand has the largest weighted dot product with
what is left, of all in the pool that fit. When none fits and more than `slack` tokens are left, a
piece is cut. Each task packs its own documents with a pool of bounded size, so nothing is shuffled;
the last sequence of a task is cut into powers of two, which need no padding.

Null and empty texts are their end id alone. A null id stays null; repeated rows are packed one by
one; an empty table has no sequences; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import textops as t
from .bytebpe import byte_bpe

LIMITS = (1024, 64, 1024)
POOL = 2048
SLACK = 8
END_ID = 0


class Packer:
    """Packs documents as they come; a document is (row, ids as bytes, tokens without loss at its start)."""

    def __init__(self, limits: tuple[int, int, int] = LIMITS, pool: int = POOL, slack: int = SLACK):
        self.limits, self.size, self.slack = np.array(limits, np.int64), pool, slack
        self.demand = np.zeros((0, 3), np.int64)
        self.items: list[tuple] = []
        self.sequence = 0

    def _fit(self, start: int, end: int, free: int, left: np.ndarray) -> int:
        """How many tokens from start on fit in what is left."""
        return int(min(end - start, left[0], max(free - start, 0) + left[2])) if left[1] > 0 else 0

    def add(self, row, ids: bytes, free: int = 0) -> Iterator[tuple]:
        """Cuts off what fills sequences alone; the rest waits in the pool, in pieces that fit an empty sequence."""
        n, at = len(ids) // 4, 0
        while at < n:
            k = self._fit(at, n, free, self.limits)
            if k == self.limits[0]:
                yield self._out(row, ids, at, at + k, 0)
                self.sequence += 1
            else:
                self.items.append((row, ids, free, at, at + k))
            at += k

    def _out(self, row, ids, start, end, offset):
        return row, start, end - start, ids[4 * start : 4 * end], len(ids) // 4, self.sequence, offset

    def _vector(self, item) -> tuple[int, int, int]:
        _, _, free, s, e = item
        return e - s, 1, e - max(s, min(free, e))

    def pack(self, down_to: int) -> Iterator[tuple]:
        """Closes sequences until at most down_to pieces wait."""
        if len(self.items) <= down_to:
            return
        demand = np.array([self._vector(x) for x in self.items], np.int64)
        alive = np.ones(len(self.items), bool)
        weight = demand.mean(0) / self.limits**2
        n = len(self.items)
        while n > down_to:
            left, offset = self.limits.copy(), 0
            while n:
                score = np.where(alive & (demand <= left).all(1), demand @ (weight * left), -1.0)
                best = int(score.argmax())
                if score[best] < 0:
                    if left[0] <= self.slack or left[1] < 1:
                        break
                    best = int(np.where(alive, demand[:, 0], -1).argmax())
                row, ids, free, s, e = self.items[best]
                k = self._fit(s, e, free, left)
                if k < 1:
                    break
                yield self._out(row, ids, s, s + k, offset)
                left -= self._vector((row, ids, free, s, s + k))
                offset += k
                if s + k < e:
                    self.items[best] = (row, ids, free, s + k, e)
                    demand[best] = self._vector(self.items[best])
                else:
                    alive[best] = False
                    n -= 1
            if n or down_to or offset == self.limits[0]:
                self.sequence += 1  # else the open sequence is the last one, which finish() deals out again
        self._keep(alive)

    def _keep(self, alive: np.ndarray) -> None:
        self.items = [x for x, a in zip(self.items, alive, strict=True) if a]

    def finish(self) -> Iterator[tuple]:
        """Everything that waits; the sequence that stays open at the end is dealt out again in powers of two."""
        last: list[tuple] = []
        for piece in self.pack(0):
            if last and last[0][5] != piece[5]:
                yield from last
                last = []
            last.append(piece)
        total = sum(x[2] for x in last)
        if total == self.limits[0]:
            yield from last
            last = []
        size, offset = 1 << max(total.bit_length() - 1, 0), 0
        for row, start, length, ids, tokens, _, _ in last:
            at = 0
            while at < length:
                while offset == 0 and size > total:
                    size >>= 1
                k = min(length - at, size - offset)
                yield row, start + at, k, ids[4 * at : 4 * (at + k)], tokens, self.sequence, offset
                at, offset = at + k, offset + k
                if offset == size:
                    total, offset = total - size, 0
                    self.sequence += 1


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, limits: tuple[int, int, int] = LIMITS, pool: int = POOL, slack: int = SLACK) -> DataFrame:
    """One row per piece: the id, its place in the document and in its sequence, and its ids (unsigned 32-bit).

    prompt_col names a text that goes before the text and bears no loss; without it every id bears loss.
    limits are the most tokens, segments and loss-bearing tokens of a sequence.
    """
    kind = StructType.fromDDL(f"doc_id {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches):
        import pyarrow as pa

        schema, packer, bpe = to_arrow_schema(kind), Packer(limits, pool, slack), byte_bpe(tokenizer)
        task = TaskContext.get().partitionId() << 40

        def rows(pieces):
            got = list(pieces)
            if got:
                cols = list(zip(*got, strict=True))
                cols[5] = [task + x for x in cols[5]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        def take(ids, texts, prompts):
            for row, x, p in zip(ids, texts, prompts, strict=True):
                yield from packer.add(row, p + x + end, len(p) // 4)

        for batch in batches:
            for block in t.blocks(batch.column(1)):
                part = batch.slice(block.first, len(block))
                texts = bpe.encode([block.text(i) for i in range(len(block))])
                prompts = bpe.encode([x or "" for x in part.column(2).to_pylist()]) if prompt_col else [b""] * len(texts)
                yield from rows(take(part.column(0).to_pylist(), texts, prompts))
                if len(packer.items) >= pool:
                    yield from rows(packer.pack(pool // 2))
        yield from rows(packer.finish())

    named = [docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *([docs[prompt_col].alias("prompt")] if prompt_col else [])]
    return docs.select(*named).mapInArrow(run, kind)


def contract(docs: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
