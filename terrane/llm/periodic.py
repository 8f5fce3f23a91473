"""Periodic runs of words: multi-scale minimizers seed them, direct lag scans find those of short period.

A run is a stretch of words of smallest period q, at least max(min_words, 3 q) long, that no
neighbouring word extends. Periods below DIRECT are found by comparing each word with the one q before
it. Longer ones belong to scales [low, high] with high = 1.5 low - 1. In a scale, windows of
2 low - high + 1 k-grams (k = high words) choose their least k-gram by hash, the leftmost of equals.
A run of period q in the scale holds such a window and, q words on, the same window again, so both
choose the same k-gram at a distance of q; and since k >= q, equal k-grams of one run lie at multiples
of q only, so the two are neighbours among equal choices. Every such pair of neighbours whose distance
lies in the scale is extended to both sides as far as the period holds. Stretches that several
distances report keep the smallest, which is their period. So no run is missed.

All documents of a block are done at once in arrays; there is no shuffle. A text without words, or
null, has no runs and an empty collapsed text. A null id stays null, repeated rows are done one by
one, an empty table gives no rows, and other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as t
from .spaces import map_blocks

MIN_WORDS = 24
REPEATS = 3
DIRECT = 12


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """Least and greatest period of each scale up to the longest period."""
    low = DIRECT
    while low <= longest:
        high = max(low, low * 3 // 2 - 1)
        yield low, high
        low = high + 1


def lag_runs(h: np.ndarray, doc: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal stretch of period q that has at least `least` words."""
    same = np.zeros(len(h) + 1, np.int8)
    same[1 : len(h) - q + 1] = (h[q:] == h[:-q]) & (doc[q:] == doc[:-q])
    step = np.diff(same)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start + q >= least
    return start[long], end[long] + q


def sliding_min(key: np.ndarray, size: int) -> np.ndarray:
    """Least value of each window of `size` values."""
    width = 1
    while 2 * width <= size:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    rest = size - width
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


class Words:
    """Word hashes of a block with their documents' first words and ends, and sums that give the hash of any stretch."""

    def __init__(self, h: np.ndarray, doc: np.ndarray, n_docs: int):
        self.h, self.doc, n = h, doc, len(h)
        per = np.bincount(doc, minlength=n_docs)
        last = np.cumsum(per)
        self.begin, self.end = (last - per)[doc], last[doc]
        up, self.down = t.powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(h * up[:n], dtype=np.uint64, out=self.sums[1:])

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [a, b): equal words, equal hashes."""
        with np.errstate(over="ignore"):
            return (self.sums[b] - self.sums[a]) * self.down[a]

    def extended(self, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximal stretch of period lag around words at and at + lag."""
        low, high = at.copy(), at + lag
        first, end = self.begin[at], self.end[at]
        for k in range(max(int((end - first).max()), 1).bit_length(), -1, -1):
            step = 1 << k
            ok = np.flatnonzero(high + step <= end)
            ok = ok[self.span(high[ok], high[ok] + step) == self.span(high[ok] - lag[ok], high[ok] - lag[ok] + step)]
            high[ok] += step
            ok = np.flatnonzero(low - step >= first)
            ok = ok[self.span(low[ok] - step, low[ok]) == self.span(low[ok] - step + lag[ok], low[ok] + lag[ok])]
            low[ok] -= step
        return low, high


def seeds(words: Words, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and distances of neighbouring equal choices of a scale's windows, where the distance lies in the scale."""
    n, k = len(words.h), high
    size = 2 * low - high + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = n - size - k + 2
    if starts <= 0:
        return none
    at = np.arange(n - k + 1)
    gram = t.mix(words.span(at, at + k))
    least = sliding_min(gram >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64), size)
    inside = np.arange(starts) + size + k - 1 <= words.end[:starts]
    chosen = (least[:starts][inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(chosen):
        return none
    chosen = chosen[np.append(True, chosen[1:] != chosen[:-1])]  # the leftmost choice only moves on
    order = np.lexsort((chosen, gram[chosen], words.doc[chosen]))
    a, b = chosen[order][:-1], chosen[order][1:]
    pair = (gram[a] == gram[b]) & (words.doc[a] == words.doc[b]) & (b - a >= low) & (b - a <= high)
    return a[pair], (b - a)[pair]


def find_runs(h: np.ndarray, doc: np.ndarray, n_docs: int, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start and then period; numbers of words of the block."""
    none = np.zeros(0, np.int64)
    if len(h) < min_words:
        return none, none, none
    found = []
    for q in range(1, min(DIRECT, len(h) // REPEATS + 1)):
        start, end = lag_runs(h, doc, q, max(min_words, REPEATS * q))
        found.append((start, end, np.full(len(start), q)))
    words = Words(h, doc, n_docs)
    for low, high in scales(int(np.bincount(doc).max()) // REPEATS):
        at, lag = seeds(words, low, high)
        if len(at):
            start, end = words.extended(at, lag)
            long = end - start >= np.maximum(min_words, REPEATS * lag)
            found.append((start[long], end[long], lag[long]))
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def joined(block: t.Block, s: np.ndarray, e: np.ndarray, doc: np.ndarray) -> pa.Array:
    """Each document's words, given by their bytes in the block, joined by one space."""
    n = len(block)
    size = e - s + 1
    if len(s):
        size[np.append(doc[1:] != doc[:-1], True)] -= 1
    total = int(size.sum())
    after = np.cumsum(size)
    out = np.zeros(0, np.uint8)
    if total:
        source = np.arange(total) + np.repeat(s - after + size, size)
        spaces = after[size > e - s] - 1
        source[spaces] = 0
        out = block.data[source]
        out[spaces] = 32
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(doc, weights=size, minlength=n).astype(np.int64), out=offsets[1:])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, order: Callable | None = None) -> DataFrame:
    """One row per document: its runs, the run of greatest exponent (ties: first, then shortest period), and the text without repeats.

    Of each run the words after its first period go; what is left is joined by single spaces. `order`,
    if given, says which of its words stands at each place of a text: from ids, number of words of each
    document and each word's document to numbers of words within documents.
    """

    def find(block, rows):
        n = len(block)
        s, e, doc = t.words(block)
        per = np.bincount(doc, minlength=n)
        first = np.cumsum(per) - per
        if order is not None:
            source = first[doc] + order(rows.column(0).to_pylist(), per, doc)
            s, e = s[source], e[source]
        h = t.hashes(t.prefix_hash(block.data), s, e)
        start, end, period = find_runs(h, doc, n, min_words)
        change = np.zeros(len(h) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        keep = np.cumsum(change[:-1]) == 0
        owner = doc[start]
        count = np.bincount(owner, minlength=n)
        cut = np.zeros(n + 1, np.int32)
        np.cumsum(count, out=cut[1:])
        place, length = start - first[owner], end - start
        runs = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(x) for x in (place, length, period)], names=["start", "length", "period"]))
        best = [max(range(a, b), key=lambda k: (Fraction(int(length[k]), int(period[k])), -place[k], -period[k]), default=None) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        top = [pa.array([None if k is None else int(x[k]) for k in best], pa.int64()) for x in (place, length, period)]
        return [rows.column(0), count, *top, runs, joined(block, s[keep], e[keep], doc[keep])]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_blocks(docs, text_col, [id_col], f"doc_id {kind}, n_runs long, start long, length long, period long, runs array<struct<start:long,length:long,period:long>>, collapsed string", find)


def planted(ids: list, per: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The contract's order of words: of documents whose id's crc32 is divisible by 10 the words from some place on repeat."""
    at = np.arange(len(doc)) - (np.cumsum(per) - per)[doc]
    h = np.array([0 if i is None else zlib.crc32(str(i).encode()) for i in ids], np.int64)
    known = np.array([i is not None for i in ids], bool)
    g, n = h // 10, np.maximum(per, 1)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    repeats = (known & (h % 10 == 0))[doc] & (at >= a[doc])
    return np.where(repeats, a[doc] + (at - a[doc]) % p[doc], at)


def contract(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs, order=planted)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    milli = F.expr("1000 * length div period")
    return found.select("doc_id", "n_runs", "start", "length", "period", milli.alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
