"""Vectorised text primitives shared by the operators: words, hashes and spans over Arrow buffers.

A block is a run of documents whose UTF-8 bytes lie in one numpy array; all work below is
done on whole blocks, so the Python cost is per block and not per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
KEPT_POWERS = 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: White space of the word pattern [^\x20\x09-\x0D]+, by byte.
SPACE = _space
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64. Those of very long texts are not kept."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    made = []
    for base in (BASE, BASE_INVERSE):
        a = np.full(n + 1, base, np.uint64)
        a[0] = 1
        with np.errstate(over="ignore"):
            made.append(np.cumprod(a, dtype=np.uint64))
    if n <= KEPT_POWERS:
        _powers[:] = made
    return made[0], made[1]


def large(column: pa.Array) -> pa.LargeStringArray:
    """The column as large strings; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


class Block:
    """Bytes of consecutive documents: data, offsets (n + 1) and where they start in the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode()

    def lower(self) -> Block:
        return Block(LOWER[self.data], self.offsets, self.first)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of about `limit` bytes; a longer text is a block of its own."""
    column = large(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield Block(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of true bytes; runs never cross documents."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.ones(n, bool)
    first[1:] = ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.ones(n, bool)
    last[:-1] = first[1:] | ~inside[1:]
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and document of every word."""
    return spans_of(~SPACE[block.data], block.offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    p = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODES[data] * powers(len(data))[0][: len(data)], dtype=np.uint64, out=p[1:])
    return p


def hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from the prefix sums of their block: equal bytes, equal hashes."""
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64) * BASE)


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash for a tuple of hashes, order kept."""
    out = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix(out * BASE + p)
    return out


def counts(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Rows (or their weights) of each of n documents."""
    got = np.bincount(doc, weights=weights, minlength=n)
    return got.astype(np.int64) if weights is not None else got


def shingles(h: np.ndarray, doc: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of `size` words; of a text with fewer words, its whole sequence."""
    per = np.bincount(doc, minlength=n)
    full = np.flatnonzero(doc[size - 1 :] == doc[: len(doc) - size + 1]) if len(doc) >= size else np.zeros(0, np.int64)
    out, owner = combine(*(h[full + k] for k in range(size))), doc[full]
    short = np.flatnonzero((per > 0) & (per < size))
    if len(short):
        at = np.searchsorted(doc, short)
        tail = []
        for d, s in zip(short, at, strict=True):
            x = np.full(1, 0x51ED270B, np.uint64)
            for k in range(per[d]):
                x = combine(x, h[s + k : s + k + 1])
            tail.append(x[0])
        out, owner = np.concatenate([out, np.array(tail, np.uint64)]), np.concatenate([owner, short])
    return out, owner


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, by document and then hash."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position (n + 1 values)."""
    p = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=p[1:])
    return p
