"""Long matches between documents from run-compressed Burrows-Wheeler indexes.

Every window of SPAN bytes chooses a seed: the least of its SEED-grams by hash, the leftmost of equals.
Consecutive windows with the same seed make a segment, the text that they cover. Equal windows choose
equal seeds, so all places of a window lie in segments of one seed, and seeds are dealt to parts by
hash.

First blocks of documents send the hashes of their seeds, each once, and parts answer which of them
other blocks or documents hold too. Only segments of such seeds can match. Blocks send these texts,
each distinct one once, with the places where it stands. A part indexes its distinct segments: suffix
order by doubling ranks, the transform of Burrows and Wheeler as runs, positions sampled at both ends
of each run, and for each stretch of suffixes that agree in SPAN bytes the first document that holds
one. Then every segment is streamed through the index from right to left: a suffix follows the run it
stands in, or jumps to the nearer end of the next run of the byte wanted, so each place gets the
length of its longest match (up to SPAN) and the row that shows it. Where that reaches SPAN the row
leads to the first document with this window; it is a match if that document's id is smaller.

A seed held by more than CROWD blocks is dealt by its windows instead, each a segment of its own, so
no seed's contexts meet in one part. Blocks are dealt by a hash of id and text, so their size is bounded but for
single long texts and rows that repeat whole. Nothing is capped.

A null text is empty and stays null in the text column that general users pass on; rows with a null
id match nothing and are not matched; rows that share an id are one document and do not match each
other. An empty table gives no rows; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as t
from .packed import pack_keys, pack_numbers, unpack_keys, unpack_numbers

SPAN = 50
SEED = 16
WORD = 7
KEY_BITS = 48
BLOCK_BYTES = 1 << 20
PART_BYTES = 8 << 20
CHUNK = 1 << 15
INDEX_BYTES = 1 << 18
CROWD = 4096


def chosen_seeds(data: np.ndarray, span: int, seed: int) -> np.ndarray:
    """Where the seed that each window chooses begins, for all windows of the bytes."""
    n = len(data) - span + 1
    out = np.empty(n, np.int64)
    size = span - seed + 1
    for base in range(0, n, CHUNK):
        part = data[base : min(base + CHUNK, n) + span - 1]
        key = grams(part, None, seed) << np.uint64(32) | np.arange(len(part) - seed + 1, dtype=np.uint64)
        width = 1
        while 2 * width <= size:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if size > width:
            key = np.minimum(key[: width - size], key[size - width :])
        out[base : base + len(key)] = (key & np.uint64(0xFFFFFFFF)).astype(np.int64) + base
    return out


def grams(data: np.ndarray, at: np.ndarray | None, seed: int) -> np.ndarray:
    """Hashes of the `seed` bytes (a multiple of eight) from places on, or from every place."""
    eight = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data).data, strides=(1,))
    n = len(data) - seed + 1
    out = np.zeros(n if at is None else len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, seed, 8):
            out ^= eight[k : k + n] if at is None else eight[at + k]
            out *= t.BASE
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def segments(block: t.Block, span: int = SPAN, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """First window, window after the last, place of the seed, its key and the document of each segment of a block's texts."""
    data, none = block.data, np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, none.astype(np.uint64), none
    chosen = chosen_seeds(data, span, seed)
    moves = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
    cuts = np.sort(np.concatenate([moves, block.offsets[:-1], block.offsets[1:] - span + 1, [len(chosen)]]))
    cuts = cuts[(cuts >= 0) & (cuts <= len(chosen))]
    start, end = cuts[:-1], cuts[1:]
    start, end = start[end > start], end[end > start]
    doc = np.searchsorted(block.offsets[1:], start, side="right")
    whole = np.flatnonzero(start + span <= block.offsets[doc + 1])
    start, end, doc = start[whole], end[whole], doc[whole]
    at = chosen[start]
    return start, end, at, t.mix(grams(data, at, seed)) >> np.uint64(64 - KEY_BITS), doc


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of stretches, one after another."""
    after = np.cumsum(size)
    return data[np.arange(after[-1] if len(after) else 0) + np.repeat(start - after + size, size)]


def ranks(key: np.ndarray) -> np.ndarray:
    """Rank of each number, from 1; equal ones share the least."""
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), np.int32)
    out[order] = np.maximum.accumulate(np.where(np.append(True, k[1:] != k[:-1])[: len(k)], np.arange(1, len(key) + 1, dtype=np.int32), 0))
    return out


class RunIndex:
    """The transform of Burrows and Wheeler of texts, as runs with sampled ends, and what it takes to match against it.

    texts: their bytes one after another; size: their lengths; owner: a number for each. `first` of a
    match is the least owner of all texts that hold the bytes matched, if these are `span`.
    """

    def __init__(self, texts: np.ndarray, size: np.ndarray, owner: np.ndarray, span: int = SPAN):
        if span <= WORD:
            raise ValueError(f"spans of more than {WORD} bytes only")
        n = len(texts) + len(size)
        stop = np.cumsum(size + 1) - 1
        symbols = np.zeros(n, np.int16)
        inner = np.ones(n, bool)
        inner[stop] = False
        symbols[inner] = texts.astype(np.int16) + 1
        self.span, self.symbols, self.stop = span, symbols, stop
        end = np.repeat(stop, size + 1).astype(np.int32)
        at = np.arange(n, dtype=np.int32)

        def shifted(values, by):
            out = np.zeros(n, values.dtype)
            ok = np.flatnonzero(at + by <= end)
            out[ok] = values[ok + by]
            return out

        word = np.zeros(n, np.int64)
        for k in range(WORD):  # symbols of nine bits
            word = word << 9 | shifted(symbols, k)
        rank, width = ranks(word), WORD
        self.levels = [(width, rank)]
        fold = 3 if n < 1 << 20 else 2
        while width < max(span, int(size.max(initial=0)) + 1):
            if width < span <= fold * width:
                self.inside = [rank, *(shifted(rank, min(k * width, span - width)) for k in range(1, fold))]
            key, bits = rank.astype(np.int64), 63 // fold
            for k in range(1, fold):
                key = key << bits | shifted(rank, k * width)
            rank, width = ranks(key), fold * width
            if width <= span:
                self.levels.append((width, rank))
        order = np.argsort(rank.astype(np.int64) << 32 | at)
        before = np.where(order > 0, symbols[order - 1], 0)
        text_start = np.append(0, stop[:-1] + 1)
        starts = np.zeros(n, bool)
        starts[text_start] = True
        before[starts[order]] = 0
        # runs, each with its symbol, the row that its first one comes from, and the positions at its ends
        head = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.run_start, self.run_symbol = head, before[head].astype(np.int64)
        last = np.append(head[1:], n) - 1
        self.first_sample, self.last_sample = order[head], order[last]
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        length = np.append(head[1:], n) - head
        into = np.empty(len(head), np.int64)
        into[by_symbol] = np.cumsum(length[by_symbol]) - length[by_symbol]  # all smaller symbols, then earlier runs of this one
        self.run_into = into
        self.by_symbol, self.symbol_start = by_symbol, np.searchsorted(self.run_symbol[by_symbol], np.arange(258))
        self.run_of = np.repeat(np.arange(len(head), dtype=np.int32), length)  # rows to runs
        new = np.zeros(n, bool)
        new[0] = True
        for x in self.inside:
            new[1:] |= x[order][1:] != x[order][:-1]
        self.group_of = np.cumsum(new, dtype=np.int32) - 1  # rows to stretches that agree in the span
        self.group_first = np.minimum.reduceat(np.repeat(owner, size + 1)[order], np.flatnonzero(new))

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at two positions share, up to the span; ends of texts differ from all else."""
        out = np.zeros(len(a), np.int64)
        n = len(self.symbols)
        for width, rank in reversed(self.levels):
            for _ in range(3):
                x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
                out += np.where((rank[x] == rank[y]) & (out + width <= self.span), width, 0)
        for _ in range(6):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += (self.symbols[x] == self.symbols[y]) & (self.symbols[x] > 0) & (out < self.span)
        return np.minimum(out, self.span)

    def stream(self, texts: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of texts, from their last bytes on, all texts abreast.

        Yields, for each step, the texts that still go on, their places, the length of the longest match
        from there on that the indexed texts hold (up to the span), and the row that shows it.
        """
        live = np.arange(len(size))
        row, length = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        place = np.full(len(size), self.stop[0] if len(self.stop) else 0)  # of the suffix at row 0: an end of a text
        if len(self.stop):
            place[:] = self.first_sample[0]
        for step in range(1, int(size.max(initial=0)) + 1):
            live = live[size[live] >= step]
            want = texts[start[live] + size[live] - step].astype(np.int64) + 1
            run = self.run_of[row[live]].astype(np.int64)
            follow = self.run_symbol[run] == want
            new_row, new_place, new_length = row[live], place[live], length[live]
            jump = np.flatnonzero(~follow)
            if len(jump):
                c, r = want[jump], run[jump]
                lo, hi = self.symbol_start[c], self.symbol_start[c + 1]
                # runs of a symbol stand in order; the next one is found by its number
                key = self._run_key(c, r)
                k = np.searchsorted(self._keys(), key)
                best_length, best_row, best_place = np.full(len(jump), -1), np.zeros(len(jump), np.int64), np.zeros(len(jump), np.int64)
                for there, ok, rows_of, sample in ((k - 1, k > lo, self._last_row, self.last_sample), (k, k < hi, self._first_row, self.first_sample)):
                    x = np.flatnonzero(ok)
                    to = self.by_symbol[there[x]]
                    got = new_length[jump[x]]
                    y = np.flatnonzero(got)
                    got[y] = np.minimum(got[y], self.agree(new_place[jump[x[y]]], sample[to[y]]))
                    better = got > best_length[x]
                    y = x[better]
                    best_length[y], best_row[y], best_place[y] = got[better], rows_of(to[better]), sample[to[better]]
                held = best_length >= 0
                lost = jump[~held]
                new_row[jump[held]], new_place[jump[held]], new_length[jump[held]] = best_row[held], best_place[held], best_length[held]
                run = self.run_of[new_row].astype(np.int64)
                follow[jump[held]] = True
                new_row[lost], new_place[lost], new_length[lost] = 0, self.first_sample[0], 0
            go = np.flatnonzero(follow)
            new_row[go] = self.run_into[run[go]] + new_row[go] - self.run_start[run[go]]
            new_place[go] -= 1
            new_length[go] = np.minimum(new_length[go] + 1, self.span)
            row[live], place[live], length[live] = new_row, new_place, new_length
            yield live, start[live] + size[live] - step, new_length, new_row

    def _run_key(self, symbol: np.ndarray, run: np.ndarray) -> np.ndarray:
        return symbol * (len(self.run_start) + 1) + run

    def _keys(self) -> np.ndarray:
        if not hasattr(self, "_sorted"):
            self._sorted = self._run_key(self.run_symbol[self.by_symbol], self.by_symbol)
        return self._sorted

    def _first_row(self, run: np.ndarray) -> np.ndarray:
        return self.run_start[run]

    def _last_row(self, run: np.ndarray) -> np.ndarray:
        return np.append(self.run_start[1:], len(self.run_of))[run] - 1

    def first(self, row: np.ndarray) -> np.ndarray:
        """The least owner of the bytes matched at rows, where these are as many as the span."""
        return self.group_first[self.group_of[row]]


def text_hashes(texts: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of short texts that lie one after another."""
    with np.errstate(over="ignore"):
        value = t.BYTE_CODES[texts] * t.powers(int(size.max(initial=0)))[0][np.arange(len(texts)) - np.repeat(start, size)]
        return t.mix(np.add.reduceat(value, start) + size.astype(np.uint64) * t.BASE)


def lonely(texts: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, span: int, seed: int) -> np.ndarray:
    """Which distinct texts, with their seeds' places, share no window with another one.

    A window reaches half of its bytes beside the seed to one side of it, so two texts with a common
    window agree in the seed and that half, on the left or on the right.
    """
    half = (span - seed) // 2 // 8 * 8
    alone = np.ones(len(start), bool)
    for low in (at - half, at):
        there = np.flatnonzero((low >= start) & (low + seed + half <= start + size))
        order = np.argsort(h := grams(texts, low[there], seed + half))
        same = h[order][1:] == h[order][:-1]
        alone[there[order[1:][same]]] = False
        alone[there[order[:-1][same]]] = False
    return alone


def first_holders(texts: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, at: np.ndarray, span: int = SPAN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For each window of distinct texts, one text after another, the least owner of a text that holds it; and where each text's windows begin.

    Texts that may share windows are indexed in lots of about INDEX_BYTES, those of a seed together.
    """
    windows = np.maximum(size - span + 1, 0)
    base = np.cumsum(windows) - windows
    out = np.repeat(owner, windows)
    rest = np.flatnonzero(~lonely(texts, start, size, at, span, seed))
    if not len(rest):
        return out, base
    key = grams(texts, at[rest], seed)
    rest = rest[np.argsort(key, kind="stable")]
    key = np.sort(key)
    new = np.append(True, key[1:] != key[:-1])
    lot = np.maximum.accumulate(np.where(new, np.cumsum(size[rest]) // INDEX_BYTES, 0))
    edges = np.flatnonzero(np.append(True, lot[1:] != lot[:-1]))
    for a, b in zip(edges, [*edges[1:], len(rest)], strict=True):
        some = rest[a:b]
        held = gathered(texts, start[some], size[some])
        index = RunIndex(held, size[some], owner[some], span)
        begin = np.cumsum(size[some]) - size[some]
        to = base[some] - begin
        for live, place, length, row in index.stream(held, begin, size[some]):
            long = np.flatnonzero(length >= span)
            out[to[live[long]] + place[long]] = index.first(row[long])
    return out, base


def _columns(**cols) -> pa.Table:
    return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()})


def _rows_of(table: pa.Table, span: int) -> tuple[t.Block, np.ndarray, np.ndarray]:
    """The texts of a block that can match, in an order of their own, their ids, and which of the given rows each is."""
    text = t.large(table.column("text"))
    there = np.flatnonzero(table.column("id").is_valid().to_numpy() & (pa.compute.binary_length(text).to_numpy() >= span))
    ids = table.column("id").take(pa.array(there)).to_numpy()
    order = np.lexsort((table.column("mark").to_numpy()[there], ids))
    there = there[order]
    block = next(t.blocks(text.take(pa.array(there)), 1 << 62)) if len(there) else t.Block(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return block, ids[order], there


def long_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, seed: int = SEED, crowd: int = CROWD, keep: bool = True) -> DataFrame:
    """The rows with all their columns, and what the matches of `span` bytes with documents of smaller ids leave.

    Adds n_bytes, n_removed, n_spans (maximal stretches removed) and `kept`, the bytes that are left.
    """
    n = len(docs.columns)
    plain = docs.toDF(*(f"c{k}" for k in range(n)))
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = plain.withColumn("id", F.col(key).cast("long")).withColumn("text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("mark", F.xxhash64("text"))
    if not keep:
        rows = rows.drop(text)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffle = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks, parts = max(1, size // BLOCK_BYTES), max(shuffle, size // PART_BYTES + 1)
    # the one exchange of texts, which all three passes use
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.lit(n_blocks))).repartition(max(shuffle, n_blocks // 16), "block")
    part_of = lambda k: (k * np.uint64(parts) >> np.uint64(KEY_BITS)).astype(np.int64)

    def cut(values):
        """Where each part's values begin and end, of values in order of their part."""
        used, begin = np.unique(values, return_index=True)
        return used, begin.tolist(), [*begin[1:].tolist(), len(values)] if len(used) else []

    def own_seeds(found):
        """Distinct keys of a block's segments, which of them several documents hold, and each segment's key."""
        *_, keys, doc = found
        distinct, which = np.unique(keys, return_inverse=True)
        low, high = np.full(len(distinct), 1 << 62), np.full(len(distinct), -1)
        np.minimum.at(low, which, doc)
        np.maximum.at(high, which, doc)
        return distinct, low, high, which

    def send_seeds(table: pa.Table) -> pa.Table:
        block, ids, _ = _rows_of(table, span)
        distinct, low, high, _ = own_seeds(segments(block, span, seed))
        several = ids[np.minimum(low, len(ids) - 1)] != ids[np.maximum(high, 0)] if len(distinct) else np.zeros(0, bool)
        used, begin, end = cut(part_of(distinct))
        return _columns(
            part=pa.array(used, pa.int32()), block=pa.array([table.column("block")[0].as_py()] * len(used), pa.int64()), n=pa.array(np.subtract(end, begin), pa.int32()),
            keys=pa.array([pack_keys(distinct[a:b]) for a, b in zip(begin, end, strict=True)], pa.binary()), several=pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()),
        )

    def share(table: pa.Table) -> pa.Table:
        """For each block's keys whether others hold them too, and whether a crowd does."""
        size = table.column("n").to_numpy()
        keys = np.concatenate([unpack_keys(x.as_py()) for x in table.column("keys")])
        several = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=k) for x, k in zip(table.column("several"), size, strict=True)]).astype(bool)
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        shared, crowded = several | (times[which] > 1), times[which] > crowd
        end = np.cumsum(size)
        bits = [np.packbits(np.concatenate([shared[a:b], crowded[a:b]])).tobytes() for a, b in zip(end - size, end, strict=True)]
        return _columns(block=table.column("block").combine_chunks(), part=table.column("part").combine_chunks(), n=table.column("n").combine_chunks(), bits=pa.array(bits, pa.binary()))

    def send_segments(table: pa.Table, answers: pa.Table) -> pa.Table:
        block, ids, _ = _rows_of(table, span)
        start, end, place, keys, doc = segments(block, span, seed)
        _, which = np.unique(keys, return_inverse=True)
        flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=2 * k).reshape(2, k) for _, k, b in sorted(zip(answers.column("part").to_pylist(), answers.column("n").to_pylist(), answers.column("bits").to_pylist(), strict=True))]
        shared, crowded = np.concatenate(flags, 1).astype(bool) if flags else np.zeros((2, 0), bool)
        if shared.any():
            go = np.flatnonzero(shared[which] & ~crowded[which])
            alone = np.flatnonzero(shared[which] & crowded[which])
            windows = end[alone] - start[alone]
            single = np.arange(windows.sum()) + np.repeat(start[alone] - np.cumsum(windows) + windows, windows)
            at, to = np.concatenate([start[go], single]), np.concatenate([end[go], single + 1]) + span - 1
            owner, mid = (np.concatenate([x[go], np.repeat(x[alone], windows)]) for x in (doc, place))
            value = t.hashes(t.prefix_hash(block.data), at, to)
            part = part_of(np.concatenate([keys[go], value[len(go) :] >> np.uint64(64 - KEY_BITS)]))
        else:
            at, to, owner, mid, value, part = (np.zeros(0, np.int64) for _ in range(6))
        order = np.lexsort((at, value, part))
        at, to, owner, mid, value, part = (x[order] for x in (at, to, owner, mid, value, part))
        used, begin, stop = cut(part)
        cols: dict = {"part": used, "block": [table.column("block")[0].as_py()] * len(used) if len(used) else [], "n": [], "m": [], "sizes": [], "seeds": [], "texts": [], "which": [], "rows": [], "starts": [], "ids": []}
        for a, b in zip(begin, stop, strict=True):
            new = np.flatnonzero(np.append(True, value[a + 1 : b] != value[a : b - 1])) + a
            cols["n"].append(b - a)
            cols["m"].append(len(new))
            cols["sizes"].append(pack_numbers(to[new] - at[new]))
            cols["seeds"].append(pack_numbers(mid[new] - at[new]))
            cols["texts"].append(gathered(block.data, at[new], to[new] - at[new]).tobytes())
            cols["which"].append(pack_numbers(np.diff(np.append(new, b))))
            cols["rows"].append(pack_numbers(owner[a:b]))
            cols["starts"].append(pack_numbers(at[a:b] - block.offsets[owner[a:b]]))
            cols["ids"].append(pack_numbers(ids[owner[a:b]]))
        kinds = {"part": pa.int32(), "block": pa.int64(), "n": pa.int32(), "m": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in cols.items()})

    def match(table: pa.Table) -> pa.Table:
        """Matches of a part's segments: for each block the rows and stretches that go."""
        n, m = table.column("n").to_pylist(), table.column("m").to_pylist()
        read = lambda c, sizes: np.concatenate([unpack_numbers(x.as_py(), k) for x, k in zip(table.column(c), sizes, strict=True)])
        sizes, seeds, times = (read(c, m) for c in ("sizes", "seeds", "which"))
        rows_, starts, ids = (read(c, n) for c in ("rows", "starts", "ids"))
        texts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("texts")])
        begin = np.cumsum(sizes) - sizes
        _, at, same = np.unique(text_hashes(texts, begin, sizes), return_index=True, return_inverse=True)
        text_of = np.repeat(same, times)
        owner = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(owner, text_of, ids)
        holder, base = first_holders(texts, begin[at], sizes[at], owner, begin[at] + seeds[at], span, seed)
        windows = sizes[at] - span + 1
        several = np.minimum.reduceat(holder, base)[text_of] < ids  # the places with at least one match
        place = np.flatnonzero(several)
        count = windows[text_of[place]]
        at_window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        gone = holder[np.repeat(base[text_of[place]], count) + at_window] < np.repeat(ids[place], count)
        lead = gone & (~np.append(False, gone[:-1]) | (at_window == 0))
        tail = gone & (~np.append(gone[1:], False) | np.append(at_window[1:] == 0, True))
        who = np.repeat(place, count)[lead]
        first, last = starts[who] + at_window[lead], starts[who] + at_window[tail] + span
        source = np.repeat(np.arange(len(n)), n)[who]
        used, begin, stop = cut(source)
        blocks_ = table.column("block").to_numpy()
        return _columns(
            block=pa.array(blocks_[used] if len(used) else np.zeros(0, np.int64), pa.int64()), n=pa.array(np.subtract(stop, begin) if len(used) else [], pa.int32()),
            **{c: pa.array([pack_numbers(x[a:b]) for a, b in zip(begin, stop, strict=True)], pa.binary()) for c, x in (("rows", rows_[who]), ("starts", first), ("ends", last))},
        )

    answers = dealt.groupBy("block").applyInArrow(send_seeds, "part int, block long, n int, keys binary, several binary").groupBy("part").applyInArrow(share, "block long, part int, n int, bits binary")
    sent = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send_segments, "part int, block long, n int, m int, sizes binary, seeds binary, texts binary, which binary, rows binary, starts binary, ids binary")
    spans = sent.groupBy("part").applyInArrow(match, "block long, n int, rows binary, starts binary, ends binary")
    kept_columns = [c for c in rows.columns if c not in ("id", "text", "mark")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept_columns), "n_bytes long, n_removed long, n_spans long, kept binary"])

    def remove(table: pa.Table, given: pa.Table) -> pa.Table:
        all_size = pa.compute.binary_length(pa.compute.cast(table.column("text"), pa.binary())).to_numpy()
        block, _, where = _rows_of(table, span)
        removed, count = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
        left = table.column("text").cast(pa.binary()).to_pylist()
        if len(given) and len(block):
            read = lambda c: np.concatenate([unpack_numbers(x.as_py(), k) for x, k in zip(given.column(c), given.column("n").to_pylist(), strict=True)])
            owner, first, last = (read(c) for c in ("rows", "starts", "ends"))
            change = np.zeros(len(block.data) + 1, np.int64)
            np.add.at(change, block.offsets[owner] + first, 1)
            np.add.at(change, block.offsets[owner] + last, -1)
            gone = np.cumsum(change[:-1]) > 0
            s, _, d = t.spans_of(gone, block.offsets)
            removed[where] = np.bincount(np.repeat(np.arange(len(block)), np.diff(block.offsets))[gone], minlength=len(block))
            count[where] = np.bincount(d, minlength=len(block))
            for k in np.unique(d):
                a, b = block.offsets[k], block.offsets[k + 1]
                left[where[k]] = block.data[a:b][~gone[a:b]].tobytes()
        return pa.table([*(table.column(c) for c in kept_columns), pa.array(all_size, pa.int64()), pa.array(removed), pa.array(count), pa.array(left, pa.binary())], names=[*kept_columns, "n_bytes", "n_removed", "n_spans", "kept"])

    out = dealt.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(remove, schema)
    given = [c for c in kept_columns if c != "block"]
    names = [docs.columns[int(c[1:])] for c in given]
    return out.select(*given, "n_bytes", "n_removed", "n_spans", "kept").toDF(*names, "n_bytes", "n_removed", "n_spans", "kept")


def contract(docs: DataFrame) -> DataFrame:
    found = long_matches(docs.select("doc_id", "text"), keep=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
