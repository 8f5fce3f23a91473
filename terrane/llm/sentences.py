"""Substring dedup: runs of consecutive sentences that occur before are removed from later texts.

A sentence ends with a full stop, also a non-ASCII one, that closing quotes or brackets may follow, or
with its line. A sentence of more than LONG words is cut further, after each word whose hash is
divisible by CUT: such places depend on nothing but the word, so a passage is cut alike wherever it
stands, even if its ends lie in mid-sentence. What follows calls these pieces sentences too.

From each sentence on, the shortest run of at least `run` sentences and `min_words` words is hashed,
over lower-cased words, so spacing does not matter; the last run of a text is hashed up to its end as
well. A run seen at more than one place is a repeated
span; its first place is the one with the smallest (id, position). Every sentence that lies in a
repeated span at any later place is removed, together with the white space after it.

Each block of texts sends its runs once, packed and cut by hash into parts, and of runs that it holds
more than once only the first place; so a run that a third of all texts hold reaches its part once a
block. The parts send back the later places.

Texts without words, and null, stay as they are. Rows with a null id are left alone and do not count.
Rows that share an id are versions of one document: a run that stands at the same place in several of
them counts once, and each version is cut by its own runs. An empty table gives no rows; other
columns, whatever their names, are kept. `n_removed` and `n_removed_words` are added last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as t
from .packed import pack_keys, pack_numbers, unpack_keys, unpack_numbers
from .spaces import extend, written

RUN = 2
MIN_WORDS = 30
LONG = 12
CUT = 4
PART_BYTES = 24 << 20
HELD_RUNS = 1 << 19

_codes = lambda chars: np.array([int.from_bytes(c.encode()) for c in chars])
_ends = _codes(".!?…。！？．｡।؟۔։‼⁇⁈⁉")
_closers = _codes("\"')]}»«”“’‘›‹」』）】》〉］｝")


def last_characters(data: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The character before each end, as the number that its UTF-8 bytes make (of the last three bytes at most)."""
    one, two, three = (data[np.maximum(e - k, 0)].astype(np.int64) for k in (1, 2, 3))
    return np.where(one < 0x80, one, np.where(two >= 0xC0, two << 8 | one, three << 16 | two << 8 | one))


def stops(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which words end with a full stop, closing quotes and brackets after it left aside."""
    e = e.copy()
    left = np.arange(len(e))
    out = np.zeros(len(e), bool)
    while len(left):
        last = last_characters(data, e[left])
        out[left] = np.isin(last, _ends)
        closed = np.isin(last, _closers)
        left, last = left[closed], last[closed]
        e[left] -= 1 + (last > 0xFF) + (last > 0xFFFF)
        left = left[e[left] > s[left]]
    return out


def sentences(block: t.Block) -> tuple[np.ndarray, ...]:
    """Words (start, end, hash) and sentences: first word, word after the last, document, byte start."""
    low = block.lower()
    data, n = low.data, len(low.data)
    s, e, doc = t.words(low)
    h = t.hashes(t.prefix_hash(data), s, e)
    if not len(s):
        none = np.zeros(0, np.int64)
        return s, e, h, none, none, none, none
    lines = np.zeros(n + 1, np.int64)
    np.cumsum(data == 10, out=lines[1:])
    ends = np.ones(len(s), bool)
    ends[:-1] = stops(data, s[:-1], e[:-1]) | (lines[s[1:]] > lines[e[:-1]]) | (doc[1:] != doc[:-1])
    size = np.diff(np.flatnonzero(ends) + 1, prepend=0)
    ends |= (np.repeat(size, size) > LONG) & (h % np.uint64(CUT) == 0)
    after = np.flatnonzero(ends) + 1
    first = np.concatenate([[0], after[:-1]])
    return s, e, h, first, after, doc[first], s[first]


def runs(h: np.ndarray, first: np.ndarray, after: np.ndarray, doc: np.ndarray, run: int = RUN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """First sentence, last sentence and hash of every run of a block's sentences."""
    at = np.arange(len(first))
    last = np.maximum(at + run - 1, np.searchsorted(after, first + min_words))
    ok = last < len(first)
    ok[ok] = doc[last[ok]] == doc[ok]
    i, j = at[ok], last[ok]
    if len(i):
        tail = np.flatnonzero(np.append(doc[i[1:]] != doc[i[:-1]], True))  # the last run of each text, up to its end
        end = np.searchsorted(doc, doc[i[tail]], side="right") - 1
        tail, end = tail[j[tail] < end], end[j[tail] < end]
        i, j = np.insert(i, tail + 1, i[tail]), np.insert(j, tail + 1, end)
    up, down = t.powers(len(h) + 1)
    p = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * up[: len(h)], dtype=np.uint64, out=p[1:])
        value = t.mix((p[after[j]] - p[first[i]]) * down[first[i]] + (after[j] - first[i]).astype(np.uint64) * t.BASE)
    return i, j, value


def first_places(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the runs are first places of their key, and which are later ones, in the order of the key. Equal places are one."""
    order = np.lexsort((place, doc, key))
    k, d, p = key[order], doc[order], place[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    later = (d != d[lead]) | (p != p[lead])
    return order[new], order[later]


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, spans): for each document its runs, array<struct<first,hash>>, that repeat an earlier one; first is a sentence's number."""
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null and text is not null")
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    later = "id long, spans array<struct<first:long,hash:long>>"

    def rows(part, n, key, doc, place):
        cols = [pa.array(part, pa.int32()), pa.array(n, pa.int32()), *(pa.array(c, pa.binary()) for c in (key, doc, place))]
        return pa.RecordBatch.from_arrays(cols, names=["part", "n", "hashes", "ids", "firsts"])

    def send(held):
        key, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        lead, again = first_places(key, doc, place)
        part = ((key[lead] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        used, start = np.unique(part, return_index=True)
        cuts = [lead[a:b] for a, b in zip(start, [*start[1:], len(lead)], strict=True)]
        if len(again):  # these are known to be later ones
            used, cuts = np.append(used, -1), [*cuts, again]
        return rows(used, [len(c) for c in cuts], [pack_keys(key[c]) for c in cuts], [pack_numbers(doc[c]) for c in cuts], [pack_numbers(place[c]) for c in cuts])

    def emit(batches):
        held, n = [], 0
        for batch in batches:
            for block in t.blocks(batch.column(1)):
                _, _, h, first, after, doc, _ = sentences(block)
                i, _, value = runs(h, first, after, doc, run, min_words)
                if len(i):
                    ids = batch.column(0).slice(block.first, len(block)).to_numpy()
                    held.append((value, ids[doc[i]], i - np.searchsorted(doc, doc[i])))
                    n += len(i)
                if n >= HELD_RUNS:
                    yield send(held)
                    held, n = [], 0
        if held:
            yield send(held)
        pa.default_memory_pool().release_unused()

    def unpacked(table):
        n = table.column("n").to_pylist()
        key = np.concatenate([unpack_keys(x.as_py()) for x in table.column("hashes")])
        return key, *(np.concatenate([unpack_numbers(x.as_py(), k) for x, k in zip(table.column(c), n, strict=True)]) for c in ("ids", "firsts"))

    def listed(key, doc, place):
        """One row for each document."""
        order = np.argsort(doc, kind="stable")
        ids, start = np.unique(doc[order], return_index=True)
        values = pa.StructArray.from_arrays([pa.array(place[order]), pa.array(key[order].view(np.int64))], names=["first", "hash"])
        return [pa.array(ids), pa.ListArray.from_arrays(pa.array(np.append(start, len(order)).astype(np.int32)), values)]

    def settle(table: pa.Table) -> pa.Table:
        key, doc, place = unpacked(table)
        _, again = first_places(key, doc, place)
        values = pa.StructArray.from_arrays([pa.array(place[again]), pa.array(key[again].view(np.int64))], names=["first", "hash"])
        return pa.table([pa.array(doc[again]), pa.ListArray.from_arrays(pa.array(np.arange(len(again) + 1, dtype=np.int32)), values)], names=["id", "spans"])

    def known(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(listed(*unpacked(batch)), names=["id", "spans"])

    sent = written(plain.mapInArrow(emit, "part int, n int, hashes binary, ids binary, firsts binary"), "runs")
    settled = sent.where("part >= 0").groupBy("part").applyInArrow(settle, later)
    again = settled.unionByName(sent.where("part < 0").mapInArrow(known, later))
    return again.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def cut_sentences(block: t.Block, spans: list[tuple[np.ndarray, np.ndarray] | None], run: int = RUN, min_words: int = MIN_WORDS) -> tuple[list[str], list[int], list[int]]:
    """Texts without the runs in the spans (numbers of first sentences, hashes), sentences and words removed."""
    texts = [block.text(k) for k in range(len(block))]
    removed, lost = [0] * len(texts), [0] * len(texts)
    hit = [k for k, x in enumerate(spans) if x is not None]
    if not hit:
        return texts, removed, lost
    sizes = np.diff(block.offsets)[hit]
    part = t.Block(np.concatenate([block.data[block.offsets[k] : block.offsets[k + 1]] for k in hit]), np.concatenate([[0], np.cumsum(sizes)]))
    _, _, h, first, after, doc, start = sentences(part)
    i, j, value = runs(h, first, after, doc, run, min_words)
    base = np.searchsorted(doc, np.arange(len(part) + 1))
    at = np.concatenate([base[k] + spans[d][0] for k, d in enumerate(hit)])
    wanted = np.concatenate([spans[d][1] for d in hit])
    owner = np.repeat(np.arange(len(hit)), [len(spans[d][0]) for d in hit])
    # a span of another version of the document has no run at its place, or another one
    own, where = np.zeros(len(at), bool), np.searchsorted(i, at)
    for k in (0, 1):  # a sentence begins two runs at most
        there = np.minimum(np.searchsorted(i, at) + k, max(len(i) - 1, 0))
        same = (i[there] == at) & (value.view(np.int64)[there] == wanted) & (at < base[owner + 1]) if len(i) else own
        own, where = own | same, np.where(same, there, where)
    change = np.zeros(len(first) + 1, np.int64)
    np.add.at(change, i[where[own]], 1)
    np.add.at(change, j[where[own]] + 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    tiles = np.append(start, 0)
    for k, d in enumerate(hit):
        a, b = base[k], base[k + 1]
        if gone[a:b].any():
            tiles[b], saved = part.offsets[k + 1], tiles[b]
            keep = [part.data[part.offsets[k] : tiles[a]], *(part.data[tiles[x] : tiles[x + 1]] for x in a + np.flatnonzero(~gone[a:b]))]
            tiles[b] = saved
            texts[d] = b"".join(x.tobytes() for x in keep).decode()
            removed[d] = int(gone[a:b].sum())
            lost[d] = int((after - first)[a:b][gone[a:b]].sum())
    return texts, removed, lost


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with all their columns; the text lacks repeated spans. Adds n_removed (sentences) and n_removed_words."""
    spans = repeated_runs(docs, id_col, text_col, run, min_words)
    n = len(docs.columns)
    plain = docs.toDF(*(f"c{k}" for k in range(n)))
    key, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    joined = plain.join(spans, plain[key].cast("long") == spans["id"], "left").drop("id")

    def cut(block, rows):
        column = rows.column(n)
        held = column.flatten()  # of the rows of this block alone
        ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        first, hash_ = (held.field(k).to_numpy() for k in (0, 1))
        return list(cut_sentences(block, [(first[a:b], hash_[a:b]) if b > a else None for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], run, min_words))

    out = extend(joined, text, "new_text string, n_removed long, n_removed_words long", cut)
    new = F.when(F.col(text).isNotNull(), F.col("new_text"))
    return out.select(*(new.alias(text) if f"c{k}" == text else F.col(f"c{k}") for k in range(n)), "n_removed", "n_removed_words").toDF(*docs.columns, "n_removed", "n_removed_words")


def contract(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"))
