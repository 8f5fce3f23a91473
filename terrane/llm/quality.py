"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairs of
features interact, in time linear in their number. Words hash to 2**HASH_BITS features (log counts,
scaled to length one in a text); each statistic is one of 12 levels, and so is each metadata column.

The model is fitted on a bounded sample, the SAMPLE labelled rows with the smallest hash of their id,
and has a fixed size. Scoring covers every row and the whole text. Null and empty texts have no
words and are scored by the rest; null metadata is a level of its own; rows with a null id are scored
and are in no fold; repeated rows get equal scores; an empty table gives no rows. Without labelled
rows, or with labels of one kind only, the score is their share (0.5 without any).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as t
from .spaces import extend

HASH_BITS = 16
FACTORS = 8
#: Most labelled rows that the model is fitted on.
SAMPLE = 8000
EPOCHS = 12
LEVELS = 12
_CLASSES = ("upper", "lower", "digit", "mark", "shout", "bar", "symbol", "quote", "line", "space", "wide", "other")

_class = np.full(256, 11, np.int64)
_class[65:91], _class[97:123], _class[48:58] = 0, 1, 2
_class[list(b".,;:?-")], _class[ord("!")], _class[ord("|")] = 3, 4, 5
_class[list(b"#*$%&<>@^~_=+\\/")], _class[list(b"\"'()[]{}`")], _class[10] = 6, 7, 8
_class[[32, 9, 11, 12, 13]], _class[128:] = 9, 10


def n_statistics() -> int:
    return len(_CLASSES) + 6


def size(n_metadata: int) -> int:
    """Number of features."""
    return (1 << HASH_BITS) + LEVELS * (n_statistics() + n_metadata)


def features(block: t.Block, metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, feature and value of all features that are not 0, by document."""
    n, data = len(block), block.data
    sizes = np.diff(block.offsets)
    owner = np.repeat(np.arange(n), sizes)
    share = np.bincount(owner * len(_CLASSES) + _class[data], minlength=n * len(_CLASSES)).reshape(n, -1) / np.maximum(sizes, 1)[:, None]
    s, e, doc = t.words(block)
    low = t.LOWER[data]
    h = t.hashes(t.prefix_hash(low), s, e)
    key, times = np.unique((doc << HASH_BITS) | (h >> np.uint64(64 - HASH_BITS)).astype(np.int64), return_counts=True)
    word_doc, word = key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)
    value = np.log1p(times)
    value /= np.sqrt(np.bincount(word_doc, value**2, n))[word_doc]
    per = np.bincount(doc, minlength=n)
    lines = share[:, _CLASSES.index("line")] * sizes + 1
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    top = np.zeros(n)
    np.maximum.at(top, word_doc, times)
    top[per < 10] = 0
    stats = np.column_stack([np.log2(share * 1024 + 1), np.log2(per + 1), np.bincount(doc, e - s, n) / np.maximum(per, 1), LEVELS * np.bincount(word_doc, minlength=n) / np.maximum(per, 1) - 0.5, np.log2(per / lines + 1), np.log2(1024 * np.bincount(doc, again, n) / np.maximum(per, 1) + 1), LEVELS * top / np.maximum(per, 1), *(np.where(np.isnan(m), LEVELS - 1, np.minimum(np.log2(np.maximum(m, 0) + 1) * 0.6, LEVELS - 2)) for m in metadata)])
    level = np.clip(stats.astype(np.int64), 0, LEVELS - 1)
    k = level.shape[1]
    stat = (1 << HASH_BITS) + np.arange(k) * LEVELS + level
    docs = np.concatenate([word_doc, np.repeat(np.arange(n), k)])
    order = np.argsort(docs, kind="stable")
    return docs[order], np.concatenate([word, stat.ravel()])[order], np.concatenate([value, np.full(n * k, k**-0.5)])[order]


class Machine:
    """A factorisation machine for two classes."""

    def __init__(self, n_features: int, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(n_features)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n_features, FACTORS))

    def raw(self, doc: np.ndarray, feature: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The score before the sigmoid, and the factor sums of each document."""
        sums, total = np.empty((n, FACTORS)), np.bincount(doc, self.w[feature] * x, n)
        for f in range(FACTORS):
            part = self.v[feature, f] * x
            sums[:, f] = np.bincount(doc, part, n)
            total -= 0.5 * np.bincount(doc, part * part, n)
        return self.bias + total + 0.5 * (sums**2).sum(1), sums

    def score(self, doc, feature, x, n) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(doc, feature, x, n)[0], -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, batch: int = 200, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> None:
        """Adagrad on the logistic loss."""
        rng, n_features = np.random.default_rng(seed), len(self.w)
        self.bias = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
        seen_w, seen_v = np.full(n_features, 1e-3), np.full(self.v.shape, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                pick = order[at : at + batch]
                doc = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
                feature, x = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                raw, sums = self.raw(doc, feature, x, len(pick))
                error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[pick]) / len(pick)
                self.bias -= rate * float(error.sum())
                ex = error[doc] * x
                used, inverse = np.unique(feature, return_inverse=True)
                g = np.bincount(inverse, ex, len(used)) + decay * self.w[used]
                seen_w[used] += g * g
                self.w[used] -= rate * g / np.sqrt(seen_w[used])
                old = self.v[feature]
                for f in range(FACTORS):
                    g = np.bincount(inverse, ex * (sums[doc, f] - old[:, f] * x), len(used)) + decay * self.v[used, f]
                    seen_v[used, f] += g * g
                    self.v[used, f] -= 0.3 * rate * g / np.sqrt(seen_v[used, f])


def held_out(id_col):
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _metadata(rows, k: int) -> list[np.ndarray]:
    last = rows.num_columns - 1
    return [rows.column(last - k + i).cast("float64").to_numpy(zero_copy_only=False) for i in range(k)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE) -> Machine:
    """A model of the labelled rows that are not held out; at most `sample` of them."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def encode(block, rows):
        doc, feature, x = features(block, _metadata(rows, len(metadata)))
        cut = np.searchsorted(doc, np.arange(len(block) + 1))
        return [[feature[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], [x[a:b].astype("<f4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]]

    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *(docs[m].cast("double").alias(f"m{i}") for i, m in enumerate(metadata)))
    chosen = chosen.join(F.broadcast(known), "id")  # at most `sample` rows of an id and a number
    got = extend(chosen, "text", "feature binary, x binary", encode, last=[f"m{i}" for i in range(len(metadata))]).select("id", "y", "feature", "x").orderBy(F.xxhash64("id"), "id", F.xxhash64("feature", "x")).limit(sample).collect()
    y = np.array([r["y"] >= 0.5 for r in got], float)
    model = Machine(size(len(metadata)))
    if len(set(y)) == 2:
        model.fit([(np.frombuffer(r["feature"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float)) for r in got], y)
    else:
        model.v[:] = 0
        model.bias = 40.0 * (2 * y.mean() - 1) if len(y) else 0.0
    return model


def score(docs: DataFrame, model: Machine, text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), name: str = "score") -> DataFrame:
    """The documents with one more column, the score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w.astype("f4"), model.v.astype("f4")))  # of fixed size

    def run(block, rows):
        own = Machine.__new__(Machine)
        own.bias, own.w, own.v = shared.value
        doc, feature, x = features(block, _metadata(rows, len(metadata)))
        return [own.score(doc, feature, x, len(block))]

    return extend(docs, text_col, f"{name} double", run, last=list(metadata))


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text", "n_chars"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
