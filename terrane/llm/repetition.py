"""Quality rules: simple text statistics, and repetition within a text from its suffix array.

The suffix array is over words: prefix doubling sorts all suffixes of all documents of a block at
once, and only those whose rank is still shared are sorted again. Prefix sums of word hashes give the
longest common prefix of neighbours by binary descent, so the ranks and those sums are all that is held. Where it reaches `min_repeat` words the
suffixes begin a maximal repeated substring; the union of their spans is the repeated part.

Null and empty texts have no words: all counts are 0, base_failed is true and kept false. A null id
stays null; repeated rows are scored one by one; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import textops as t
from .spaces import map_blocks

MIN_REPEAT = 12
MAX_COVERED = 0.30
MAX_LONGEST = 200
MIN_WORDS = 50

_symbols = np.zeros(256, np.int64)
_symbols[list(b"#*$%&|<>")] = 1


def suffix_ranks(h: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of all suffixes, and after how many doublings of the words looked at none was shared. ends: each word's document's end."""
    n = len(h)
    order = np.lexsort((h, doc))
    new = np.ones(n, bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.arange(n)
    r = np.empty(n, np.int64)
    r[order] = np.maximum.accumulate(np.where(new, at, 0))
    doublings, step = 0, 1
    active = np.flatnonzero(np.bincount(r, minlength=n)[r] > 1)
    while len(active):
        follow = active + step
        second = np.where(follow < ends[active], r[np.minimum(follow, n - 1)] + 1, 0)
        key = r[active] * (n + 2) + second
        o = np.argsort(key)
        a, k = active[o], key[o]
        g, at = r[a], np.arange(len(a))
        same_g, same_k = np.zeros(len(a), bool), np.zeros(len(a), bool)
        same_g[1:], same_k[1:] = g[1:] == g[:-1], k[1:] == k[:-1]
        first_k = np.maximum.accumulate(np.where(same_k, 0, at))
        r[a] = g + first_k - np.maximum.accumulate(np.where(same_g, 0, at))
        doublings += 1
        active = a[np.bincount(first_k, minlength=len(a))[first_k] > 1]
        step *= 2
    return r, doublings


def repeats(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each word the longest run of words from it on that occurs again in its document."""
    n = len(h)
    if n < 2:
        return np.zeros(n, np.int64)
    ends = np.cumsum(np.bincount(doc, minlength=n_docs))[doc]
    rank, doublings = suffix_ranks(h, doc, ends)
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    up, down = t.powers(n)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * up[:n], dtype=np.uint64, out=sums[1:])
    i, j = sa[:-1], sa[1:]
    keep = doc[i] == doc[j]
    i, j = i[keep], j[keep]
    common = np.zeros(len(i), np.int64)
    for k in range(doublings, -1, -1):
        a, b, step = i + common, j + common, 1 << k
        ok = np.flatnonzero((a + step <= ends[i]) & (b + step <= ends[j]))
        a, b = a[ok], b[ok]
        with np.errstate(over="ignore"):  # equal words give equal sums once both are shifted to the same place
            same = (sums[a + step] - sums[a]) * down[a] == (sums[b + step] - sums[b]) * down[b]
        common[ok[same]] += step
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, i, common)
    np.maximum.at(longest, j, common)
    return longest


def measures(block: t.Block, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All statistics of each document of a block."""
    n, data = len(block), block.data
    s, e, doc = t.words(block)
    prefix, points = t.prefix_hash(data), t.code_points(data)
    h, chars = t.hashes(prefix, s, e), points[e] - points[s]
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": t.counts(doc, n, chars)}
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_symbols[data], out=sums[1:])
    out["n_symbols"] = sums[block.offsets[1:]] - sums[block.offsets[:-1]]

    ls, le, ld = t.spans_of(data != 10, block.offsets)
    np.cumsum(~t.SPACE[data], out=sums[1:])
    worded = sums[le] > sums[ls]
    ls, le, ld = ls[worded], le[worded], ld[worded]
    out["n_dup_lines"] = np.bincount(ld, minlength=n) - np.bincount(t.distinct(t.hashes(prefix, ls, le), ld)[1], minlength=n)

    repeated = np.zeros(len(h) + 3, bool)
    if len(h) >= 3:
        full = np.flatnonzero(doc[2:] == doc[:-2])
        g = t.combine(h[full], h[full + 1], h[full + 2])
        order = np.lexsort((g, doc[full]))
        same = (g[order][1:] == g[order][:-1]) & (doc[full][order][1:] == doc[full][order][:-1])
        twice = np.zeros(len(full), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            repeated[full[twice] + k] = True
    out["n_repeat_words"] = np.bincount(doc[repeated[: len(h)]], minlength=n)

    longest = repeats(h, doc, n)
    begins = np.flatnonzero(longest >= min_repeat)
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + longest[begins], -1)
    covered = np.cumsum(change[:-1]) > 0
    out["covered_chars"] = t.counts(doc, n, chars * covered)
    out["longest_repeat"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_repeat"], doc, longest)
    return out


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: its statistics, covered_fraction, longest_repeat and the verdict `kept`."""

    def score(block, rows):
        m = measures(block, min_repeat)
        fraction = m["covered_chars"] / np.maximum(m["word_chars"], 1)
        failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        kept = ~failed & (fraction <= max_covered) & (m["longest_repeat"] <= max_longest)
        return [rows.column(0), *(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, kept, fraction, m["longest_repeat"]]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_blocks(docs, text_col, [id_col], f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_fraction double, longest_repeat long", score)
