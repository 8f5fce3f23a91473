"""Long matches, periodic runs and the prefix trie against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from terrane.llm import periodic, prefixes, runindex, textops

LONG = " ".join(f"w{i % 700}" for i in range(20_000))
SCHEMA = "doc_id long, text string, id int, block string, n_runs int, start string"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "word"), (None, LONG), (None, None), (5, LONG), (5, LONG), (6, LONG + " end"), (7, "a " * 40), (8, "é漢 " * 60), (9, "a" * 300), (10, "a" * 200), (11, "ab" * 100), (12, "\x00" * 120)]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, x, 1, "b", 2, "s") for i, x in ODD], SCHEMA)


# periodic runs


def brute_runs(w, least=24):
    found, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_periodic(i, text):
    w = words(text)
    n = len(w)
    if i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (i, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def made_words(rng):
    w = []
    for _ in range(rng.randrange(5)):
        letters = rng.choice([1, 2, 3, 8])
        unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 60))]
        part = (unit * 9)[: rng.randrange(len(unit), 8 * len(unit))]
        if rng.random() < 0.4:
            part[rng.randrange(len(part))] = 9
        w += part + [rng.randrange(letters) for _ in range(rng.randrange(30))]
    return w


def test_runs_equal_brute_force_over_all_scales():
    rng = random.Random(4)
    for _ in range(200):
        docs = [made_words(rng) for _ in range(3)]
        h = textops.mix(np.array([x + 1 for w in docs for x in w], np.uint64))
        doc = np.repeat(np.arange(3), [len(w) for w in docs])
        start, end, period = periodic.find_runs(h, doc, 3)
        first = np.cumsum([0, *map(len, docs)])
        for d, w in enumerate(docs):
            own = doc[start] == d if len(start) else np.zeros(0, bool)
            assert sorted(zip((start[own] - first[d]).tolist(), (end - start)[own].tolist(), period[own].tolist(), strict=True)) == brute_runs(w)


def test_periods_at_the_edges_of_scales():
    for low, high in periodic.scales(400):
        for q in {low, high}:
            w = [*range(1000, 1007), *(list(range(q)) * 3), *range(2000, 2005)]
            h = textops.mix(np.array(w, np.uint64) + np.uint64(1))
            start, end, period = periodic.find_runs(h, np.zeros(len(w), np.int64), 1)
            assert (start.tolist(), end.tolist(), period.tolist()) == ([7], [7 + 3 * q], [q])


def test_periodic_query_equals_brute_force(spark, odd, sf_dir):
    rng = random.Random(8)
    made = [(1000 + k, " ".join(f"x{y}" for y in made_words(rng))) for k in range(150)]
    rows = [(i, x) for i, x in ODD if x != LONG and x != LONG + " end"] + made
    got = periodic.contract(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_periodic(*r) for r in rows), key=str)
    assert sum(r[1] for r in got) > 50
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = [(r.doc_id, r.text) for r in given.collect() if len(r.text or "") < 3000]
    found = {r.doc_id: tuple(r) for r in periodic.contract(given).collect()}
    assert all(found[i] == brute_periodic(i, x) for i, x in short)


def test_periodic_runs_on_odd_rows(spark, odd):
    found = periodic.periodic_runs(odd)
    rows = {(r.doc_id, r.n_runs): r for r in found.collect()}
    assert found.count() == len(ODD)
    assert (None, 1) in rows and rows[5, 1].period == 700 and rows[5, 1].length == 20_000 and rows[5, 1].collapsed == " ".join(f"w{i}" for i in range(700))
    assert rows[7, 1].collapsed == "a" and rows[1, 0].collapsed == "" and rows[2, 0].runs == []
    assert periodic.contract(odd.limit(0)).count() == 0
    text = " ".join(f"u{i % 9000}" for i in range(2_000_000))  # 13 MB
    huge = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (huge.start, huge.length, huge.period) == (0, 2_000_000, 9000)


# long matches


def brute_matches(rows, span=50):
    first = {}
    data = [(i, (x or "").encode()) for i, x in rows]
    for i, b in data:
        if i is not None:
            for k in range(len(b) - span + 1):
                first[b[k : k + span]] = min(i, first.get(b[k : k + span], i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - span + 1):
                if first[b[k : k + span]] < i:
                    gone[k : k + span] = b"\1" * span
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", gone)), sha(bytes(c for c, z in zip(b, gone, strict=True) if not z))))
    return sorted(out, key=str)


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        span = rng.choice([8, 14, 17, 50])
        letters = rng.choice([1, 2, 3])
        make = lambda letters=letters: bytes(97 + rng.randrange(letters) for _ in range(rng.randrange(1, 90)))
        texts = [make() for _ in range(5)]
        texts += [x[: rng.randrange(1, len(x) + 1)] + make() for x in texts]
        owner = np.array([rng.randrange(100) for _ in texts])
        index = runindex.RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))), owner, span)
        asked = [make() for _ in range(4)] + [x[len(x) // 3 :] for x in texts] + [texts[0] + b"~" + texts[1]]
        size = np.array(list(map(len, asked)))
        start = np.cumsum(size) - size
        for live, place, length, row in index.stream(np.frombuffer(b"".join(asked), np.uint8), start, size):
            for k, at, n, first in zip(live, place - start[live], length, index.first(row), strict=True):
                p = asked[k][at : at + span]
                assert n == next(m for m in range(len(p), -1, -1) if any(p[:m] in x for x in texts))
                assert n < span or first == min(o for o, x in zip(owner, texts, strict=True) if p in x)


def test_repeats_make_few_runs():
    rng = random.Random(3)
    text = bytes(rng.randrange(97, 123) for _ in range(80))
    texts = [text[:k] + bytes([65 + k % 26]) + text[k:] for k in range(60)]
    index = runindex.RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))), np.arange(60))
    assert len(index.run_start) < len(index.run_of) / 8


@pytest.mark.parametrize("crowd", [4096, 1])
def test_long_matches_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(runindex, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(runindex, "PART_BYTES", 9000)
    monkeypatch.setattr(runindex, "INDEX_BYTES", 2000)
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice(["alpha", "beta", "dé", "zeta", "x", "漢字"]) + str(rng.randrange(30)) for _ in range(n))
    passages = [make(20) for _ in range(10)]
    rows = []
    for i in range(250):
        x = make(rng.randrange(40))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            x += p[a : rng.randrange(a, len(p)) + 1] + make(rng.randrange(3))
        rows.append((rng.randrange(300) if rng.random() < 0.3 else i, x))
    rows += [(1000 + k, rows[3][1]) for k in range(40)] + [(2000 + k, passages[0] + make(2)) for k in range(60)] + [(i, x) for i, x in ODD if not x or len(x) < 1000]
    df = spark.createDataFrame([(i, x, 1, "b", 2, "s") for i, x in rows], SCHEMA)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in runindex.long_matches(df, crowd=crowd).collect()]
    assert sorted(got, key=str) == brute_matches(rows)
    assert sorted(map(tuple, runindex.contract(df).collect()), key=str) == brute_matches(rows)


def test_long_matches_on_the_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, runindex.contract(df).collect()), key=str) == brute_matches([(r.doc_id, r.text) for r in df.collect()])


def test_long_matches_on_odd_rows(spark, odd):
    out = runindex.long_matches(odd)
    assert out.columns == [*odd.columns, "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted(map(tuple, runindex.contract(odd).collect()), key=str) == brute_matches(ODD)
    assert runindex.contract(odd.limit(0)).count() == 0
    assert runindex.contract(odd.where("doc_id is null")).count() == 2


# prefix trie


def as_lists(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in conv.items()}


def rebuild(conv):
    out = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = conv.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    return out


def brute_trie(conv):
    members, children, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, v in conv.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    ends = lambda k, m: sha(",".join(map(str, sorted(c for c in m if len(conv[c]) == len(k)))))
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], ends(k, m)) for k, m in members.items()), key=str)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    rows = []
    for c in [*range(50), *range(100, 140), 307, 512, 1000, 1001, -5, -150]:
        times = rng.sample(range(20), rng.randrange(1, 10))
        rows += [(c, None if k == 0 and rng.random() < 0.2 else t, rng.choice(["user", "bot", None]), rng.choice(["a", "bb", None, "é漢", "long text " * 3])) for k, t in enumerate(times)]
    rows += [(c, t, "user", f"same {t}") for c in range(2000, 2040) for t in range(7)]
    rows += [(2100, t, "user", f"same {t % 7}") for t in range(400)]
    return [*rows, (None, 1, "a", "b"), (3000, 1, "user", "x" * 50)]


@pytest.mark.parametrize("bits", [27, 4])
def test_trie_equals_brute_force(spark, talks, bits):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in talks], "conv_id long, turn long, role string, text string, d int, a int, single int")
    turns = prefixes.digested(df)
    got = prefixes.prefix_trie(*prefixes.rebuilt(turns), most_bits=bits)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rebuild(as_lists(talks)))


def test_trie_without_rebuilding_and_given_table(spark, talks, sf_dir):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefixes.trie(df).collect()), key=str) == brute_trie(as_lists(talks))
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert sorted(map(tuple, prefixes.contract(given).collect()), key=str) == brute_trie(rebuild(as_lists([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])))
    assert prefixes.contract(df.limit(0)).count() == 0
    assert prefixes.contract(df.where("conv_id is null")).count() == 0


def test_repeated_turns_are_turns(spark):
    rows = [(1, 0, "u", "x"), (1, 0, "u", "x"), (2, 0, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefixes.trie(df).collect()), key=str) == brute_trie(as_lists(rows))


def test_sketch_proves_only_single_prefixes(spark):
    rng = random.Random(1)
    keys = [rng.randrange(400) for _ in range(600)]
    df = spark.createDataFrame([(k, k * 7) for k in keys], "a long, b long").repartition(5)
    for most in (5, 20):
        judged = {(r.a, r.single) for r in prefixes.screened(df, most).collect()}
        assert all(keys.count(a) == 1 for a, single in judged if single)
    assert sum(single for _, single in judged) > 0.9 * sum(keys.count(k) == 1 for k in set(keys))


def test_ids_of_a_node_in_many_tasks(spark):
    ids = [*range(-3, 500), *range(90_000, 90_900)]
    rows = [(1, 2, 3, i) for i in ids] + [(1, 2, k, 7) for k in range(4, 30)] + [(0, 9, 9, 5), (0, 9, 9, 11)]
    df = spark.createDataFrame(rows, "d long, a long, b long, c long").repartition(7)
    got = {(r.d, r.a, r.b): r.ends_sha256 for r in prefixes.id_digests(df).collect()}
    assert got[1, 2, 3] == sha(",".join(map(str, ids))) and got[0, 9, 9] == sha("5,11") and all(got[1, 2, k] == sha("7") for k in range(4, 30)) and len(got) == 28
