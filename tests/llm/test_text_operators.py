"""Operators on texts against plain Python, on odd rows and on a small table."""

import collections
import hashlib
import random
import unicodedata
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terrane.llm import bytebpe, lmscore, minhash, packing, pieces, pii, quality, repetition, sentences, textops, tokenfile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, spans string, id long"
LONG = " ".join(f"w{i % 700}" for i in range(20_000)) + "."
ODD = [
    (1, "one two three four five six seven eight nine ten. " * 8),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, LONG),
    (6, LONG),
    (None, "no id here, no id at all."),
    (None, None),
    (7, "a"),
    (8, "é ñ <|endoftext|> ▁x  \r\n\x1c y\x00z 😀"),
    (9, "A"),
    (10, "mail bob [at] mail dot example dot com or +1 (555) 123-4567, 10.0.0.255, 10.0.0.256"),
]
TEXTS = ["", " ", "  lead", "trail  ", "a\n\n b\r\n", "don't we'll 'tis", "<|endoftext|> x", "\x1c\x85 b", "ünï 漢字 123abc", "😀😀 <s> </s>", "▁a ▁▁b", "x" * 300, "\t\t", "a " * 50]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, x, "en", "s", None if x is None else len(x), True, 0.5, "no", 3) for i, x in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 0), (7, None, None), (None, 1, 0), (9, 1, 0), (10, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


# tokens


def test_byte_bpe_equals_the_library():
    bpe = bytebpe.byte_bpe()
    rng = random.Random(3)
    made = ["".join(rng.choice("ab 'é\n\t😀1.") for _ in range(rng.randrange(40))) for _ in range(300)]
    for x, got in zip(TEXTS + made, bpe.encode(TEXTS + made), strict=True):
        assert np.frombuffer(got, np.uint32).tolist() == bpe.model.encode(x, add_special_tokens=False).ids


def test_pieces_equal_the_library_and_spans_cover_the_text():
    m = pieces.pieces()
    rng = random.Random(4)
    made = ["".join(rng.choice("ab 'é\n\t😀1.▁") for _ in range(rng.randrange(40))) for _ in range(300)]
    for x, (ids, starts, ends) in zip(TEXTS + made, m.encode(TEXTS + made), strict=True):
        assert ids.tolist() == m.library.encode(x)
        assert m.listed(ids) == ",".join(map(str, ids.tolist()))
        assert m.decode(ids) == m.library.decode(ids.tolist())
        if len(ids):
            assert starts[0] == 0 and ends[-1] == len(x.encode()) and (starts[1:] == ends[:-1]).all()


def test_character_map_takes_the_longest_prefix():
    # a double array with the keys "a" -> "x" and "ab" -> "yz", laid out by hand
    texts = b"x\0yz\0"
    units = np.zeros(1024, np.uint32)
    unit = lambda label, offset, leaf: label | leaf << 8 | offset << 10
    units[0] = unit(0, 256, 0)  # root: children at 256 ^ label
    a = 256 ^ ord("a")
    units[a] = unit(ord("a"), 512 ^ a ^ 0, 1)
    base = a ^ (512 ^ a)
    units[base] = 0x80000000 | 0  # value of "a": offset 0
    b = base ^ ord("b")
    units[b] = unit(ord("b"), 768 ^ b, 1)
    units[b ^ (768 ^ b)] = 0x80000000 | 2
    blob = np.uint32(4 * len(units)).tobytes() + units.tobytes() + texts
    found = pieces.CharMap(blob)
    assert found.longest(b"abc", 0) == (2, b"yz")
    assert found.longest(b"acb", 0) == (1, b"x")
    assert found.longest(b"cab", 0) is None
    m = pieces.Pieces.__new__(pieces.Pieces)
    m.map, m.dummy, m.squeeze, m.escape, m.own, m.plain, m.suffix = found, True, True, True, [], False, False
    text, source = m.normalise("  c ab  a ")
    assert text == "▁c▁yz▁x"
    assert source.tolist() == [2, 2, 2, 2, 3, 3, 3, 4, 4, 6, 6, 6, 8, 9]


def test_op5_on_odd_rows(odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = collections.Counter()
    for i, x in ODD:
        ids = sp.encode(x or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r)[:4] for r in pieces.digests(odd).collect()) == want
    assert pieces.digests(empty).count() == 0
    spans = {r["doc_id"]: r for r in pieces.encode(odd).where("doc_id = 10").collect()}[10]
    assert spans["ends"][-1] == len(ODD[-1][1].encode())


def test_op6_on_odd_rows(odd, empty):
    bpe = bytebpe.byte_bpe()
    got = sorted((tuple(r) for r in tokenfile.contract(odd).collect()), key=lambda r: r[1])
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for (i, start, n, crc), (j, x) in zip(got, order, strict=True):
        ids = np.append(np.array(bpe.model.encode(x or "", add_special_tokens=False).ids, "<u4"), [0]).astype("<u4")
        assert (i, start, n, crc) == (j, at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    assert tokenfile.contract(empty).count() == 0


def test_token_files_give_one_document(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    tokenfile.write(docs, path, block_ids=3000)
    for i, x in pairs_of(docs.where("doc_id in (3, 77)")):
        assert tokenfile.fetch(spark, path, i) == [[*bytebpe.byte_bpe().model.encode(x, add_special_tokens=False).ids, 0]]


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(0).integers(0, 1 << min(width, 31), 1000).astype(np.uint32)
    data = tokenfile.pack_bits(ids, width)
    assert len(data) == -(-1000 * width // 8)
    assert (tokenfile.unpack_bits(data, width, 137, 501) == ids[137:638]).all()


# packing


def check_packed(rows, texts, bpe):
    filled, parts = collections.Counter(), collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]] and r["length"] > 0
        filled[r["sequence_id"]] += r["length"]
        parts[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert max(filled.values(), default=0) <= 1024
    for i, x in texts:
        ids = np.append(np.array(bpe.model.encode(x, add_special_tokens=False).ids, "<u4"), [0]).astype("<u4")
        at = 0
        for start, n, crc, total in sorted(parts[i]):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[start : start + n].tobytes()))
            at += n
        assert at == len(ids)
    padding = sum(1024 - n for n in filled.values() if n & (n - 1))
    return padding / max(1, sum(filled.values()))


def test_op1_packs_every_id_once(docs, odd, empty):
    bpe = bytebpe.byte_bpe()
    assert check_packed(packing.contract(docs).collect(), pairs_of(docs), bpe) < 0.01
    single = odd.where("doc_id <> 6 and doc_id is not null")
    assert check_packed(packing.contract(single).collect(), pairs_of(single), bpe) < 0.02
    assert packing.contract(odd).agg(F.sum("length")).first()[0] == sum(len(bpe.whole(x or "")) // 4 + 1 for _, x in ODD)
    assert packing.contract(empty).count() == 0


def test_packing_keeps_all_three_limits():
    rng, packer = random.Random(5), packing.Packer((100, 4, 30), pool=50)
    out, docs = [], {}
    for i in range(400):
        n = rng.randrange(1, 160)
        docs[i] = (n, rng.randrange(0, n + 1))
        out += packer.add(i, bytes(4 * n), docs[i][1])
        if len(packer.items) >= 50:
            out += packer.pack(25)
    out += packer.finish()
    seen, load = collections.defaultdict(list), collections.defaultdict(lambda: [0, 0, 0])
    for i, start, n, ids, total, q, offset in out:
        assert offset == load[q][0]
        seen[i].append((start, n))
        load[q][0] += n
        load[q][1] += 1
        load[q][2] += start + n - max(start, min(docs[i][1], start + n))
    assert all(a <= 100 and b <= 4 and c <= 30 for a, b, c in load.values())
    for i, (n, _) in docs.items():
        at = 0
        for s, k in sorted(seen[i]):
            assert s == at
            at += k
        assert at == n


def test_a_sequence_that_takes_the_whole_pool_is_closed():
    packer, out = packing.Packer((1024, 5000, 1024), pool=50), []
    for i in range(220):
        out += packer.add(i, bytes(8))
        if len(packer.items) >= 50:
            out += packer.pack(25)
    out += packer.finish()
    at = collections.Counter()
    for _, _, n, _, _, q, offset in out:
        assert offset == at[q]
        at[q] += n
    assert sum(at.values()) == 440


def test_prompts_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "a b c", "long prompt here"), (2, "x", None)], "doc_id long, text string, prompt string")
    rows = sorted(packing.pack(df, prompt_col="prompt").where("doc_id = 1").collect(), key=lambda r: r["start"])
    bpe = bytebpe.byte_bpe()
    assert b"".join(bytes(r["ids"]) for r in rows) == bpe.whole("long prompt here") + bpe.whole("a b c") + bytes(4)


# personal data


@pytest.mark.parametrize(
    "text, base, found",
    [
        ("a@b.c and x@y", "email:0:5", []),
        ("1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "ip:0:7,ip:8:15,ip:26:36", []),
        ("4111 1111-1111 1111, 4111111111111112", "card:0:19", []),
        ("+1 (017) 555-7713 +12", "phone:0:17", []),
        ("bob [at] mail (dot) example dot com.", "", ["bob [at] mail (dot) example dot com"]),
        ("bob at mail dot example dot com", "", ["bob at mail dot example dot com"]),
        ("call +1 five five five one two three four five six seven ok", "", ["+1 five five five one two three four five six seven"]),
        ("１９２.168.1.1 аnna@mail.example.com", "email:13:33", ["１９２.168.1.1", "аnna@mail.example.com"]),
        ("look at the. Next dot is at home", "", []),
        ("9" * 5000 + ".1.1.1", "", []),
    ],
)
def test_identifiers(text, base, found):
    b = pii.find_base(text)
    assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(b)) == base
    assert [text[s:e] for s, _, e in sorted(pii.find_hidden(text, b))] == found


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(x):
    def fine(kind, x):
        d = re.sub("[^0-9]", "", x)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in x.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    return sorted((m.start(), n, m.end()) for n, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, x) if fine(kind, m[0]))


def test_base_patterns_on_random_texts():
    rng = random.Random(12)
    for _ in range(4000):
        x = "".join(rng.choice(["a", "_", "@", "@", ".", ".", "-", "%", "é", " ", "+", "1", "25", "300", "a@b.c", "1.2.3.4", "(", "\n", "4111111111111111"]) for _ in range(rng.randrange(1, 40)))
        assert sorted(pii.find_base(x)) == plain_spans(x)


@pytest.mark.parametrize("text", ["9" * 10**6, "a" * 10**6 + " b@c", "a@" * 500_000, "+" * 10**6, " " * 10**6, "+1" + " " * 10**6, "1." * 500_000, "1 " * 500_000, "a@b.c " * 100_000, "zero " * 200_000])
@pytest.mark.parametrize("hint", ["", " x [at] y "])
def test_long_runs_take_linear_time(text, hint):
    import time

    data = np.frombuffer((text + hint).encode(), np.uint8)
    pii.scan(textops.Block(data[:10], np.array([0, 10])))
    began = time.process_time()
    pii.scan(textops.Block(data, np.array([0, len(data)])))
    assert time.process_time() - began < 12  # quadratic work would take hours


def disguise(rng, kind, x):
    """One of the disguises that the method undoes."""
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    how = rng.choice(["lookalike", "invisible", "words"])
    if how == "lookalike":
        back = {v: k for k, v in pii.LOOKALIKES.items()} | {str(d): chr(0xFF10 + d) for d in range(10)}
        at = rng.choice([k for k, c in enumerate(x) if c in back])
        return x[:at] + back[x[at]] + x[at + 1 :]
    if how == "invisible":
        at = rng.randrange(2, len(x) - 1)
        return x[:at] + rng.choice(pii.INVISIBLE) + x[at:]
    if kind == "email":
        at, dot = rng.choice([" [at] ", "(at)", " at "]), rng.choice([" [dot] ", "(dot)", " dot "])
        return x.replace("@", at).replace(".", dot)
    if kind == "ip":
        return " dot ".join(" ".join(names[int(c)] for c in p) for p in x.split("."))
    digits = [names[int(c)] if c.isdigit() else c for c in x]
    return " ".join(digits).replace("+ ", "+")


def test_recall_of_disguises():
    rng, hit, n = random.Random(13), collections.Counter(), collections.Counter()
    for _ in range(3000):
        kind = rng.choice(pii.KINDS)
        if kind == "email":
            x = "".join(rng.choice("abcdeiop") for _ in range(6)) + "@" + "".join(rng.choice("abcdeiop") for _ in range(5)) + ".com"
        elif kind == "ip":
            x = ".".join(str(rng.randrange(256)) for _ in range(4))
        elif kind == "card":
            x = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
            x += next(str(d) for d in range(10) if luhn(x + str(d)))
        else:
            x = "+1" + "".join(str(rng.randrange(10)) for _ in range(10))
        y = disguise(rng, kind, x)
        text = f"reach me: {y} ; thanks"
        data = np.frombuffer(text.encode(), np.uint8)
        _, base, more = pii.scan(textops.Block(data, np.array([0, len(data)])))[0]
        n[kind] += 1
        hit[kind] += any(k == pii.KINDS.index(kind) and s <= 10 and e >= 10 + len(y) for s, k, e in base + more)
    assert all(hit[k] / n[k] > 0.97 for k in n), (hit, n)


def test_op8_base_is_the_plain_definition(docs, odd, empty):
    for df in (docs, odd):
        want = collections.Counter()
        for i, x in pairs_of(df):
            want[(i, hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(x)).encode()).hexdigest())] += 1
        got = pii.contract(df).collect()
        assert collections.Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
        assert all(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len([s for s in r["spans"].split(",") if s]) for r in got)
    assert pii.contract(empty).count() == 0


def test_fragments_do_not_hide_the_whole_identifier(spark):
    rows = [(1, "to j\u043ehn.smith@example.com now"), (2, "to john@example.c\u043em now"), (3, "to jo\u00adhn\u200b@example.com now \u043e"), (4, "to john@example.com now, \u043e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_email"], r["spans"]) for r in pii.contract(df).collect()}
    assert got == {1: (2, "email:3:25,email:5:25"), 2: (2, "email:3:17,email:3:19"), 3: (1, "email:3:21"), 4: (1, "email:3:19")}
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out == {1: "to <EMAIL> now", 2: "to <EMAIL> now", 3: "to <EMAIL> now \u043e", 4: "to <EMAIL> now, \u043e"}
    assert pii.masked("0123456789", [(1, 3, 4), (2, 0, 9), (4, 1, 5)]) == "0<EMAIL>9"


@pytest.mark.parametrize(
    "text, kind",
    [
        ("4111\u00ad1111\u00ad1111\u00ad1111", "card"),
        ("+1 555\u00ad123 4567", "phone"),
        ("10.0.\u00ad0.1", "ip"),
        ("+1 555 \u00b9\u00b2\u00b3 4567", "phone"),
        ("one nine two dot one six eight dot zero dot one", "ip"),
        ("192 dot one six eight dot 0 dot one", "ip"),
        ("+1 555 one two three 4567", "phone"),
        ("+1 (five five five) 123 four five six seven", "phone"),
        ("+ one 555 123 4567", "phone"),
        ("4111 1111 eins eins eins eins 1111", "card"),
    ],
)
def test_disguises_pass_the_gates(text, kind):
    data = np.frombuffer(f"plain text{text}".encode(), np.uint8)
    found = pii.scan(textops.Block(data, np.array([0, 10, len(data)])))
    assert found[0][1:] == ([], [])
    assert (0, pii.KINDS.index(kind), len(text)) in found[1][2]


def test_all_rewritten_characters_pass_the_gate():
    every = (chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    assert all(pii._leads[c.encode()[0]] for c in every if pii.plain_char(c) is not None)


def test_digit_words_with_a_turkish_i():
    assert pii.find_hidden("+1 555 f\u0131ve S\u0130X five 4567", [])[0][:2] == (0, 3)


def test_digit_words_in_prose_stay_closed():
    first = b"one of the two men had a dos machine, "
    data = np.frombuffer(first + b"un point", np.uint8)
    assert pii.spells_digits(data, np.array([0, len(first), len(data)])).tolist() == [False, True]
    assert pii.spells_digits(np.zeros(0, np.uint8), np.array([0, 0])).tolist() == [False]


def test_redaction_keeps_columns(odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert out.where("doc_id = 10").first()["text"] == "mail <EMAIL> or <PHONE>, <IP>, 10.0.0.256"
    assert out.where("doc_id = 2").first()["text"] is None


# repetition


def longest_repeats(w):
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            if i != j:
                k = 0
                while i + k < len(w) and j + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    return best


def test_suffix_array_finds_the_longest_repeats():
    rng = random.Random(6)
    texts = [[rng.choice("abc") for _ in range(rng.randrange(60))] for _ in range(30)] + [["a"] * 40, ["a", "b"] * 20]
    h = np.array([ord(c) for w in texts for c in w], np.uint64)
    doc = np.array([k for k, w in enumerate(texts) for _ in w])
    got = repetition.repeats(h, doc, len(texts))
    assert got.tolist() == [v for w in texts for v in longest_repeats(w)]


def test_op9_statistics(docs, odd, empty):
    def plain(x):
        w = words(x)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        repeated = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for k in range(3)}
        lines = [line for line in (x or "").split("\n") if words(line)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)

    for df in (docs, odd):
        got = repetition.repetition_rules(df).collect()
        want = collections.Counter((i, *plain(x)) for i, x in pairs_of(df))
        assert collections.Counter(tuple(r)[:7] for r in got) == want
        assert not any(r["base_failed"] and r["kept"] for r in got)
    assert repetition.repetition_rules(empty).count() == 0


def test_repetition_verdict(spark):
    fresh = " ".join(f"w{i}" for i in range(300))
    block = " ".join(f"r{i}" for i in range(100))
    rows = [(1, fresh), (2, f"{fresh} {block} mid {block}"), (3, f"{fresh} {block[:80]} x {block[:80]}")]
    got = {r["doc_id"]: r for r in repetition.repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["covered_fraction"] == 0
    assert not got[2]["kept"] and not got[2]["base_failed"] and got[2]["longest_repeat"] == 100
    assert got[3]["kept"] and got[3]["covered_fraction"] > 0


# near copies


def brute_components(rows, size, percent):
    sets = {}
    for i, x in rows:
        w = words(low(x))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    """Copies, edited copies that only link in chains, and sets at the threshold."""
    rng = random.Random(8)
    rows, n = [], 0
    for g in range(6):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(12):
            x = list(base)
            for _ in range(rng.randrange(9)):
                x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(x)))
            n += 1
            if rng.random() < 0.5:
                base = x
    rows += [(n, "Short Text"), (n + 1, "short  text"), (n + 2, ""), (n + 3, " ")]
    return rows


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_op4_equals_brute_force(spark, docs, size, percent, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 5)
    made = spark.createDataFrame(near_rows(), "doc_id long, text string").repartition(5)
    for df in (made, docs):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, words=size, percent=percent).collect()}
        assert got == {i: (n, c, c == i) for i, (n, c) in brute_components(pairs_of(df), size, percent).items()}


def test_op4_on_odd_rows(odd, empty):
    got = collections.Counter(tuple(r) for r in minhash.contract(odd).collect())
    n = 701
    assert got[(5, n, 5, True)] == 1 and got[(6, n, 5, False)] == 2
    assert got[(2, 0, 2, True)] == got[(3, 0, 3, True)] == got[(4, 0, 4, True)] == 1
    assert got[(7, 1, 7, True)] == got[(9, 1, 7, False)] == 1
    assert sum(v for k, v in got.items() if k[0] is None) == 2 and all(k[3] for k in got if k[0] is None)
    assert minhash.contract(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    sig = minhash.signatures(np.concatenate([a, b, a[:1]]), np.repeat([0, 1, 2], [400, 400, 1]), 3)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.15
    assert len(set(sig[2].tolist())) > 100  # one element reaches every slot, each with a value of its own


# sentences


def word_hash(w):
    data = np.frombuffer(w.encode(), np.uint8)
    return int(textops.hashes(textops.prefix_hash(data), np.array([0]), np.array([len(data)]))[0])


def brute_cut(rows, run=sentences.RUN, least=sentences.MIN_WORDS):
    """Rows (id, text) after the cut, by the definition of the docstring; rows that share an id are versions of one document."""
    places, found = collections.defaultdict(set), []
    for i, x in rows:
        w = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", x)]
        whole, now = [], []
        for k, (a, b) in enumerate(w):
            now.append((a, b))
            if x[b - 1] in ".!?" or k + 1 == len(w) or "\n" in x[b : w[k + 1][0]]:
                whole.append(now)
                now = []
        parts = []
        for p in whole:
            now = []
            for k, (a, b) in enumerate(p):
                now.append((a, b))
                if k + 1 == len(p) or (len(p) > sentences.LONG and word_hash(low(x[a:b])) % sentences.CUT == 0):
                    parts.append(now)
                    now = []
        spans = []
        for a in range(len(parts)):
            b = next((b for b in range(a + run, len(parts) + 1) if sum(map(len, parts[a:b])) >= least), None)
            if b:
                spans.append((a, b))
        if spans:
            spans.append((spans[-1][0], len(parts)))
        spans = [(tuple(low(x[s:e]) for p in parts[a:b] for s, e in p), a, b) for a, b in spans]
        for key, a, _ in spans:
            if i is not None:
                places[key].add((i, a))
        found.append((parts, spans))
    out = []
    for (i, x), (parts, spans) in zip(rows, found, strict=True):
        gone = {k for key, a, b in spans if i is not None and min(places[key]) != (i, a) for k in range(a, b)}
        at = [p[0][0] for p in parts] + [len(x)]
        out.append((i, x[: at[0]] + "".join(x[at[k] : at[k + 1]] for k in range(len(parts)) if k not in gone) if parts else x, len(gone), sum(len(parts[k]) for k in gone)))
    return out


def test_op10_equals_brute_force(docs):
    got = {r["doc_id"]: tuple(r) for r in sentences.contract(docs).collect()}
    want = brute_cut(pairs_of(docs))
    assert got == {r[0]: r for r in want} and sum(r[2] > 0 for r in want) > 20


@pytest.mark.parametrize("run, least, held", [(1, 3, 50), (3, 8, 7), (2, 30, 1 << 19)])
def test_op10_versions_of_a_document_ties_and_blocks(spark, run, least, held, monkeypatch):
    monkeypatch.setattr(sentences, "HELD_RUNS", held)
    rng = random.Random(run)
    common = ["".join(rng.choice(["a b. ", "c ", "d, ", "E f g! ", "h\n", "i j k l m n o p q r s t u v "]) for _ in range(30)) for _ in range(6)]
    rows = [(rng.choice([None, 1, 2, 3, 4, 4, 5, 6, 7]), " ".join(rng.sample(common, 2)) + f"x{rng.randrange(3)}") for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter(tuple(r) for r in sentences.remove_repeats(df, run=run, min_words=least).collect())
    want = collections.Counter(brute_cut(rows, run, least))
    assert got == want


def test_op10_on_odd_rows(odd, empty):
    out = sentences.remove_repeats(odd.withColumn("n_removed", F.lit("x")).withColumn("spans", F.lit(1)))
    rows = out.collect()
    assert out.columns == [*odd.columns, "n_removed", "n_removed", "n_removed_words"] and len(rows) == len(ODD)
    assert collections.Counter((r["doc_id"], r["text"] or "", *r[-2:]) for r in rows) == collections.Counter(brute_cut([(i, x or "") for i, x in ODD]))
    assert [r["text"] for r in rows if r["doc_id"] in (None, 2, 3)].count(None) == 2
    assert next(r["text"] for r in rows if r["doc_id"] == 5).startswith(LONG[:2000])
    assert [r[-2] for r in rows if r["doc_id"] is None] == [0, 0]
    assert sentences.remove_repeats(empty).count() == 0


def test_op10_versions_of_different_length(spark):
    long = " ".join(f"w{i}" for i in range(90)) + "."
    rows = [(5, long), (6, long), (6, "short other text."), (6, "lead in. " + long)]
    got = collections.Counter(tuple(r) for r in sentences.contract(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter(brute_cut(rows))
    assert sum(r[2] > 0 for r in got) == 2


@pytest.mark.parametrize("lengths, stop", [([13] * 6, "."), ([17] * 5, "!"), ([8] * 9, '."'), ([13] * 6, "。"), ([9] * 8, "…»"), ([30, 16, 30], ".')"), ([200], ".")])
def test_a_passage_cut_in_mid_sentence_goes(spark, tmp_path, lengths, stop):
    from terrane.llm import queries

    rng, rows, passages = random.Random(len(lengths)), [], []
    for n in range(40):
        long = [f"p{n}k{k}q{j}" + (stop if j + 1 == size else "") for k, size in enumerate(lengths) for j in range(size)]
        at = rng.randrange(len(long) - 51)
        passages.append(" ".join(long[at : at + 51]))
        for copy in range(2):
            around = [" ".join(f"{x}{n}c{copy}i{i}" for i in range(40)) for x in "ab"]
            rows.append((100 * copy + n, f"{around[0]} {passages[-1]} {around[1]}."))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op10_sentences(spark, str(tmp_path)).collect()}
    left = []
    for i, x in rows:
        if i < 100:
            assert (got[i]["text"], got[i]["n_removed"]) == (x, 0)
        else:
            kept = got[i]["text"].split()
            inside = set(passages[i - 100].split())
            assert [w for w in kept if w not in inside] == [w for w in x.split() if w not in inside]  # nothing else goes
            left.append(sum(w in inside for w in kept))
    assert sum(n <= 25 for n in left) >= 38 and np.mean(left) < 15


# models


def test_factor_sums_equal_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(30)
    m.w, m.bias = rng.normal(size=30), 0.3
    feature, x = np.array([2, 5, 7, 29]), np.array([0.5, 1.0, -2.0, 0.1])
    want = m.bias + m.w[feature] @ x + sum(m.v[a] @ m.v[b] * p * q for i, (a, p) in enumerate(zip(feature, x)) for b, q in list(zip(feature, x))[i + 1 :])
    assert abs(m.raw(np.zeros(4, int), feature, x, 1)[0][0] - want) < 1e-9


def test_op2_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = quality.contract(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in out)
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.95


def test_op2_on_odd_rows(odd, empty, labels):
    rows = quality.contract(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert quality.contract(empty, labels).count() == 0
    assert {r["score"] for r in quality.contract(odd, labels.limit(0)).collect()} == {0.5}


def test_op3_on_odd_rows(odd, empty, labels):
    rows = lmscore.contract(odd, labels).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(words(x)) for _, x in ODD)
    assert all(r["score"] == 0 for r in rows if r["n_tokens"] == 0)
    assert lmscore.contract(empty, labels).count() == 0


def brute_scores(rows, good):
    """Leave-one-out scores from plain counts."""
    held = []
    for i, x in rows:
        w = ["", *words(low(x)), ""]
        held.append((i in good, collections.Counter(zip(w, w[1:])) if len(w) > 2 else {}, collections.Counter(w[1:]) if len(w) > 2 else {}))
    pair = [sum((collections.Counter(p) for g, p, _ in held if g or k), collections.Counter()) for k in (0, 1)]
    one = [sum((collections.Counter(u) for g, _, u in held if g or k), collections.Counter()) for k in (0, 1)]
    size = [sum(c.values()) for c in one]
    ratio, v, s, m = (size[1] + 1) / (size[0] + 1), lmscore.VOCABULARY, lmscore.SMOOTHING, lmscore.MIX
    for (i, _), (g, p, u) in zip(rows, held):
        total, n = 0.0, sum(u.values())
        for (a, b), times in p.items():
            losses = []
            for k, r, own in ((0, 1, g), (1, ratio, 1)):  # target, background
                first = (one[k][b] - own * u[b] + s * r) / (size[k] - own * n + s * r * v)
                second = (pair[k][a, b] - own * p[a, b] + s * r) / (one[k][a] - own * u[a] + s * r * v)
                losses.append(-(1 - m) * np.log(first) - m * np.log(second))
            total += times * (losses[0] - losses[1])
        yield i, max(n - 1, 0), total / max(n, 1)


@pytest.mark.parametrize("block, part, few", [(4 << 20, 1 << 20, 1 << 20), (3000, 500, 0)])
def test_op3_equals_brute_force(spark, docs, odd, labels, sf_dir, block, part, few, monkeypatch):
    monkeypatch.setattr(lmscore, "BROADCAST_IDS", few)
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", block)
    monkeypatch.setattr(lmscore, "PART_TOKENS", part)
    for df, known in ((docs.limit(120), spark.read.parquet(f"{sf_dir}/labels.parquet")), (odd.where("doc_id is null or doc_id not in (5, 6)"), labels)):
        rows, good = pairs_of(df), {r["doc_id"] for r in known.collect() if r["quality"] == 1 and r["doc_id"] is not None}
        got = sorted((tuple(r) for r in lmscore.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), known).collect()), key=str)
        want = sorted(brute_scores(rows, good), key=str)
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-4)


def test_op3_tells_good_from_other_documents(spark):
    """Leave-one-out scores of labelled documents of sf0.1: no document is scored by a model that has seen it."""
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    once = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")  # copies left aside
    rows = lmscore.contract(docs, labels).join(labels, "doc_id").join(once, "doc_id").where("n_tokens > 0 and quality is not null").select("quality", "score").toPandas()
    rank = rows.score.rank().to_numpy()
    good = (rows.quality == 1).to_numpy()
    auc = 1 - (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / good.sum() / (~good).sum()
    assert auc > 0.97


def test_words_are_told_apart():
    every = [f"w{i}" for i in range(200_000)]
    data = np.frombuffer(" ".join(every).encode(), np.uint8)
    key = lmscore.Entries(textops.Block(data, np.array([0, len(data)]))).key
    assert len(key) == len(set(key.tolist())) == 2 * len(every) + 2


#: Look-alikes that are written here by their Unicode names, not read from the operator.
NAMED = [
    ("bob@mail.com", "LATIN SMALL LETTER DOTLESS I", 6, "i"), ("bob@mail.com", "ARMENIAN SMALL LETTER OH", 1, "o"), ("bob@mail.com", "CYRILLIC SMALL LETTER A", 5, "a"), ("bob@mail.com", "GREEK SMALL LETTER OMICRON", 1, "o"),
    ("bob@mail.com", "LATIN LETTER SMALL CAPITAL B", 0, "b"), ("bob@mail.com", "CHEROKEE LETTER YV", 2, "b"), ("bob@mail.com", "FULLWIDTH LATIN SMALL LETTER B", 0, "b"), ("bob@mail.com", "MATHEMATICAL BOLD SMALL L", 7, "l"),
    ("bob@mail.com", "LATIN SMALL LETTER ALPHA", 5, "a"), ("hugo@mail.com", "LATIN SMALL LETTER SCRIPT G", 2, "g"), ("sun@mail.com", "ARMENIAN SMALL LETTER SEH", 1, "u"), ("quinn@mail.com", "CYRILLIC SMALL LETTER QA", 0, "q"),
    ("will@mail.com", "CYRILLIC SMALL LETTER WE", 0, "w"), ("kim@mail.com", "GREEK SMALL LETTER KAPPA", 0, "k"), ("10.20.30.40", "ARABIC-INDIC DIGIT TWO", 3, "2"), ("10.20.30.40", "FULLWIDTH DIGIT FOUR", 9, "4"),
]


def _spans(text):
    data = np.frombuffer(text.encode(), np.uint8)
    _, base, more = pii.scan(textops.Block(data, np.array([0, len(data)])))[0]
    return base + more


@pytest.mark.parametrize("plain, name, at, letter", NAMED)
def test_named_lookalikes(plain, name, at, letter):
    assert plain[at] == letter
    text = f"to {plain[:at]}{unicodedata.lookup(name)}{plain[at + 1 :]} now"
    assert (3, pii.KINDS.index("email" if "@" in plain else "ip"), 3 + len(plain)) in _spans(text)


def test_script_words():
    assert (3, 0, 15) in _spans("to ᏴᎾᏴ@mail.com now") and (0, 0, 12) in _spans("ʙᴏʙ@ᴍᴀɪʟ.ᴄᴏᴍ")


@pytest.mark.parametrize("text, span", [("ask bob at mail.com now", (4, 19)), ("jane.doe at example.org", (0, 23)), ("(x_1 at mail.site.co.uk), then", (1, 23)), ("Bob at Mail.Com.", (0, 15))])
def test_plain_at(text, span):
    assert [(s, e) for s, k, e in _spans(text)] == [span]


@pytest.mark.parametrize("text", ["look at example.com", "visit us at www.shop.com", "bob at www.shop.com", "he arrived at noon.Then it rained", "Available at site.org", "bob at mail", "bob at .com", "cat hat mat.com", "files at x.py"])
def test_plain_at_leaves_others(text):
    assert _spans(text) == []
