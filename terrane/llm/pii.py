"""Personal data: identifiers in the text as it stands, and identifiers that are disguised.

`find_base` finds e-mail addresses, IP addresses, card and telephone numbers literally. For the
rest a transducer rewrites a copy of the text and keeps, for every rewritten character, the source
span it comes from: look-alike letters and digits become ASCII, zero-width characters go,
spelled digits become digits, and "[at]", "(dot)" and their spaced forms become "@" and ".". A plain "x at y.tld"
counts where x is no common word before "at" and the domain is a common one. The
same detectors run over the copy, and what touches a rewritten place maps back to source spans. Where
spelled digits stand beside a digit, a plus sign or a dot word, a second copy rewrites shorter runs too;
what either copy shows counts. A digit word right after a literal number is so taken to be part of it.

Null and empty texts hold nothing. A null id stays null; rows are scanned one by one, repeated or
not; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as t
from .spaces import map_blocks

KINDS = ("email", "ip", "card", "phone")
#: What stands before and after the @ of an e-mail address; the whole pattern would try every start of a long run.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match that began inside a run of digits would also begin at its start, and none ends inside one.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]")

#: Digit words that are rewritten: in runs of at least MIN_SPELLED, and in any run beside a digit, a plus sign or a dot word.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
MIN_SPELLED = 4
#: Letters of other scripts, and odd ones of the Latin script, that look like ASCII letters (fixed values).
SCRIPTS = {
    "Cyrillic": ("асеорхуѕіјԁһкмтпԛԝѵӏАВСЕНІЈКМОРЅТХУԌҮ", "aceopxysijdhkmtnqwvlABCEHIJKMOPSTXYGY"),
    "Greek": ("οανρικγηωϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavpikynwcjABEZHIKMNOPTYX"),
    "Armenian": ("օոսհցզյ", "onuhgqj"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎾᏀᏃᏎᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHOGZ4VSLCPKB"),
    "Latin": ("ıɑɡɩʋᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "iagivabcdeghijklmnoprstuvwyz"),
}
LOOKALIKES = {a: b for odd, plain in SCRIPTS.values() for a, b in zip(odd, plain, strict=True)}
INVISIBLE = "­​‌‍⁠﻿"

_word = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_spelled = re.compile(rf"(?i)\b(?:{_word})(?:[\s,.-]{{1,2}}(?:{_word})\b){{{MIN_SPELLED - 1},}}")
_one = re.compile(rf"(?i){_word}")
_short = re.compile(rf"(?i)(?:(?<=\+)\s{{1,2}})?\b(?:{_word})\b(?:[\s,-]{{1,2}}(?:{_word})\b)*")
_dot_words = ("dot", "punkt", "point", "punto")
_dot = r"(?:\s*[\[({<]\s*(?:dot|punkt|point|punto)\s*[\])}>]\s*|\s+(?:dot|punkt|point|punto)\s+)"
_at_bracket = re.compile(r"(?i)(?<!\s)\s*[\[({<]\s*(?:at|@|arroba|ät)\s*[\])}>]\s*")
_at_plain = re.compile(rf"(?i)(?<=[a-z0-9_%+-])\s+(?:at|arroba)\s+(?=[a-z0-9-]+{_dot}[a-z0-9])")
#: Top-level domains behind which a plain "x at y.tld" counts, and words before "at" that are no address (fixed values).
TLDS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "eu", "us", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "be", "ru", "ca", "au")
NO_ADDRESS = frozenset((
    "a an and are arrive arrived ask at available be been book booked browse bought buy by call check click contact directly down download email find for found free get go have here him her his home how i in info "
    "information is it join just later learn link list listed live located login look looked looking looks mail me meet more now of off office on online open or order out over page posted published read reach register "
    "registered see seen sell shop shopping sign site sold start stay store that the them there these they this today up us visit was we website were what when where who with work worked working works write you"
).split())
_tld = "|".join(TLDS)
_at_word = re.compile(rf"(?i)(?<![a-z0-9._%+-])([a-z0-9._%+-]{{1,64}}) at (?!www\.)(?:[a-z0-9-]{{1,63}}\.){{1,4}}(?:{_tld})(?![a-z0-9.-]*[a-z0-9])")
_at_hint = re.compile(rb" at [a-z0-9-]{1,63}\.[a-z0-9]")
_dot_near = re.compile(rf"(?i)(?<=[a-z0-9-]){_dot}(?=[a-z0-9])")
_hints = re.compile(rb"[\[({<]\s*(?:at|@|arroba|\xc3\xa4t|dot|punkt|point|punto)\s*[\])}>]|\s(?:dot|punkt|point|punto)\s")
_separators = t.SPACE.copy()
_separators[list(b",.-")] = True
_brackets = _separators.copy()
_brackets[list(b"()[]{}<>+")] = True
_digits = np.zeros(256, bool)
_digits[list(b"0123456789")] = True
_longest_word = max(len(w.encode()) for w in DIGIT_WORDS)
_hint_words = (b"dot", b"punkt", b"point", b"punto", b"[", b"(", b"{", b"<")
#: Lead bytes of all characters that plain_char rewrites: look-alikes, wide and raised forms, digits, invisible characters.
_leads = np.zeros(256, bool)
_leads[[0xC2, 0xC5, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD9, 0xDB, 0xDF, 0xE0, 0xE1, 0xE2, 0xEA, 0xEF, 0xF0]] = True
_leads[[c.encode()[0] for c in LOOKALIKES]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every literal identifier; leftmost and non-overlapping within a kind."""
    found, at, free = [], text.find("@"), 0
    while at >= 0:  # an address has one @, so each is tried once, with the run of characters before it
        start = at - len(head := text[free:at]) + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in IP.finditer(text):
        if all(len(p) <= 3 or not p[:-3].strip("0") for p in m[0].split(".")) and all(int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _not_digit.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_not_digit.sub("", m[0])) <= 15]
    return found


def plain_char(c: str) -> str | None:
    """What a character is rewritten to, or None if it stays."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() and not n.isspace() else None


class Rewritten:
    """A text with the source span of each of its characters; a rewrite composes with those before it."""

    def __init__(self, text: str):
        self.text, self.start = text, np.arange(len(text))
        self.end, self.changed = self.start + 1, np.zeros(len(text), bool)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans, in order and apart; each new character stands for the whole span."""
        if not edits:
            return
        text, parts, at = [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            parts.append((self.start[at:s], self.end[at:s], self.changed[at:s]))
            k = len(new)
            parts.append((np.full(k, self.start[s]), np.full(k, self.end[e - 1]), np.ones(k, bool)))
            at = e
        parts.append((self.start[at:], self.end[at:], self.changed[at:]))
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end, self.changed = (np.concatenate(x) for x in zip(*parts, strict=True))


def digit_of(word: str) -> str:
    """The digit of a digit word; patterns that ignore case also match the dotless and the dotted Turkish i."""
    return DIGIT_WORDS[word.lower().replace("i\u0307", "i").replace("\u0131", "i")]


def normalise(text: str, runs: re.Pattern = _spelled) -> Rewritten:
    out = Rewritten(text)
    out.apply([(i, i + 1, n) for i, c in enumerate(text) if c > "\x7f" and (n := plain_char(c)) is not None])
    spelled = []
    for m in runs.finditer(out.text):
        words = list(_one.finditer(m[0]))
        ends = [w.end() for w in words]
        spelled += [(m.start() + (0 if k == 0 else ends[k - 1]), m.start() + ends[k], digit_of(w[0])) for k, w in enumerate(words)]
    out.apply(spelled)
    for pattern, new in ((_at_bracket, "@"), (_at_plain, "@"), (_dot_near, ".")):
        out.apply([(m.start(), m.end(), new) for m in pattern.finditer(out.text)])
    if " at " in out.text:
        out.apply([(m.end(1), m.end(1) + 4, "@") for m in _at_word.finditer(out.text) if m[1].strip("._%+-").lower() not in NO_ADDRESS])
    return out


class Cover:
    """Which spans lie whole in a span of their kind."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [[] for _ in KINDS], [[] for _ in KINDS]
        for s, k, e in sorted(spans):
            self.starts[k].append(s)
            self.ends[k].append(max(e, self.ends[k][-1]) if self.ends[k] else e)

    def holds(self, s: int, k: int, e: int) -> bool:
        at = bisect.bisect_right(self.starts[k], s)
        return at > 0 and self.ends[k][at - 1] >= e


def disguised(text: str) -> list[tuple[int, int, int]]:
    """Identifiers that hold a rewritten place, or one where a character went, in source positions."""
    found: list[tuple[int, int, int]] = []
    for out in (normalise(text), normalise(text, _short)):
        changed, before, new = np.concatenate([[0], np.cumsum(out.changed)]), Cover(found), []
        for s, kind, e in find_base(out.text):
            a, b = int(out.start[s]), int(out.end[e - 1])
            if (b - a != e - s or changed[e] > changed[s]) and not before.holds(a, kind, b):
                new.append((a, kind, b))
        found += new
    return found


def find_hidden(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The disguised identifiers that none of their kind in `base` covers whole; a fragment in `base` stays beside them."""
    known = Cover(base)
    return [x for x in disguised(text) if not known.holds(*x)]


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


@functools.lru_cache(4)
def _hashes_of(words: tuple[str, ...]) -> np.ndarray:
    found = []
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        found.append(t.hashes(t.prefix_hash(data), np.array([0]), np.array([len(data)]))[0])
    return np.array(sorted(found), np.uint64)


def spells_digits(low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents hold MIN_SPELLED digit words in a row, or one beside a digit, a plus sign or a dot word."""
    prefix = t.prefix_hash(low)

    def among(s, e, words):
        hit = np.zeros(len(s), bool)
        short = np.flatnonzero(e - s <= _longest_word)
        hit[short] = np.isin(t.hashes(prefix, s[short], e[short]), _hashes_of(words))
        return hit

    s, e, doc = t.spans_of(~_separators[low], offsets)
    digit = among(s, e, tuple(DIGIT_WORDS))
    run = digit.copy()
    for k in range(1, MIN_SPELLED):
        n = max(0, len(run) - k)
        run[:n] &= digit[k:] & (doc[k:] == doc[:n])
        run[n:] = False
    out = np.zeros(len(offsets) - 1, bool)
    out[doc[run]] = True
    s, e, doc = t.spans_of(~_brackets[low], offsets)
    at = np.flatnonzero(among(s, e, tuple(DIGIT_WORDS)))
    dot = among(s, e, _dot_words)
    before, after = np.maximum(at - 1, 0), np.minimum(at + 1, len(s) - 1)
    beside = (doc[before] == doc[at]) & (_digits[low[e[before] - 1]] | dot[before]) | (doc[after] == doc[at]) & (_digits[low[s[after]]] | dot[after])
    for k in (1, 2, 3):
        beside |= (s[at] - k >= offsets[doc[at]]) & (low[np.maximum(s[at] - k, 0)] == 43)
    out[doc[at[beside]]] = True
    return out


def scan(block) -> list[tuple[str, list, list]]:
    """Text, base spans and disguised spans of each document of a block."""
    low = block.lower().data
    sums = np.zeros(len(low) + 1, np.int64)
    np.cumsum(_leads[low], out=sums[1:])
    foreign = sums[block.offsets[1:]] > sums[block.offsets[:-1]]
    foreign |= spells_digits(low, block.offsets)
    out = []
    for i in range(len(block)):
        text = block.text(i)
        base = find_base(text)
        raw = low[block.offsets[i] : block.offsets[i + 1]].tobytes()
        hinted = foreign[i] or any(w in raw for w in _hint_words) and _hints.search(raw) or _at_hint.search(raw)
        out.append((text, base, find_hidden(text, base) if hinted else []))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base_spans and spans, arrays of (kind, start, end) in code points, end exclusive."""
    span = "array<struct<kind string, start long, end long>>"

    def run(block, rows):
        both = scan(block)
        rec = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(b)] for _, b, _ in both]
        every = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(b + d)] for _, b, d in both]
        return [rows.column(0), rec, every]

    return map_blocks(docs, text_col, [id_col], f"doc_id {docs.schema[id_col].dataType.simpleString()}, base_spans {span}, spans {span}", run)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping ones are joined and take the kind of the longest."""
    joined: list[list[int]] = []
    for s, k, e in sorted(spans):
        if joined and s < joined[-1][1]:
            last = joined[-1]
            last[1] = max(last[1], e)
            if e - s > last[3]:
                last[2:] = k, e - s
        else:
            joined.append([s, e, k, e - s])
    out, at = [], 0
    for s, e, k, _ in joined:
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with personal data in the text masked. A null text stays null."""
    i = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    others = [c for c in plain.columns if c != f"c{i}"]
    schema = ", ".join([*(f"{c} {plain.schema[c].dataType.simpleString()}" for c in others), f"c{i} string"])

    def run(block, rows):
        was = rows.column(rows.num_columns - 1).is_null().to_pylist()
        return [*(rows.column(k) for k in range(rows.num_columns - 1)), [None if null else masked(x, b + d) for null, (x, b, d) in zip(was, scan(block), strict=True)]]

    return map_blocks(plain, f"c{i}", others, schema, run).select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def _only(kind: str):
    return lambda k: F.when(k == kind, k)


def contract(docs: DataFrame) -> DataFrame:
    """The spans of find_pii as counts, a digest of the base spans and one string."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform("spans", lambda s: s["kind"])
    counted = [F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("long").alias(f"n_{k}") for k in KINDS]
    return find_pii(docs).select("doc_id", *counted, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))

