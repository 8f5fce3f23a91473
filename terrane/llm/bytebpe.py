"""Byte-level BPE ids of whole texts through the tokenizers library, with a cache of chunks.

A text is cut where the tokenizer's own pattern always cuts (before a space or white space run that
leads a word), so a chunk's ids do not depend on its neighbours. Chunks seen before come from a
cache of bounded size; new ones of a block are encoded together in one call. Where the file's merges
stand in the order of their ids, that call goes to tiktoken with the same vocabulary and pattern,
whose ids are then the same and which is several times faster; otherwise to tokenizers itself.
"""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import compress

import numpy as np
import public_tokenizers
import tiktoken

BYTE_BPE = "byte_bpe_50k.json"
CACHE_ENTRIES = 250_000
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Python counts these as white space and the tokenizer's pattern does not: such texts are encoded whole.
_differs = re.compile("[\x1c-\x1f]")
_chunks = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall


class ByteBPE:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab()
        self.size = max(vocab.values()) + 1
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[i for t, i in vocab.items() if t[0] == "Ġ"]] = True
        self.line = vocab["Ċ"]
        self.cache: dict[str, bytes] = {}
        self.fast = self._ranked(json.loads(self.model.to_str()))

    def _ranked(self, spec: dict):
        """A tiktoken encoding with the same ids, or None where the file is not of that kind."""
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if spec["normalizer"] or order != list(range(order[0], order[0] + len(order))) or spec["pre_tokenizer"] != BYTE_LEVEL:
            return None
        visible = {**{c: c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
        byte = {chr(v): k for k, v in (visible | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in visible)}).items()}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.added}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> np.ndarray:
        if self.fast:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks: those that lead with a space in one call, those without in another, white space one by one."""
        out = {c: self.whole(c) for c in new if c.isspace()}
        led = [c for c in new if c[0] == " " and c not in out]
        bare = [c for c in new if c[0] != " " and c not in out]
        for chunks, text in ((led, "".join(led)), (bare, "".join(f"\n{c}" for c in bare))):
            if not chunks:
                continue
            ids = self.plain(text)
            cut = np.flatnonzero(self.spaced[ids] if chunks is led else ids == self.line)
            if len(cut) != len(chunks):
                out |= {c: self.whole(c) for c in chunks}
                continue
            ends = np.append(cut[1:], len(ids))
            starts = cut if chunks is led else cut + 1
            raw = ids.tobytes()
            out |= {c: raw[4 * s : 4 * e] for c, s, e in zip(chunks, starts.tolist(), ends.tolist(), strict=True)}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        odd = {i for i, x in enumerate(texts) if _differs.search(x) or any(a in x for a in self.added)}
        cut = [[] if i in odd else _chunks(x) for i, x in enumerate(texts)]
        got = [list(map(self.cache.get, c)) for c in cut]
        missing = {c for chunks, ids in zip(cut, got, strict=True) if None in ids for c in compress(chunks, [x is None for x in ids])}
        if missing:
            learned = self._learn(list(missing))
            for k, (chunks, ids) in enumerate(zip(cut, got, strict=True)):
                if None in ids:
                    got[k] = [learned[c] if x is None else x for c, x in zip(chunks, ids, strict=True)]
            if len(self.cache) < CACHE_ENTRIES:
                self.cache |= learned
        return [self.whole(x) if i in odd else b"".join(ids) for i, (x, ids) in enumerate(zip(texts, got, strict=True))]


@functools.lru_cache(2)
def byte_bpe(path: str | None = None) -> ByteBPE:
    """One encoder for each worker process and file."""
    return ByteBPE(path or public_tokenizers.path(BYTE_BPE))
