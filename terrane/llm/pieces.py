"""SentencePiece encoding that keeps source offsets, and decoding.

Normalisation is done here: the longest prefix in the model's compiled character map is replaced at
each place, and every normalised byte keeps the source byte it comes from. The normalised text goes to
the library with its own normalisation switched off. Piece lengths then give the normalised span of
each piece, and the alignment its source span.

Null and empty texts have no pieces. A null id stays null; rows are encoded one by one, repeated or
not; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from .spaces import map_blocks

PIECES = "piece_bpe_32k.model"
MARK = "▁"


class CharMap:
    """The compiled character map: a double-array trie whose values point at replacement texts."""

    def __init__(self, blob: bytes):
        n = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + n], np.uint32).tolist()
        self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at a place, and its replacement."""
        units, found, node = self.units, None, 0
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)  # noqa: E731  the trie's own packing
        node = offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Pieces:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        self.map, self.dummy, self.squeeze, self.escape = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.own = [p.piece.encode() for p in proto.pieces if p.type == 4]
        self.plain = not spec.precompiled_charsmap and not self.squeeze and self.escape and not self.own
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.length = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), -1)
        self.decimal = [str(i) for i in range(len(self.length))]

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte it starts from."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.plain:
            out = (MARK if self.dummy else "") + text.replace(" ", MARK)
            raw = np.frombuffer(data, np.uint8)
            source = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
            return out, np.concatenate([np.zeros(3 * self.dummy, np.int64), source, [len(raw)]])
        steps, at = [], 0
        while at < len(data):
            own = max((p for p in self.own if data.startswith(p, at)), key=len, default=None)
            got = (len(own), own) if own else self.map.longest(data, at)
            if got is None:
                k = 1
                while at + k < len(data) and data[at + k] & 0xC0 == 0x80:
                    k += 1
                got = k, data[at : at + k]
            steps.append((at, got[1]))
            at += got[0]
        space, mark = b" ", MARK.encode() if self.escape else b" "
        if self.squeeze:
            while steps and steps[0][1] == space:
                steps.pop(0)
        if not steps:
            return "", np.zeros(1, np.int64)
        out, source, blank = [], [], self.squeeze
        if self.dummy and not self.suffix:
            out, source = [mark], [steps[0][0]] * len(mark)
        for at, new in steps:
            if blank:
                new = new.lstrip(space)
            blank = self.squeeze and (new.endswith(space) if new else blank)
            new = new.replace(space, mark)
            out.append(new)
            source += [at] * len(new)
        joined = b"".join(out)
        end = len(data)
        if self.squeeze:
            while joined.endswith(mark) and joined:
                joined = joined[: -len(mark)]
                end = source[len(joined)]
        if self.dummy and self.suffix:
            joined, source = joined + mark, source[: len(joined)] + [end] * len(mark)
        return joined.decode(), np.array([*source[: len(joined)], end], np.int64)

    def _sizes(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Length in normalised bytes of each piece."""
        if self.unknown in ids:  # an unknown piece is as long as what it stands for
            return np.array([len(text[p.begin : p.end].encode()) for p in self.raw.encode(text, out_type="immutable_proto").pieces], np.int64)
        return self.length[ids]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: ids, and source start and end of each piece in bytes."""
        normal = [self.normalise(x) for x in texts]
        out = []
        for (text, source), found in zip(normal, self.raw.encode([x for x, _ in normal], num_threads=1), strict=True):
            ids = np.array(found, np.int32)
            at = source[np.concatenate([[0], np.cumsum(self._sizes(text, ids))])]
            out.append((ids, at[:-1], at[1:]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())

    def listed(self, ids: np.ndarray) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def pieces(path: str | None = None) -> Pieces:
    """One encoder for each worker process and file."""
    return Pieces(path or public_tokenizers.path(PIECES))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per document: ids, and the source byte span of each piece (starts, ends)."""

    def run(block, rows):
        got = pieces(model).encode([block.text(i) for i in range(len(block))])
        return [rows.column(0), *([g[k] for g in got] for k in range(3))]

    return map_blocks(docs, text_col, [id_col], f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, starts array<long>, ends array<long>", run)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Encodes and decodes each document and returns checksums of its ids, decoded text and piece spans."""

    def run(block, rows):
        m = pieces(model)
        got = m.encode([block.text(i) for i in range(len(block))])
        sha = [hashlib.sha256(m.listed(g[0]).encode()).hexdigest() for g in got]
        back = [hashlib.sha256(m.decode(g[0]).encode()).hexdigest() for g in got]
        spans = [zlib.crc32(np.concatenate([g[1], g[2]]).astype("<i8").tobytes()) for g in got]
        return [rows.column(0), [len(g[0]) for g in got], sha, back, spans]

    return map_blocks(docs, text_col, [id_col], f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long", run)
