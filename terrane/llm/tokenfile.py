"""Token ids in files of bit-packed blocks, written in order of document id.

A block holds the ids of consecutive documents at the fewest bits that the vocabulary needs, least
significant bit first, and the offset of each document in it, so a document is unpacked from its own
bytes with numpy. Each file (a range of document ids) is a Parquet table of blocks in order; part
numbers the files, first_id counts the ids of the file before the block. Parquet's own statistics on
first_doc and last_doc find the block of a document.

Null and empty texts are their end id alone. Rows with a null id come first, in text order; repeated
rows are kept; an empty table gives no blocks; other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import textops as t
from .bytebpe import byte_bpe
from .spaces import shared_dir

BLOCK_IDS = 1 << 18
#: Bytes of text for each file, at most on the average.
FILE_BYTES = 128 << 20
END_ID = 0


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids at a fixed width, least significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count, from the bytes that hold them."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, start * width // 8).astype(np.uint32)
    first, end = start * width // 8, -(-(start + count) * width // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, end - first, first), bitorder="little")[start * width - 8 * first :][: count * width]
    return (bits.reshape(count, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1).astype(np.uint32)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encodes the documents and writes them under path, in ascending order of id."""
    id_kind = docs.schema[id_col].dataType.simpleString()
    kind = StructType.fromDDL(f"part int, block int, first_id long, n_ids long, first_doc {id_kind}, last_doc {id_kind}, width int, doc_ids array<{id_kind}>, offsets array<int>, payload binary")

    def run(batches):
        schema, bpe, part = to_arrow_schema(kind), byte_bpe(tokenizer), TaskContext.get().partitionId()
        width, end = bits_for(bpe.size), np.array([end_id], np.uint32).tobytes()
        block, done, ids, held, size = 0, 0, [], [], 0

        def flush():
            nonlocal block, done, ids, held, size
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in held])])
            payload = pack_bits(np.frombuffer(b"".join(held), np.uint32), width)
            values = [part, block, done, size, ids[0], ids[-1], width, ids, offsets, payload]
            row = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
            block, done, ids, held, size = block + 1, done + size, [], [], 0
            return row

        for batch in batches:
            for b in t.blocks(batch.column(1)):
                got = bpe.encode([b.text(i) for i in range(len(b))])
                for i, x in zip(batch.column(0).slice(b.first, len(b)).to_pylist(), got, strict=True):
                    ids.append(i)
                    held.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= block_ids:
                        yield flush()
        if ids:
            yield flush()

    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES)
    ordered = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, kind).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    stored = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    id_kind = stored.schema["doc_ids"].dataType.elementType.simpleString()
    kind = StructType.fromDDL(f"part int, doc_id {id_kind}, at long, n_tokens long, ids_crc32 long")

    def run(batches):
        schema = to_arrow_schema(kind)
        for batch in batches:
            for row in batch.to_pylist():
                offsets = np.array(row["offsets"], np.int64)
                ids = unpack_bits(row["payload"], row["width"], 0, int(offsets[-1])).tobytes()
                crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                cols = [np.full(len(crc), row["part"]), row["doc_ids"], offsets[:-1] + row["first_id"], np.diff(offsets), crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    docs = stored.select("part", "first_id", "width", "doc_ids", "offsets", "payload").mapInArrow(run, kind)
    return docs.join(totals, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_id) -> list[list[int]]:
    """Ids of one document (of each row with that id): only blocks whose range holds it are read."""
    rows = spark.read.parquet(path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).select("width", "doc_ids", "offsets", "payload")
    return [unpack_bits(r["payload"], r["width"], r["offsets"][k], r["offsets"][k + 1] - r["offsets"][k]).tolist() for r in rows.toLocalIterator() for k, d in enumerate(r["doc_ids"]) if d == doc_id]


def contract(docs: DataFrame) -> DataFrame:
    path = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write(docs, path)
    return read(docs.sparkSession, path)
