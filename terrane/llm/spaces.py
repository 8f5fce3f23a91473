"""Where intermediate tables go (the folder that the session's spark.checkpoint.dir names), and how blocks are mapped."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .textops import Block, blocks

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A temporary one is set only where none is configured in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and current.isDefined():
        named = current.get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='spark-')}")
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_blocks(df: DataFrame, text: str, keep: list[str], schema: str, fn: Callable[[Block, pa.RecordBatch], list]) -> DataFrame:
    """mapInArrow over blocks of texts. fn gets a block and its rows (`keep` in order) and returns the columns of `schema`."""
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for batch in batches:
            for block in blocks(batch.column(batch.num_columns - 1)):
                got = fn(block, batch.slice(block.first, len(block)))
                if got is not None:
                    cols = [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(got, out, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, schema=out)
        pa.default_memory_pool().release_unused()  # workers live on

    return df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text].alias("text")).mapInArrow(run, kind)


def extend(df: DataFrame, text: str, schema: str, fn: Callable[[Block, pa.RecordBatch], list], last: list[str] | None = None) -> DataFrame:
    """The rows with all their columns and those of `schema`, which fn makes from a block and its rows.

    The columns named in `last` are the last ones of the rows that fn gets, as doubles. Names that clash are kept.
    """
    last = last or []
    n = len(df.columns)
    plain = df.toDF(*(f"c{k}" for k in range(n)))
    given = [plain[f"c{df.columns.index(c)}"].cast("double").alias(f"l{k}") for k, c in enumerate(last)]
    added = StructType.fromDDL(schema)
    kind = StructType([*plain.schema.fields, *added.fields])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        new = to_arrow_schema(added)
        for batch in batches:
            for block in blocks(batch.column(at)):
                rows = batch.slice(block.first, len(block))
                got = fn(block, rows)
                yield pa.RecordBatch.from_arrays([*rows.columns[:n], *(pa.array(x, f.type) for x, f in zip(got, new, strict=True))], schema=out)
        pa.default_memory_pool().release_unused()

    done = plain.select("*", *given).mapInArrow(run, kind)
    return done.toDF(*df.columns, *added.names)
