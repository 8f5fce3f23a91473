"""Intermediate tables in the folder that spark.checkpoint.dir names: lineage is cut, lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is configured in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and current.isDefined():
        named = current.get()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='spark-')}")).rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of files that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows written to the shared folder and read back."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str = "step") -> DataFrame:
    """`stored` rows that joins don't broadcast: their size in files, by which Spark decides, says little about rows that were made from them."""
    return stored(df, name).hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to as many tasks as a shuffle has: a small file is read by one task, however much work its rows are."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
