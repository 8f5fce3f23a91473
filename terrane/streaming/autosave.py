"""Autosave: a stream of edits kept as the newest row of each key in files, the same after any restart.

Rows are dealt to buckets by their key. A batch writes the buckets that it touches as a version of its own, then one commit row
for each; a bucket's rows are those of its last committed version. A batch that is run again after a failure starts from the versions
before it and writes the same files, so each edit counts once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeline import replay
from ..storage import removed


def _latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """(bucket, version) committed last, of versions before one if given; None where nothing is committed."""
    try:
        commits = spark.read.schema("bucket int, version long").parquet(f"{path}/commits")
    except AnalysisException:  # no folder yet
        return None
    return (commits if before is None else commits.where(F.col("version") < before)).groupBy("bucket").agg(F.max("version").alias("version"))


def saved(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The saved rows with their bucket; None where nothing has been saved."""
    latest = _latest(spark, path, before)
    if latest is None:
        return None
    rows = spark.read.parquet(f"{path}/rows").withColumn("version", F.col("version").cast("long")).withColumn("bucket", F.col("bucket").cast("int"))
    return rows.join(latest, ["bucket", "version"]).drop("version")


def save(batch: DataFrame, number: int, path: str, key: str, order: list[str], buckets: int = 64) -> None:
    """Puts a batch of edits over what was saved before it; of one key the last in order stays. An empty batch changes nothing."""
    spark = batch.sparkSession
    edits = replay(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
    try:
        touched = edits.select("bucket").distinct()
        if edits.isEmpty():
            return
        old = saved(spark, path, number)
        every = edits if old is None else edits.unionByName(old.join(touched, "bucket", "left_semi"))
        replay(every, key, order).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={number}")
        touched.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/commits/batch={number}")
    finally:
        edits.unpersist()


def autosave(log: DataFrame, path: str, checkpoint: str, key: str, order: list[str], buckets: int = 64):
    """Saves what there is now of a stream of edits, then stops; started again with the same checkpoint it goes on where it was."""
    return log.writeStream.foreachBatch(lambda batch, number: save(batch, number, path, key, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tidied(spark: SparkSession, path: str) -> int:
    """Deletes the versions of which no bucket is current, now or before the last batch (which may be run again); returns how many. Not while a stream saves."""
    latest = _latest(spark, path)
    if latest is None:
        return 0
    last = latest.agg(F.max("version")).first()[0]
    needed = latest.unionByName(_latest(spark, path, last)).select("version").distinct()
    every = spark.read.parquet(f"{path}/commits").select("version").distinct()
    old = [r.version for r in every.join(needed, "version", "left_anti").collect()]  # one number a batch
    for version in old:
        removed(spark, f"{path}/rows/version={version}")
    return len(old)
