"""Yearly snapshots and the edit log."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def add_year(snapshots: DataFrame, year: int, current: DataFrame) -> DataFrame:
    """Stores the current rows under a year, in place of what was there."""
    return delete_year(snapshots, year).unionByName(current.withColumn("year", F.lit(year)), allowMissingColumns=True)


def at_year(snapshots: DataFrame, year: int) -> DataFrame:
    """Rows of exactly that year; there is no earlier year to fall back on."""
    return snapshots.where(F.col("year") == year)


def delete_year(snapshots: DataFrame, year: int) -> DataFrame:
    return snapshots.where(F.col("year") != year)


def years(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


def write_years(snapshots: DataFrame, path: str) -> None:
    """A folder for each year; a later write replaces only the years that it holds."""
    snapshots.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def replay(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """State after all edits: the last one of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.struct(*order)).alias("e")).select("e.*")


def undo_stack(log: DataFrame, key: str, order: list[str], size: int = 60) -> DataFrame:
    """The newest edits of each key, at most `size`, depth 1 the newest."""
    newest = [F.desc(c) for c in order]
    return log.withColumn("depth", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).where(F.col("depth") <= size)


def histories(log: DataFrame, key: str, order: list[str], command: str, value: str, size: int = 60) -> DataFrame:
    """(key, value, n_undo, n_redo) after all commands of each key: "edit" sets the value, "undo" and "redo" step through its history.

    An edit ends what could be redone; undo reaches `size` edits back; a step with nowhere to go does nothing, other
    commands are passed over. A key without edits has a null value. A key's commands stream through a task in order, which holds
    no more of them than `size`, so a key with very many needs no memory for them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    schema = f"{key} {kinds[key]}, {value} {kinds[value]}, n_undo long, n_redo long"
    rows = log.select(key, F.col(command).alias("command"), F.col(value).alias("value"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)))
    dealt = rows.repartition(key).sortWithinPartitions(key, *(f"o{k}" for k in range(len(order))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now, undo, redo, begun, out = None, None, deque(maxlen=size), [], False, []
        for batch in batches:
            for k, what, new in zip(batch[key].tolist(), batch["command"].tolist(), batch["value"].tolist(), strict=True):
                if not begun or k != at:
                    if begun:
                        out.append((at, now, len(undo), len(redo)))
                    at, now, undo, redo, begun = k, None, deque(maxlen=size), [], True
                if what == "edit":
                    undo.append(now)
                    redo.clear()
                    now = new
                elif what == "undo" and undo:
                    redo.append(now)
                    now = undo.pop()
                elif what == "redo" and redo:
                    undo.append(now)
                    now = redo.pop()
            yield pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate((key, value, "n_undo", "n_redo"))})
            out = []
        if begun:
            yield pd.DataFrame({c: pd.Series([x], dtype=object) for c, x in zip((key, value, "n_undo", "n_redo"), (at, now, len(undo), len(redo)), strict=True)})

    return dealt.where(F.col(key).isNotNull()).mapInPandas(run, schema)


def strokes(log: DataFrame, key: str, order: str, pause: float) -> DataFrame:
    """Edits grouped to strokes: a pause of more than so many seconds begins a new one."""
    w = Window.partitionBy(key).orderBy(order, "event_id")
    at = F.unix_micros(F.col(order).cast("timestamp")) / 1e6
    gap = at - F.lag(at).over(w)
    return log.withColumn("cut", F.coalesce((gap > pause).cast("int"), F.lit(0))).withColumn("stroke", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")


def as_of(asked: DataFrame, facts: DataFrame, key: str, time: str) -> DataFrame:
    """The asked rows with `fact`, the last row of `facts` (a struct without the key) of their key that is not later; null where there is none.

    Both are dealt to ranges of (key, time) and read forwards once; what a range begins without is carried from the ranges
    before it, so a key of any number of rows needs no single task. Of several facts of one key and time the greatest counts.
    """
    spark = asked.sparkSession
    rest = [c for c in facts.columns if c != key]
    last = facts.groupBy(key, time).agg(F.max(F.struct(time, *(c for c in rest if c != time))).alias("_fact"))
    both = last.select(key, time, F.lit(0).alias("_kind"), "_fact", F.lit(None).cast(asked.schema).alias("_row"))
    both = both.unionByName(asked.select(key, time, F.lit(1).alias("_kind"), F.lit(None).cast(last.schema["_fact"].dataType).alias("_fact"), F.struct(*asked.columns).alias("_row")))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(both.repartitionByRange(parts, key, time, "_kind").withColumn("_part", F.spark_partition_id()), "facts")
    inside = Window.partitionBy("_part", key).orderBy(time, "_kind")
    carried = dealt.groupBy("_part", key).agg(F.max("_fact").alias("_end"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    carried = carried.select("_part", F.col(key).alias("_key"), F.max("_end").over(before).alias("_carried"))
    local = dealt.withColumn("_seen", F.last("_fact", ignorenulls=True).over(inside)).where("_kind = 1")
    joined = local.join(carried, (local["_part"] == carried["_part"]) & local[key].eqNullSafe(F.col("_key")))
    return joined.select("_row.*", F.coalesce("_seen", "_carried").alias("fact"))
