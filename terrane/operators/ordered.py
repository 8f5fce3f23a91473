"""Computations that carry state along an order: suffixes, unwrapping, segments, runs, percentiles, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Row numbers from 0 in a total order, without sorting all rows in one task: range partitions are numbered and offset."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    from ..storage import kept

    dealt = kept(dealt, "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))  # one row for each partition
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("local", local).join(F.broadcast(offsets), "part").withColumn(name, F.col("base") + F.col("local")).drop("part", "local", "base")


def octant_suffix(rows: DataFrame, group: str, octant: str, order: list[str], name: str) -> DataFrame:
    """The largest of a group (first in order) keeps the name; others get their octant, and a counter from the second on."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = rows.withColumn("place", place)
    inside = F.row_number().over(Window.partitionBy(group, F.col("place") == 1, octant).orderBy(*order))
    ranked = ranked.withColumn("again", inside)
    suffix = F.when(F.col("again") > 1, F.concat(F.lit(" "), F.col("again").cast("string"))).otherwise(F.lit(""))
    label = F.when(F.col("place") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" "), F.col(octant), suffix))
    return ranked.withColumn("label", label).drop("place", "again")


def dedup_names(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Later rows of a name get (2), (3), ... ."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn("k", k).withColumn("unique_name", F.when(F.col("k") > 1, F.concat(F.col(name), F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col(name))).drop("k")


def unwrap(rows: DataFrame, keys: list[str], order: list[str], x: str, width: float = 360) -> DataFrame:
    """Coordinates along a line made continuous: each jump of over half the width adds or takes a turn from there on."""
    w = Window.partitionBy(*keys).orderBy(*order)
    jump = F.col(x) - F.lag(x).over(w)
    turn = F.when(jump > width / 2, -1).when(jump < -width / 2, 1).otherwise(0)
    out = rows.withColumn("turn", turn)
    return out.withColumn("unwrapped", F.col(x) + width * F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("turn")


def segments(rows: DataFrame, keys: list[str], order: list[str], gap: Column, name: str = "segment") -> DataFrame:
    """Numbers segments from 0: a new one begins where gap (over the ordered rows) is true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("cut", F.coalesce(gap.cast("int"), F.lit(0)))
    return out.withColumn(name, F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")


def jump(x: str, keys: list[str], order: list[str], limit: float) -> Column:
    """Whether x moves by more than the limit from the row before."""
    return F.abs(F.col(x) - F.lag(x).over(Window.partitionBy(*keys).orderBy(*order))) > limit


def runs(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Runs (row, first, last, value) of equal values in consecutive columns."""
    island = F.col(column) - F.row_number().over(Window.partitionBy(row, value).orderBy(column))
    return cells.withColumn("island", island).groupBy(row, value, "island").agg(F.min(column).alias("first"), F.max(column).alias("last")).drop("island")


def indexed_percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minimum, elements at n//10, n//2 and 9n//10 of the sorted values, and maximum. Rows without a value do not count.

    Equal values are counted and dealt to ranges of (key, value); counts run inside a range and are carried
    from one to the next, so a key of any number of values needs no single task.
    """
    from ..storage import stored

    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("times"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(counted.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id()), "values")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    per = dealt.groupBy("_part", *keys).agg(F.sum("times").alias("_n"))
    per = per.select(F.col("_part").alias("_of"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(*keys)).alias("n"))
    upto = F.sum("times").over(Window.partitionBy("_part", *keys).orderBy(value))
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = dealt.withColumn("_upto", upto).join(per, same).select(*keys, value, (F.col("_upto") + F.col("_base")).alias("upto"), "n")
    n = F.col("n")
    at = lambda e: F.min(F.when(F.col("upto") > e, F.col(value)))
    return ranked.groupBy(*keys).agg(F.min(value).alias("low"), at(F.floor(n / 10)).alias("p10"), at(F.floor(n / 2)).alias("median"), at(F.floor(9 * n / 10)).alias("p90"), F.max(value).alias("high"), F.max("n").alias("n"))


def first_rows(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n).drop("rn")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def seeds(*lists: DataFrame) -> DataFrame:
    """Seed lists in order of precedence: names trimmed, one row for each name whatever its case, latitudes in -60..85."""
    every = None
    for k, one in enumerate(lists):
        part = one.withColumn("name", F.trim("name")).withColumn("list", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    every = every.withColumn("name_key", F.lower("name"))
    return first_rows(every, ["name_key"], ["list", "ord"]).where("lat between -60 and 85").drop("name_key")


def one_row(*parts: DataFrame) -> DataFrame:
    """The columns of tables of one row each, in one row."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    return every.agg(*(F.max(c).alias(c) for c in every.columns))


def base_name(name: Column) -> Column:
    """The name in lower case, without what follows its first " (": the key under which variants of a name meet."""
    return F.lower(F.substring_index(name, " (", 1))


def validated(regions: DataFrame, reference: DataFrame) -> DataFrame:
    """(name, d): how far each region (name, x, y) lies from the reference place of its base name; regions without one are left out.

    Of reference places (ord, name, x, y) of one name, whatever its case, the first one counts.
    """
    first = reference.groupBy(F.lower("name").alias("key")).agg(F.min_by(F.struct("x", "y"), "ord").alias("at"))
    return regions.withColumn("key", base_name(F.col("name"))).join(first, "key").select("name", F.hypot(F.col("x") - F.col("at.x"), F.col("y") - F.col("at.y")).alias("d"))


def worst(residuals: DataFrame, n: int = 5) -> DataFrame:
    """The n largest residuals, ties by name."""
    return residuals.orderBy(F.desc("d"), "name").limit(n)
