"""Names made distinct: suffixes until a name is free, renames that never take a name in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def candidate(place: Column) -> Column:
    """The name at a place of a row's list: base, base (suffix), base (suffix 2), ...; without a suffix base, base (2), base (3), ... ."""
    plain = F.concat(F.col("base"), F.lit(" ("), (place + 1).cast("string"), F.lit(")"))
    again = F.when(place > 1, F.concat(F.lit(" "), place.cast("string"))).otherwise(F.lit(""))
    return F.when(place == 0, F.col("base")).when(F.col("suffix") == "", plain).otherwise(F.concat(F.col("base"), F.lit(" ("), F.col("suffix"), again, F.lit(")")))


def _placed(state: DataFrame) -> DataFrame:
    """Each row's place in its list: the first that was not refused to it and that no earlier row of the list has.

    Ranks and running maxima go through range partitions and are carried from one to the next, so a list of any length needs no single task.
    """
    parts = max(1, int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(state.repartitionByRange(parts, "base", "suffix", "ord").withColumn("part", F.spark_partition_id()), "lists")
    inside = Window.partitionBy("part", "base", "suffix").orderBy("ord")
    local = dealt.withColumn("local", F.row_number().over(inside) - 1).withColumn("gap", F.col("low") - F.col("local"))
    per = local.groupBy("part", "base", "suffix").agg(F.count("*").alias("n"), F.max("gap").alias("most"))
    before = Window.partitionBy("base", "suffix").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a partition
    per = per.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    per = per.withColumn("carried", F.max(F.col("most") - F.col("first")).over(before)).select("part", "base", "suffix", "first", "carried")
    top = F.max("gap").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.col("first") + F.col("local") + F.greatest(F.col("top") - F.col("first"), F.col("carried"))
    return local.withColumn("top", top).join(per, ["part", "base", "suffix"]).select("ord", "base", "suffix", "low", place.alias("place"))


def free_names(rows: DataFrame, base: str, suffix: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """(order, name): in the order of a unique column each row takes the first name of its list that nothing earlier has and that is not in `taken` (name).

    The same names as from a loop over all rows, found in rounds: rows ask for names, a name goes to the earliest that asks, the others
    ask for the next one, and what was refused once stays refused. A list's rows ask together. There are as many rounds as the longest
    chain of names that other lists, or `taken`, hold one after another. A null base gets a null name and holds nothing; a null or
    empty suffix leaves only the number.
    """
    named = rows.select(F.col(order).alias("ord"), F.col(base).alias("base"), F.coalesce(F.col(suffix), F.lit("")).alias("suffix"))
    state = named.where("base is not null").withColumn("low", F.lit(0).cast("long"))
    used = taken.select("name").where("name is not null").distinct().withColumn("held", F.lit(True)) if taken is not None else None
    while True:
        asked = stored(_placed(state).withColumn("name", candidate(F.col("place"))), "asked")
        best = asked.groupBy("name").agg(F.min("ord").alias("best"))
        answered = asked.join(best, "name")
        answered = answered.join(used, "name", "left") if used is not None else answered.withColumn("held", F.lit(False))
        refused = F.coalesce("held", F.lit(False)) | (F.col("ord") > F.col("best"))
        state = stored(answered.select("ord", "base", "suffix", "name", F.when(refused, F.col("place") + 1).otherwise(F.col("low")).cast("long").alias("low"), refused.alias("refused")), "names")
        if state.where("refused").isEmpty():
            break
        state = state.drop("name", "refused")
    given = state.select(F.col("ord"), "name")
    return given.unionByName(named.where("base is null").select("ord", F.lit(None).cast("string").alias("name"))).withColumnRenamed("ord", order)


def renamed_guarded(rows: DataFrame, name: str, order: str, curated: DataFrame, fixes: DataFrame) -> DataFrame:
    """The rows with `new_name`: that of `curated` (name, new_name) always, that of `fixes` only where it is free.

    It is free if no row has it as its own name and no earlier row, by the unique order, has been given it. Of several entries for a name
    the least counts; entries without a new name change nothing.
    """
    entries = lambda t, c: t.where("new_name is not null").groupBy(F.col("name").alias(name)).agg(F.min("new_name").alias(c))
    asked = rows.join(entries(curated, "curated"), name, "left").join(entries(fixes, "fixed"), name, "left").withColumn("target", F.coalesce("curated", "fixed"))
    first = asked.where("target is not null").groupBy("target").agg(F.min(order).alias("first"))
    held = rows.select(F.col(name).alias("target")).distinct().withColumn("held", F.lit(True))
    free = F.col("held").isNull() & (F.col(order) == F.col("first"))
    out = asked.join(first.join(held, "target", "left"), "target", "left")
    return out.withColumn("new_name", F.when(F.col("curated").isNotNull() | free, F.col("target")).otherwise(F.col(name))).select(*rows.columns, "new_name")
