"""Merged region grid: atlas regions split by state regions where that pays, slivers merged, regions renumbered, a report.

Regions are given on a common grid of atoms: atoms(id, x, y, size, area, atlas, state), squares of side
`size` at (x, y), with the atlas region and the state region (or null) each lies in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import unit_square
from ..functions.scalars import split_name
from ..operators import edges as ed
from ..operators import growth
from ..operators.ordered import numbered, one_row
from ..storage import kept

#: Least piece of a split, absolutely (km2) and as a share of the atlas region; least sliver; most regions (fixed values).
MIN_PIECE, MIN_SHARE, SLIVER, MOST_REGIONS, REMAINDER = 1800.0, 0.01, 1800.0, 3000, 30_000.0


def candidates(atoms: DataFrame) -> DataFrame:
    """(atlas, state, piece, area, coverage) for each part of an atlas region in a state region."""
    whole = atoms.groupBy("atlas").agg(F.sum("area").alias("area"), F.sum(F.when(F.col("state").isNotNull(), F.col("area")).otherwise(0.0)).alias("covered"))
    parts = atoms.groupBy("atlas", "state").agg(F.sum("area").alias("piece"))
    return parts.join(whole, "atlas").withColumn("coverage", F.col("covered") / F.col("area")).drop("covered")


def pieces(atoms: DataFrame) -> DataFrame:
    """Atoms with their piece: of a split region its state part (remainders too), else the whole region."""
    c = candidates(atoms)
    split = growth.should_split(c.where("state is not null").select(F.col("atlas").alias("id"), "area", "coverage", "piece")).select(F.col("id").alias("atlas"), "split")
    marked = atoms.join(split, "atlas", "left")
    key = F.when(F.coalesce("split", F.lit(False)), F.concat_ws("/", F.col("atlas").cast("string"), F.coalesce(F.col("state").cast("string"), F.lit("rest")))).otherwise(F.col("atlas").cast("string"))
    return marked.withColumn("piece", key).withColumn("split", F.coalesce("split", F.lit(False)))


def _borders(atoms: DataFrame, unit: str) -> DataFrame:
    """(a, b, length) between units that touch."""
    square = unit_square("x", "y")
    table = ed.edges(atoms.withColumn("ring", square), [unit])
    return ed.shared_lengths(table, unit)


def _between(borders: DataFrame, owner: DataFrame) -> DataFrame:
    """(a, b, length) between regions, from the borders of the pieces that owner(piece_id, region) puts together."""
    side = lambda c: owner.select(F.col("piece_id").alias(c), F.col("region").alias(f"r{c}"))
    both = borders.join(side("a"), "a").join(side("b"), "b").where("ra <> rb")
    return both.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.sum("length").alias("length"))


def merged(atoms: DataFrame, sliver: float = SLIVER, rounds: int = 3, most: int = MOST_REGIONS) -> DataFrame:
    """Atoms with their region: small pieces join a neighbour of their atlas region, then slivers any neighbour, then the cap holds.

    Rounds read pieces and the borders between them; atoms are read for these once, and once for the result.
    """
    p = kept(pieces(atoms), "pieces")
    ids = kept(numbered(p.select("piece").distinct(), ["piece"], "piece_id"), "ids")
    p = kept(p.join(ids, "piece"), "pieces")
    whole = kept(p.groupBy("piece_id").agg(F.sum("area").alias("area"), F.min("atlas").alias("atlas")), "sizes")
    borders = kept(_borders(p, "piece_id"), "borders")
    local = growth.merge_small(whole.select(F.col("piece_id").alias("id"), F.col("area").alias("size"), "atlas"), borders, MIN_PIECE, 1, same="atlas")
    owner, before = kept(_regrouped(whole, local, "piece_id"), "local"), -1
    while True:  # each round but the last leaves fewer regions
        sizes = owner.groupBy("region").agg(F.sum("area").alias("size"))
        n = sizes.count()
        least = sliver if n <= most else sizes.approxQuantile("size", [1 - most / n], 0.001)[0] + 1e-9
        again = growth.merge_small(sizes.select(F.col("region").alias("id"), "size"), kept(_between(borders, owner), "borders"), least, rounds)
        owner = kept(_regrouped(owner.withColumnRenamed("region", "was"), again, "was"), "global")
        left = owner.select("region").distinct().count()
        if left <= most:
            return kept(p.join(owner.select("piece_id", "region"), "piece_id").select("id", "x", "y", "size", "area", "atlas", "state", "split", "piece", "region"), "merged")
        if left == before:
            raise ValueError(f"{left} regions without a neighbour to join: more than {most}")
        before = left


def _regrouped(units: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    return units.join(roots.select(F.col("id").alias(key), F.col("root").alias("region")), key).select("piece_id", "area", "region")


def regions(merged_atoms: DataFrame, names: DataFrame) -> DataFrame:
    """One row per region, numbered from 1 in order of atlas region and state; names(kind, key, name) hold both sorts of names."""
    main = merged_atoms.groupBy("region", "atlas", "state", "split").agg(F.sum("area").alias("part"))
    best = main.groupBy("region").agg(F.max_by(F.struct("atlas", "state", "split"), F.struct("part", -F.col("atlas"))).alias("m"), F.sum("part").alias("area_km2"))
    best = best.select("region", "m.atlas", "m.state", "m.split", "area_km2")
    name = lambda kind: names.where(F.col("kind") == kind).select(F.col("key").alias(kind), F.col("name").alias(f"{kind}_name"))
    named = best.join(name("atlas"), "atlas", "left").join(name("state"), "state", "left")
    label = split_name("atlas_name", "state_name", F.when(F.col("split"), 2).otherwise(1))
    out = numbered(named.withColumn("name", label).withColumn("order", F.coalesce("state", F.lit(-1))), ["atlas", "order", "region"], "n")
    preference = F.when(~F.col("split"), "atlas").when(F.col("state").isNull(), "generated").otherwise("merged")
    return out.select((F.col("n") + 1).alias("id"), "region", "name", F.col("atlas").alias("source_atlas"), F.when(F.col("split"), F.col("state")).alias("source_state"), preference.alias("source_preference"), F.round("area_km2", 3).alias("area_km2"))


def report(atoms: DataFrame, merged_atoms: DataFrame, final: DataFrame) -> DataFrame:
    """One row of counters of the build."""
    d = F.countDistinct
    return one_row(
        atoms.agg(d("atlas").alias("atlas_regions"), d("state").alias("state_regions")),
        merged_atoms.agg(d(F.when(F.col("split"), F.col("atlas"))).alias("split_regions"), d("piece").alias("pieces")),
        final.agg(F.count("*").alias("final_regions"), F.count_if(F.col("source_preference") == "generated").alias("generated")),
    )
