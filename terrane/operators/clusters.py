"""Clustering many groups at once: farthest-point seeds, grouped k-means, size control, the strategic map.

Centres are a table keyed by group; a round is one job, whatever the number of groups, and no group
is gathered in a task, but for parts of a bounded number of members. What a group needs in a round is one row with at most its number of centres.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cluster_target
from ..storage import stored

#: A strategic region above BIG km2 is cut into parts of about PART km2, MOST_PARTS at most (fixed values).
BIG, PART, MOST_PARTS = 320_000.0, 200_000.0, 16

#: Clusters that a part is put into at once, members that a task cuts up alone, and strips at once.
MOST_AT_ONCE, ONE_TASK, STRIPS = 64, 1 << 16, 64


def _d2(x, y, c: Column) -> Column:
    return (F.col(x) - c["x"]) * (F.col(x) - c["x"]) + (F.col(y) - c["y"]) * (F.col(y) - c["y"])


def farthest_seeds(points: DataFrame, wanted: DataFrame, first: Column, then: Column | None = None) -> DataFrame:
    """(grp, cluster, id, x, y): in each group the point least by `first`, then as many as wanted(grp, k) says, each farthest from those before.

    points has grp, id, x, y. Of equally far points the least by `then` (the id, if not given) is taken;
    seeds end where every point of a group is one. Points keep their least distance, so a round looks at one new seed.
    """
    then = F.col("id") if then is None else then
    pick = lambda order: F.min(F.struct(order.alias("o"), F.struct("id", "x", "y").alias("p")))["p"].alias("p")
    now = points.select("grp", "id", "x", "y", first.alias("first"), then.alias("then")).join(wanted.select("grp", "k").where("k > 0"), "grp")
    seed = stored(now.groupBy("grp").agg(pick(F.col("first"))), "seeds")
    found = seed.select("grp", F.lit(0).alias("cluster"), "p.id", "p.x", "p.y")
    most = wanted.agg(F.max("k")).first()[0] or 0
    now = now.withColumn("d2", F.lit(float("inf")))
    for n in range(1, most):
        now = stored(now.where(F.col("k") > n).join(seed, "grp").withColumn("d2", F.least("d2", _d2("x", "y", F.col("p")))).drop("p").where("d2 > 0"), "seeding")
        seed = stored(now.groupBy("grp").agg(pick(F.struct((-F.col("d2")).alias("d"), "then"))), "seeds")
        if seed.isEmpty():
            break
        found = found.unionByName(seed.select("grp", F.lit(n).alias("cluster"), "p.id", "p.x", "p.y"))
    return found


def grouped_kmeans(points: DataFrame, wanted: DataFrame, rounds: int = 12, first: Column | None = None) -> DataFrame:
    """(grp, id, cluster): k-means in each group of points(grp, id, x, y, w) with wanted(grp, k) clusters.

    Seeds are the heaviest point, or the least by `first`, and those farthest from the ones before;
    centres are weighted means, an empty cluster keeps its centre. Ties go to the smaller cluster.
    """
    first = F.struct((-F.col("w")).alias("w"), "id") if first is None else first
    source = stored(points.select("grp", "id", "x", "y", "w"), "points")
    seeds = farthest_seeds(source, wanted, first).select("grp", "cluster", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(True).alias("moved"))
    centres = stored(seeds, "centres")

    def assigned():
        held = centres.groupBy("grp").agg(F.collect_list(F.struct("cluster", "x", "y")).alias("centres"))  # k of each group
        near = F.array_min(F.transform("centres", lambda c: F.struct(_d2("x", "y", c).alias("d2"), c["cluster"].alias("cluster"))))
        return source.join(held, "grp").withColumn("cluster", near["cluster"]).drop("centres")

    for _ in range(rounds):
        sums = assigned().groupBy("grp", "cluster").agg(*((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"new_{c}") for c in ("x", "y")))
        next_ = centres.join(sums, ["grp", "cluster"], "left").select("grp", "cluster", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("x", "y")), F.coalesce((F.col("new_x") != F.col("x")) | (F.col("new_y") != F.col("y")), F.lit(False)).alias("moved"))
        centres = stored(next_, "centres")
        if centres.where("moved").isEmpty():
            break
    return assigned().select("grp", "id", "cluster")


def size_controlled(members: DataFrame, caps: DataFrame, depth: int = 5, rounds: int = 14, most: int = MOST_AT_ONCE, one_task: int = ONE_TASK) -> DataFrame:
    """(grp, id, part): groups of members(grp, id, x, y, size) cut until no part is over its group's cap (caps: grp, cap).

    The parts over the cap are the work list of a round: each is clustered into ceil(total / (0.75 cap))
    parts, at least two, no more than it has members. A part of one member, or cut more than `depth` times
    after the first, stays as it is.

    Seeds are found one after another, so a part for more than `most` clusters is first cut into strips across its longer
    axis, which does not count as a cut of `depth`. A part of at most `one_task` members is then cut to its end in a task; a
    larger one, of few clusters, is clustered by all tasks and its parts go on.
    """
    every = members.join(caps, "grp").select("grp", "id", "x", "y", F.col("size").cast("double").alias("size"), "cap", F.col("grp").cast("string").alias("part"), F.lit(0).alias("cuts"))
    open_, done = stored(every, "parts"), None
    while True:
        span = lambda c: (F.max(c) - F.min(c)).cast("double")
        sizes = open_.groupBy("part").agg(F.sum("size").alias("total"), F.count("*").alias("n"), F.max("cap").alias("cap"), F.max("cuts").alias("cuts"), span("x").alias("across"), span("y").alias("down"))
        over = sizes.where((F.col("total") > F.col("cap")) & (F.col("n") > 1) & (F.col("cuts") <= depth) & (F.greatest("across", "down") > 0))
        k = F.least("n", F.greatest(F.lit(2), F.ceil(F.col("total") / (F.col("cap") * 0.75)))).cast("long")
        way = F.when(F.col("k") > most, "strips").when(F.col("n") <= one_task, "task").otherwise("rounds")
        work = stored(over.withColumn("k", k).select("part", "k", "across", "down", way.alias("way")), "work")
        settled = open_.join(work, "part", "left_anti").select("grp", "id", "part")
        done = settled if done is None else done.unionByName(settled)
        ways = {r["way"] for r in work.select("way").distinct().collect()}  # three at most
        if not ways:
            return done
        rest, later = open_.join(work, "part"), []
        if "task" in ways:
            kinds = [open_.schema[c].dataType.simpleString() for c in ("grp", "id")]
            ended = rest.where("way = 'task'").select("grp", "id", "x", "y", "size", "cap", "part", "cuts").groupBy("part").applyInPandas(_cut_up(depth, rounds), f"grp {kinds[0]}, id {kinds[1]}, part string")
            done = done.unionByName(stored(ended, "ended"))
        if "strips" in ways:
            later.append(_strips(rest.where("way = 'strips'"), most).select(*open_.columns))
        if "rounds" in ways:
            long = work.where("way = 'rounds'").select(F.col("part").alias("grp"), F.col("k").cast("int").alias("k"))
            cut = grouped_kmeans(rest.where("way = 'rounds'").select(F.col("part").alias("grp"), "id", "x", "y", F.lit(1.0).alias("w")), long, rounds, F.struct("id"))
            cut = cut.select(F.col("grp").alias("part"), "id", "cluster")
            later.append(rest.join(cut, ["part", "id"]).withColumns({"part": F.concat_ws(".", "part", F.col("cluster").cast("string")), "cuts": F.col("cuts") + 1}).select(*open_.columns))
        open_ = stored(later[0] if len(later) == 1 else later[0].unionByName(later[1]), "parts") if later else open_.limit(0)


def _strips(rest: DataFrame, most: int) -> DataFrame:
    """Parts (part, x, y, k, across, down) cut across their longer axis at shares of their members; one cut is halfway, so a part never stays whole."""
    wide = F.col("across") >= F.col("down")
    longer, shorter = F.greatest("across", "down"), F.least("across", "down")
    along = rest.withColumn("at", F.when(wide, F.col("x")).otherwise(F.col("y")).cast("double"))
    shares = [i / STRIPS for i in range(1, STRIPS)]
    found = along.groupBy("part").agg(F.percentile_approx("at", shares, 1000).alias("shares"), ((F.min("at") + F.max("at")) / 2).alias("half"))
    pieces = F.col("k") / most  # so many strips that these are about square
    strips = F.least(F.lit(STRIPS), F.ceil(pieces), F.greatest(F.lit(2), F.ceil(F.sqrt(pieces * F.coalesce(longer / F.nullif(shorter, F.lit(0.0)), pieces)))))
    step = F.greatest(F.lit(1), F.floor(F.lit(STRIPS) / strips)).cast("int")
    cuts = F.array_union(F.filter("shares", lambda v, i: (i + 1) % F.col("step") == 0), F.array("half"))
    dealt = along.withColumn("step", step).join(found, "part").withColumn("strip", F.size(F.filter(cuts, lambda v: v < F.col("at"))))
    return dealt.withColumn("part", F.concat_ws("~", "part", F.col("strip").cast("string")))


def _cut_up(depth: int, rounds: int):
    """For applyInPandas over one part: its members with the parts that `size_controlled` ends with."""

    def clusters(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        """Numbers of clusters of members in order of id, seeds the first and those furthest from the ones before."""
        d2, seeds = np.full(len(x), np.inf), [0]
        while len(seeds) < k:
            d2 = np.minimum(d2, (x - x[seeds[-1]]) ** 2 + (y - y[seeds[-1]]) ** 2)
            far = int(d2.argmax())
            if d2[far] <= 0:
                break
            seeds.append(far)
        cx, cy = x[seeds], y[seeds]
        for _ in range(rounds):
            at = nearest(x, y, cx, cy)
            n = np.bincount(at, minlength=len(cx))
            nx, ny = (np.where(n > 0, np.bincount(at, v, len(cx)) / np.maximum(n, 1), c) for v, c in ((x, cx), (y, cy)))
            if (nx == cx).all() and (ny == cy).all():
                break
            cx, cy = nx, ny
        return nearest(x, y, cx, cy)

    def nearest(x, y, cx, cy):
        out = np.zeros(len(x), dtype=np.int64)
        for i in range(0, len(x), 1 << 14):
            px, py = x[i : i + (1 << 14), None], y[i : i + (1 << 14), None]
            out[i : i + (1 << 14)] = ((px - cx) ** 2 + (py - cy) ** 2).argmin(axis=1)
        return out

    def cut_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        x, y, size = (pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in ("x", "y", "size"))
        cap, names = float(pdf["cap"].max()), np.empty(len(pdf), dtype=object)
        todo = [(np.arange(len(pdf)), pdf["part"].iloc[0], int(pdf["cuts"].max()))]
        while todo:
            own, name, cuts = todo.pop()
            total = np.nansum(size[own])
            if total <= cap or len(own) < 2 or cuts > depth:
                names[own] = name
                continue
            at = clusters(x[own], y[own], min(len(own), max(2, math.ceil(total / (cap * 0.75)))))
            todo += [(own[at == j], f"{name}.{j}", cuts + 1) for j in np.unique(at)]
        return pd.DataFrame({"grp": pdf["grp"], "id": pdf["id"], "part": names})

    return cut_up


def strategic(cells: DataFrame, units: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells (id, unit, x, y, area) and units (unit, country, name, x, y, area) as strategic regions.

    A country has a number of regions that follows its area. If it has hardly more units than that, each
    is a region of its own (of a single unit the region is the country); otherwise units are clustered by
    area-weighted k-means, and a region bears the name of its largest unit. A region above 320,000 km2 is
    cut into parts of about 200,000 km2 along its cells. Returns (id, region) of the cells and the regions
    (region, country, name, units), where parts of a region share its row's name. `most`, if given, is the largest
    number of clusters that units of a country are put into.
    """
    per = units.groupBy("country").agg(F.count("*").alias("n"), F.sum("area").alias("total")).withColumn("target", cluster_target("total"))
    per = per.withColumn("kept", (F.col("n") <= 1) | (F.col("n") <= 1.25 * F.col("target")))
    known = stored(units.join(per, "country"), "units")
    many = known.where("not kept").select(F.col("country").alias("grp"), F.col("unit").alias("id"), "x", "y", F.greatest(F.lit(1.0), F.col("area")).alias("w"))
    found = grouped_kmeans(many, per.where("not kept").select(F.col("country").alias("grp"), F.least("target", F.col("n").cast("int"), *([F.lit(most)] if most else [])).alias("k")))
    whole = known.join(found.select(F.col("id").alias("unit"), "cluster"), "unit", "left")
    whole = stored(whole.withColumn("region", F.concat_ws("/", F.col("country"), F.coalesce(F.col("cluster").cast("string"), F.col("unit").cast("string")))), "regions")
    order = F.struct((-F.col("area")).alias("a"), "unit")
    regions = whole.groupBy("region").agg(F.min_by(F.struct("name", "n", "country"), order).alias("m"), F.sum("area").alias("area"), F.count("*").alias("units"))
    regions = stored(regions.select("region", "m.country", F.when(F.col("m.n") <= 1, F.col("m.country")).otherwise(F.col("m.name")).alias("name"), "area", "units"), "named")
    placed = stored(cells.join(whole.select("unit", "region"), "unit").select("id", "x", "y", F.col("area").cast("double").alias("w"), "region"), "placed")
    big = regions.where(F.col("area") > BIG).select(F.col("region").alias("grp"), F.least(F.lit(MOST_PARTS), F.greatest(F.lit(2), F.floor(F.col("area") / PART + 0.5))).cast("int").alias("k"))
    parts = grouped_kmeans(placed.withColumnRenamed("region", "grp").join(big.select("grp"), "grp", "left_semi"), big)
    out = placed.join(parts.select("id", "cluster"), "id", "left").select("id", F.col("region").alias("whole"), F.concat_ws("#", "region", F.col("cluster").cast("string")).alias("region"))
    return out, regions
