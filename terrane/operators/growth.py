"""Iterative operators on graphs: multi-source growth, components, merging of small pieces, k-means.

Each is a loop of joins; the state of a round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import kept


def grow(seeds: DataFrame, edges: DataFrame, costs: DataFrame | None = None, hops: int = 4, max_rounds: int = 100_000) -> DataFrame:
    """(id, seed, dist): cheapest path from any seed over edges(a, b, w), ties to the smaller seed.

    seeds has id and seed; costs(id, cost), if given, is added on entering a node. Only nodes that got
    better in a round pass it on, over `hops` edges before the next round compares with what is known.
    """
    e = edges.select("a", "b", "w") if costs is None else edges.select("a", "b").join(costs, F.col("b") == F.col("id")).select("a", "b", F.col("cost").alias("w"))
    best = kept(seeds.groupBy("id").agg(F.min("seed").alias("seed")).select("id", "seed", F.lit(0.0).alias("dist")), "grow")
    front = best
    for _ in range(max_rounds):
        ahead, every = front, None
        for _ in range(hops):
            ahead = ahead.join(e, F.col("id") == F.col("a")).select(F.col("b").alias("id"), "seed", (F.col("dist") + F.col("w")).alias("dist"))
            ahead = ahead.groupBy("id").agg(F.min(F.struct("dist", "seed")).alias("o")).select("id", "o.seed", "o.dist")
            every = ahead if every is None else every.unionByName(ahead)
        offers = every.groupBy("id").agg(F.min(F.struct("dist", "seed")).alias("offer"))
        old = best.select("id", F.struct("dist", "seed").alias("old"))
        better = offers.join(old, "id", "left").where("old is null or offer < old").select("id", "offer.seed", "offer.dist")
        front = kept(better, "front")
        if front.isEmpty():
            return best
        best = kept(best.join(front, "id", "left_anti").unionByName(front), "grow")
    raise RuntimeError(f"growth did not end in {max_rounds} rounds")


def _settle(key: tuple, states: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Cheapest paths inside one tile: from what is known and what is offered to what got better."""
    ahead = defaultdict(list)
    for a, b, w in zip(edges["a"].tolist(), edges["b"].tolist(), edges["w"].tolist(), strict=True):
        ahead[a].append((b, w))
    best: dict = {}
    heap = []
    for i, d, s, offered in zip(states["id"].tolist(), states["dist"].tolist(), states["seed"].tolist(), states["offered"].tolist(), strict=True):
        if offered:
            heap.append((d, s, i))
        else:
            best[i] = d, s
    heapq.heapify(heap)
    better = {}
    while heap:
        d, s, i = heapq.heappop(heap)
        if i in best and best[i] <= (d, s):
            continue
        best[i] = better[i] = d, s
        for b, w in ahead[i]:
            if b not in best or (d + w, s) < best[b]:
                heapq.heappush(heap, (d + w, s, b))
    return pd.DataFrame([(key[0], i, s, d) for i, (d, s) in better.items()], columns=["tile", "id", "seed", "dist"])


def grow_tiled(seeds: DataFrame, edges: DataFrame, tiles: DataFrame, costs: DataFrame | None = None, max_rounds: int = 100_000) -> DataFrame:
    """The same as `grow` for nodes dealt to tiles(id, tile) of bounded size.

    Each round settles the tiles that got offers, every one in a task, and only offers over edges
    between tiles are exchanged: there are as many rounds as tiles along a path, not nodes.
    """
    e = edges.select("a", "b", "w") if costs is None else edges.select("a", "b").join(costs, F.col("b") == F.col("id")).select("a", "b", F.col("cost").alias("w"))
    side = lambda c: tiles.select(F.col("id").alias(c), F.col("tile").alias(f"t{c}"))
    e = kept(e.join(side("a"), "a").join(side("b"), "b"), "edges")
    local, cut = e.where("ta = tb").select(F.col("ta").alias("tile"), "a", "b", F.col("w").cast("double").alias("w")), e.where("ta <> tb")
    offers = kept(seeds.groupBy("id").agg(F.min("seed").cast("long").alias("seed")).select("id", "seed", F.lit(0.0).alias("dist")).join(tiles, "id"), "offers")
    best = offers.limit(0).select("tile", "id", "seed", "dist")
    schema = f"tile {tiles.schema['tile'].dataType.simpleString()}, id {tiles.schema['id'].dataType.simpleString()}, seed long, dist double"
    for _ in range(max_rounds):
        touched = offers.select("tile").distinct()
        known = best.join(touched, "tile", "left_semi").withColumn("offered", F.lit(False))
        states = known.unionByName(offers.select("tile", "id", "seed", "dist").withColumn("offered", F.lit(True)))
        inner = local.join(touched, "tile", "left_semi")
        better = kept(states.groupBy("tile").cogroup(inner.groupBy("tile")).applyInPandas(_settle, schema), "better")
        best = kept(best.join(better, "id", "left_anti").unionByName(better), "grow")
        out = better.join(cut, F.col("id") == F.col("a")).select(F.col("b").alias("id"), "seed", (F.col("dist") + F.col("w")).alias("dist"), F.col("tb").alias("tile"))
        out = out.groupBy("id", "tile").agg(F.min(F.struct("dist", "seed")).alias("o")).select("id", "tile", "o.seed", "o.dist")
        old = best.select("id", F.struct("dist", "seed").alias("old"))
        offers = kept(out.join(old, "id", "left").where("old is null or struct(dist, seed) < old").drop("old"), "offers")
        if offers.isEmpty():
            return best.select("id", "seed", "dist")
    raise RuntimeError(f"growth did not end in {max_rounds} rounds")


def grow_inside(cells: DataFrame, owner: DataFrame, parts: DataFrame, edges: DataFrame, costs: DataFrame | None = None, least: int = 22) -> DataFrame:
    """(id, region, part): each region of owner(id, region) dealt to as many parts as parts(region, k) says, numbered from 0.

    cells has id, r, c; edges(a, b) both ways. The first seed is the first cell (by row, then column) of the
    region's largest connected piece, the next ones are furthest from those before, for all regions at
    once; parts grow from them over the costs inside the region. Other pieces go whole to the seed nearest to their
    middle. Parts of fewer than `least` cells are given up cell by cell, from their rims inwards, to the neighbours above,
    below, to the left or to the right, in that order, as long as the region has others.
    """
    from .clusters import farthest_seeds

    placed = kept(owner.select("id", "region").join(cells.select("id", "r", "c"), "id"), "placed")
    own = lambda c: placed.select(F.col("id").alias(c), F.col("region").alias(f"r{c}"))
    inner = kept(edges.select("a", "b").join(own("a"), "a").join(own("b"), "b").where("ra = rb").select("a", "b"), "inner")
    pieces = kept(components(placed, inner).join(placed, "id"), "pieces")
    sizes = pieces.groupBy("region", "component").agg(F.count("*").alias("n"), F.avg("r").alias("mr"), F.avg("c").alias("mc"))
    main = kept(sizes.groupBy("region").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component")), "main")
    inside = pieces.join(main, ["region", "component"]).select(F.col("region").alias("grp"), "id", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    seeds = kept(farthest_seeds(inside, parts.select(F.col("region").alias("grp"), "k"), F.struct("y", "x"), F.struct((-F.col("y")).alias("y"), (-F.col("x")).alias("x"))), "seeds")
    weights = inner.withColumn("w", F.lit(1.0)) if costs is None else inner
    grown = grow_tiled(seeds.select("id", F.col("cluster").cast("long").alias("seed")), weights, square_tiles(cells), costs).select("id", F.col("seed").alias("part"))
    apart = sizes.join(main, ["region", "component"], "left_anti").join(seeds.select(F.col("grp").alias("region"), "cluster", "x", "y"), "region")
    d2 = (F.col("x") - F.col("mc")) * (F.col("x") - F.col("mc")) + (F.col("y") - F.col("mr")) * (F.col("y") - F.col("mr"))
    near = apart.groupBy("region", "component").agg(F.min(F.struct(d2.alias("d2"), "cluster"))["cluster"].cast("long").alias("near"))  # k seeds for each piece
    dealt = pieces.join(grown, "id", "left").join(near, ["region", "component"], "left").select("id", "region", "r", "c", F.coalesce("part", "near").alias("part"))
    sized = dealt.groupBy("region", "part").agg(F.count("*").alias("n"))
    sized = sized.join(sized.groupBy("region").agg(F.count("*").alias("parts")), "region")
    tiny = sized.where((F.col("n") < least) & (F.col("parts") > 1)).select("region", "part", F.lit(True).alias("tiny"))
    now = kept(dealt.join(tiny, ["region", "part"], "left").withColumn("tiny", F.coalesce("tiny", F.lit(False))), "dealt")
    while True:
        rim = now.where("tiny").select("id", "region", F.posexplode(F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))))).alias("k", "p"))
        beside = now.where("not tiny").select("region", "r", "c", F.col("part").alias("to"))
        moves = rim.select("id", "region", "k", "p.r", "p.c").join(beside, ["region", "r", "c"]).groupBy("id").agg(F.min_by("to", "k").alias("to"))
        moves = kept(moves, "moves")
        if moves.isEmpty():
            return now.select("id", "region", "part")
        now = kept(now.join(moves, "id", "left").select("id", "region", "r", "c", F.coalesce("to", "part").alias("part"), (F.col("tiny") & F.col("to").isNull()).alias("tiny")), "dealt")


def square_tiles(cells: DataFrame, side: int = 128) -> DataFrame:
    """(id, tile) of cells (id, r, c): squares of side x side cells."""
    return cells.select("id", F.concat_ws(":", F.floor(F.col("r") / side).cast("string"), F.floor(F.col("c") / side).cast("string")).alias("tile"))


#: Links that a task joins at once, and so many as a single task may join at the end.
AT_ONCE, ONE_TASK = 1 << 20, 1 << 18


def _stars(links: np.ndarray) -> np.ndarray:
    """Links (u, v) as stars: every node but the smallest of its component, with that one."""
    nodes, at = np.unique(links, return_inverse=True)
    at, root = at.reshape(links.shape), np.arange(len(nodes))
    while True:
        ends = root[at]
        apart = ends[:, 0] != ends[:, 1]
        if not apart.any():
            return np.column_stack([nodes, nodes[root]])[root != np.arange(len(nodes))]
        at, ends = at[apart], ends[apart]
        np.minimum.at(root, ends.max(axis=1), ends.min(axis=1))
        while (root[root] != root).any():
            root = root[root]


def _joined(batches):
    """The links of a partition as stars, AT_ONCE of them at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        n += batch.num_rows
        if n >= AT_ONCE:
            held = [_stars(np.concatenate(held))]
            yield pa.RecordBatch.from_arrays([pa.array(held[0][:, 0]), pa.array(held[0][:, 1])], names=["u", "v"])
            held, n = [], 0
    if n:
        left = _stars(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(left[:, 0]), pa.array(left[:, 1])], names=["u", "v"])


def components(nodes: DataFrame, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): the smallest id that each node reaches over edges (a, b) between nodes, which are whole numbers.

    Tasks join the links that they hold; between tasks each node keeps its smallest link, other ends of its links
    go to that one, and both follow that one's smallest link. A node has at most one link from each task, so the component
    that holds most nodes is no hot key. Once no more than `one_task` links are left a single task joins them. Edges with a null
    end join nothing.
    """
    kind = nodes.schema["id"].dataType
    links = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v and a is not null and b is not null")
    links, mark = kept(links.mapInArrow(_joined, "u long, v long"), "links"), None
    while True:
        n, total = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n <= one_task:
            links = kept(links.coalesce(1).mapInArrow(_joined, "u long, v long"), "links")
            break
        if (n, total) == mark:
            break
        mark = n, total
        least = kept(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        further = least.select(F.col("u").alias("v"), F.col("m").alias("further"))
        step = least.select("u", F.col("m").alias("v")).unionByName(moved).join(further, "v", "left").select("u", F.coalesce("further", "v").alias("v"))
        links = kept(step.where("u <> v").distinct().mapInArrow(_joined, "u long, v long").distinct(), "links")
    found = links.select(F.col("u").cast(kind).alias("id"), F.col("v").cast(kind).alias("component"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def merge_small(pieces: DataFrame, borders: DataFrame, least: float, rounds: int = 3, same: str | None = None) -> DataFrame:
    """(id, root, size): pieces smaller than `least` join the neighbour with the longest border, in at most so many rounds.

    pieces has id and size, borders a, b and length (both in ids). In a round every small piece joins
    one neighbour; chains collapse to their smallest id. `same` names a column that must agree.
    """
    extra = [same] if same else []
    root = kept(pieces.select("id", F.col("id").alias("root"), "size", *extra), "merge")
    for _ in range(rounds):
        sizes = root.groupBy("root").agg(F.sum("size").alias("size"), *(F.min(c).alias(c) for c in extra))
        r = root.select("id", "root")
        line = borders.join(r.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(r.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        line = line.groupBy(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")).agg(F.sum("length").alias("length"))
        both = line.select("x", "y", "length").union(line.select("y", "x", "length"))
        small = sizes.where(F.col("size") < least)
        target = sizes.select(F.col("root").alias("y"), F.col("size").alias("size_y"), *(F.col(c).alias(f"{c}_y") for c in extra))
        moves = both.join(small, F.col("x") == F.col("root")).join(target, "y")
        if same:
            moves = moves.where(F.col(same).eqNullSafe(F.col(f"{same}_y")))
        moves = kept(moves.groupBy("x").agg(F.max_by("y", F.struct("length", "size_y", -F.col("y"))).alias("y")), "moves")
        if moves.isEmpty():
            break
        joined = components(moves.select(F.col("x").alias("id")).union(moves.select("y")).distinct(), moves.select(F.col("x").alias("a"), F.col("y").alias("b")))
        root = kept(root.join(joined.select(F.col("id").alias("root"), "component"), "root", "left").select("id", F.coalesce("component", "root").alias("root"), "size", *extra), "merge")
    total = root.groupBy("root").agg(F.sum("size").alias("total"))
    return root.join(total, "root").select("id", "root", F.col("total").alias("size"))


def kmeans(points: DataFrame, k: int, rounds: int = 12, weight: str | None = None) -> DataFrame:
    """(id, cluster, d2): k-means from farthest-point seeds; points has id and v, an array of doubles.

    The k centres travel with each round's tasks; each is the (weighted) mean of its points, from one sum a
    task. Ties go to the smaller cluster, and of equally far seeds to the smaller id. Points without a vector, or with a
    null in it, take no part and come back without a cluster.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    every = kept(points.select("id", F.col("v").cast("array<double>").alias("v"), w.cast("double").alias("w")), "points")
    usable = F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.coalesce(F.exists("v", lambda x: x.isNull()), F.lit(False))
    source, apart = every.where(usable), every.where(~usable).select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("d2"))
    first = source.orderBy("id").first() if k else None
    if first is None:
        return every.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("d2")).where(usable).unionByName(apart)
    centres = [first["v"]]
    while len(centres) < k:
        far = to_centres(source, centres).orderBy(F.desc("d2"), "id").first()
        if far["d2"] <= 0:
            break
        centres.append(far["v"])
    for _ in range(rounds):
        each = source.select("v", "w").mapInArrow(_cluster_sums(centres), "cluster int, w double, s array<double>")
        sums = each.groupBy("cluster").agg(F.sum("w").alias("w"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(len(centres[0])))).collect()  # k rows
        new = list(centres)
        for row in sums:
            new[row["cluster"]] = [row[f"s{i}"] / row["w"] for i in range(len(centres[0]))]
        if all(max(abs(x - y) for x, y in zip(a, b, strict=True)) < 1e-9 for a, b in zip(new, centres, strict=True)):
            break
        centres = new
    return to_centres(source, centres).select("id", "cluster", "d2").unionByName(apart)


def _nearest(vectors: pa.Array, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a batch, their nearest centres (the first of equally near ones) and the squared distances."""
    v = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    d2 = np.stack([((v - c) ** 2).sum(axis=1) for c in centres], axis=1)
    at = d2.argmin(axis=1)
    return v, at, d2[np.arange(len(v)), at]


def _cluster_sums(centres: list[list[float]]):
    """For mapInArrow over (v, w): the weights and weighted sums of each cluster, a row for each that a task meets."""
    fixed = np.array(centres)

    def sums(batches):
        weights, total = np.zeros(len(fixed)), np.zeros(fixed.shape)
        for batch in batches:
            if batch.num_rows:
                v, at, _ = _nearest(batch.column(0), fixed)
                w = batch.column(1).to_numpy()
                weights += np.bincount(at, w, len(fixed))
                for c in np.unique(at):
                    total[c] += w[at == c] @ v[at == c]
        met = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(weights[met]), pa.array(list(total[met]), pa.list_(pa.float64()))], names=["cluster", "w", "s"])

    return sums


def to_centres(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """The points with the squared distance (d2) and the number of the nearest of a few centres (cluster); each has a vector v of their length."""
    fixed = np.array(centres, dtype=float)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                _, at, d2 = _nearest(batch.column("v"), fixed)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d2), pa.array(at, pa.int32())], names=[*batch.schema.names, "d2", "cluster"])

    schema = T.StructType([*points.schema.fields, T.StructField("d2", T.DoubleType()), T.StructField("cluster", T.IntegerType())])
    return points.mapInArrow(placed, schema)


def part_count(cells, per_part: int = 540, most_cells: int = 4200, most: int = 24):
    """Into how many provinces a group of cells is split."""
    c = F.col(cells)
    return F.least(F.lit(most), F.greatest(F.lit(1), F.bround(c / per_part), F.ceil(c / most_cells))).cast("int")


def placeholder_parts(n, most: int = 26, target: int = 15):
    return F.when(F.col(n) > most, F.ceil(F.col(n) / target)).otherwise(1).cast("int")


def should_split(candidates: DataFrame) -> DataFrame:
    """(id, split) for atlas regions from candidates(id, area, coverage, piece): by size, number of pieces and the largest one."""
    a, usable = F.col("area"), F.col("piece") >= F.greatest(F.lit(1800.0), F.col("area") * 0.018)
    stats = candidates.groupBy("id").agg(F.first("area").alias("area"), F.first("coverage").alias("coverage"), F.sum(usable.cast("int")).alias("n"), (F.max(F.when(usable, F.col("piece"))) / F.first("area")).alias("largest"))
    tiers = ((450_000, 2, 0.94), (150_000, 2, 0.88), (70_000, 3, 0.82), (35_000, 4, 0.72))
    rule = F.lit(False)
    for least, n, share in tiers:
        rule = rule | ((a > least) & (F.col("n") >= n) & (F.col("largest") < share))
    return stats.select("id", F.coalesce((a >= 18_000) & (F.col("coverage") >= 0.72) & (F.col("n") >= 2) & rule, F.lit(False)).alias("split"))
