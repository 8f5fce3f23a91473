"""Rasters as tables of cells (r, c, v): masks, morphology, gap filling, noise, runs, regions of equal value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import inside_polygon
from ..storage import kept
from .growth import components, grow_tiled, square_tiles
from .ordered import runs


def grid(spark, height: int, width: int) -> DataFrame:
    return spark.range(height * width).select((F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))


def rasterise(cells: DataFrame, polygons: DataFrame, geometry: str = "polygon") -> DataFrame:
    """Value of the last polygon (in order of ord) that holds each cell's centre; rows of cells meet only polygons whose bounds span them."""
    x, y = F.col("c") + 0.5, F.col("r") + 0.5
    ring = F.col(geometry)[0]
    ys = F.transform(ring, lambda p: p["y"])
    rows = polygons.withColumn("r", F.explode(F.sequence(F.floor(F.array_min(ys)).cast("int"), F.ceil(F.array_max(ys)).cast("int"))))
    hits = cells.join(rows, "r").where(inside_polygon(x, y, geometry))
    return cells.join(hits.groupBy("r", "c").agg(F.max_by("v", "ord").alias("v")), ["r", "c"], "left")


def line_cells(lines: DataFrame, line: str = "line", width: int = 1) -> DataFrame:
    """The rows with each cell (r, c) that their line (array of struct<x,y>) passes, a cell once for each segment that passes it.

    Ends are cut to whole cells; a segment steps along its longer axis and rounds the other, halves away from its start. Wider lines take
    further cells across that axis: of an even width the odd one lies on the side of larger numbers. A line of one point has no cells.
    """
    p = F.col(line)
    ends = F.arrays_zip(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))).alias("s"), F.slice(p, 2, F.size(p)).alias("t"))
    whole = lambda a, b: F.floor(F.col(f"_e.{a}.{b}")).alias(f"_{a}{b}")
    cut = lines.where(F.size(p) > 1).withColumn("_e", F.explode(ends)).select(*lines.columns, *(whole(a, b) for a in "st" for b in "xy"))
    dx, dy = F.col("_tx") - F.col("_sx"), F.col("_ty") - F.col("_sy")
    stepped = cut.withColumn("_n", F.greatest(F.abs(dx), F.abs(dy))).withColumn("_m", F.least(F.abs(dx), F.abs(dy))).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    flat, minor = F.abs(dx) > F.abs(dy), F.expr("(2 * _k * _m + _n) div greatest(2 * _n, 1)")
    across = F.explode(F.sequence(F.lit(-((width - 1) // 2)), F.lit(width // 2)))
    wide = stepped.withColumn("_w", across)
    c = F.col("_sx") + F.signum(dx).cast("long") * F.when(flat, F.col("_k")).otherwise(minor) + F.when(flat, 0).otherwise(F.col("_w"))
    r = F.col("_sy") + F.signum(dy).cast("long") * F.when(flat, minor).otherwise(F.col("_k")) + F.when(flat, F.col("_w")).otherwise(0)
    return wide.select(*lines.columns, r.cast("int").alias("r"), c.cast("int").alias("c"))


def neighbours(cells: DataFrame, diagonal: bool = False) -> DataFrame:
    """Each cell's value at each place that touches it, itself included."""
    steps = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0), *([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])]
    return cells.select(F.explode(F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c"), F.col("v")) for i, j in steps))).alias("s")).select("s.*")


def dilate(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """Cells that a true cell touches become true; cells outside the table are not made."""
    grown = neighbours(mask, diagonal).groupBy("r", "c").agg(F.max("v").alias("v"))
    return mask.select("r", "c").join(grown, ["r", "c"])


def erode(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """Cells that a false cell of the table touches become false."""
    shrunk = neighbours(mask, diagonal).groupBy("r", "c").agg(F.min("v").alias("v"))
    return mask.select("r", "c").join(shrunk, ["r", "c"])


def close(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    return erode(dilate(mask, diagonal), diagonal)


def opened(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    return dilate(erode(mask, diagonal), diagonal)


def cell_edges(cells: DataFrame, diagonal: bool = False) -> DataFrame:
    """Edges (a, b) between touching cells by their id."""
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    ahead = cells.select(F.col("id").alias("a"), *([F.col("v").alias("va")] if "v" in cells.columns else []), F.explode(F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i, j in steps))).alias("s"))
    return ahead.select("a", *([c for c in ahead.columns if c == "va"]), "s.r", "s.c").join(cells.withColumnRenamed("id", "b"), ["r", "c"])


def label_regions(cells: DataFrame, diagonal: bool = False) -> DataFrame:
    """(id, component) of cells (id, r, c, v) that touch and have equal values."""
    return components(cells, cell_edges(cells, diagonal).where("va = v").select("a", "b"))


def fill_gaps(cells: DataFrame) -> DataFrame:
    """Cells (id, r, c, v) without a value get that of the nearest one by steps, ties to the smaller value."""
    e = cell_edges(cells.select("id", "r", "c")).select("a", "b")
    both = e.union(e.select("b", "a")).withColumn("w", F.lit(1.0))
    got = grow_tiled(cells.where("v is not null").select("id", F.col("v").alias("seed")), both, square_tiles(cells))
    return cells.drop("v").join(got.select("id", F.col("seed").cast(cells.schema["v"].dataType).alias("v")), "id", "left")


def fill_nearest(cells: DataFrame) -> DataFrame:
    """Cells (id, r, c, v) without a value get that of the nearest one in a straight line, ties to the smaller value.

    The nearest value above or below comes from windows over columns, one each way, since a frame that ends with the column is read anew for every row; then each open cell looks along its
    row, further in each round, until no column beyond can be nearer. Without any value, none is given.
    """
    low, high = cells.agg(F.min("c"), F.max("c")).first()
    if low is None:
        return cells
    whole = cells.select("r").distinct().withColumn("c", F.explode(F.sequence(F.lit(low), F.lit(high))))
    here = F.when(F.col("v").isNotNull(), F.struct("r", "v"))
    above, below = (F.last(here, ignorenulls=True).over(Window.partitionBy("c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) for order in (F.asc("r"), F.desc("r")))
    step = lambda side, sign: F.when(F.col(side).isNotNull(), F.struct(((F.col("r") - F.col(side)["r"]) * sign).alias("d"), F.col(side)["v"].alias("v")))
    dealt = whole.join(cells.select("r", "c", "v"), ["r", "c"], "left").withColumns({"above": above, "below": below})
    columns = kept(dealt.withColumn("near", F.least(step("above", 1), step("below", -1))).where("near is not null").select("r", F.col("c").alias("at"), "near.d", "near.v"), "columns")
    left, out, reach = kept(cells.where("v is null").select("id", "r", "c"), "gaps"), None, 2
    while True:
        far = reach >= high - low
        look = left.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(low), F.col("c") - reach), F.least(F.lit(high), F.col("c") + reach))))
        met = look.join(columns, ["r", "at"]).groupBy("id").agg(F.min(F.struct(((F.col("c") - F.col("at")) * (F.col("c") - F.col("at")) + F.col("d") * F.col("d")).alias("d2"), "v")).alias("hit"))
        hits = kept(met.where(F.lit(far) | (F.col("hit.d2") <= reach * reach)).select("id", "hit.v"), "hits")
        out = hits if out is None else out.unionByName(hits)
        left = kept(left.join(hits, "id", "left_anti"), "gaps")
        if far or left.isEmpty():
            return cells.join(out.withColumnRenamed("v", "found").hint("merge"), "id", "left").withColumn("v", F.coalesce("v", "found")).drop("found")
        reach *= 4


def noise(cells: DataFrame, octaves: tuple[tuple[int, float], ...] = ((64, 1.0), (32, 0.5), (16, 0.25)), seed: int = 11) -> DataFrame:
    """Value noise in 0..1: lattice values from a hash of whole numbers, bilinear between them, octaves added."""
    total = F.lit(0.0)
    for size, share in octaves:
        fr, fc = F.floor(F.col("r") / size), F.floor(F.col("c") / size)
        tr, tc = F.col("r") / size - fr, F.col("c") / size - fc
        mixed = lambda i, j, fr=fr, fc=fc, size=size: ((fr + i) * 73_856_093).bitwiseXOR((fc + j) * 19_349_663).bitwiseXOR(F.lit(size * 83_492_791 + seed))
        at = lambda i, j, mixed=mixed: F.pmod(mixed(i, j), F.lit(2_147_483_647)) * 48_271 % 2_147_483_647 % 1_000_003 / 1_000_003
        total = total + share * ((at(0, 0) * (1 - tc) + at(0, 1) * tc) * (1 - tr) + (at(1, 0) * (1 - tc) + at(1, 1) * tc) * tr)
    return cells.withColumn("noise", total / sum(s for _, s in octaves))


def entry_cost(cells: DataFrame, base: float = 10, river: float = 110, ranges: float = 26, desert: float = 5, plateau: float = 6) -> DataFrame:
    """Cost of entering a cell from its noise and barriers (flags river, ranges, desert, plateau)."""
    add = lambda flag, v: F.when(F.col(flag), F.lit(v)).otherwise(0.0)
    return cells.withColumn("cost", F.bround(base * (0.5 + F.col("noise"))) + add("river", river) + add("ranges", ranges) + add("desert", desert) + add("plateau", plateau))


def run_polygons(cells: DataFrame) -> DataFrame:
    """Rectangles of runs of equal value, as closed rings: (v, r, first, last, ring)."""
    got = runs(cells, "r", "c", "v")
    x0, x1, y = F.col("first").cast("double"), (F.col("last") + 1).cast("double"), F.col("r").cast("double")
    ring = F.array(*(F.struct(x.alias("x"), v.alias("y")) for x, v in ((x0, y), (x1, y), (x1, y + 1), (x0, y + 1), (x0, y))))
    return got.withColumn("ring", ring)


def jittered_seeds(land: DataFrame, step: int, seed: int = 1234567) -> DataFrame:
    """One seed cell in each square of `step` cells that has land: the one with the smallest hash."""
    h = F.xxhash64("r", "c", F.lit(seed))
    square = [F.floor(F.col("r") / step).alias("sr"), F.floor(F.col("c") / step).alias("sc")]
    return land.groupBy(*square).agg(F.min_by(F.struct("r", "c"), h).alias("p")).select("p.r", "p.c")


def member_counts(cells: DataFrame, region: str, province: str) -> DataFrame:
    """Cells that each province has in each region, with the province's largest region marked."""
    n = cells.groupBy(province, region).agg(F.count("*").alias("n"))
    w = Window.partitionBy(province).orderBy(F.desc("n"), region)
    return n.withColumn("main", F.row_number().over(w) == 1)
