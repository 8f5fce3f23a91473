"""The registered queries over the given tables, and the DuckDB SQL of each.

Roles of the tables: `part` is a grid of unit squares, 40 in a row; `customer` are owned regions,
`nation` countries, `region` continents; `orders` dated facts of ownership; `lineitem` the bridge from
regions to provinces; `events` the edit log; `supplier` seeds and points; `embeddings` points to cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions import scalars as s
from .operators import edges as ed
from .operators import growth, ordered, ownership, raster, regions, spatial, timeline
from .sources import readers, writers
from .streaming import events as stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader, with its SQL."""

    def add(fn):
        def run(spark, sf_dir):
            return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# roles


def owned(t) -> DataFrame:
    """Customers as ownership rows; customers with a negative balance own nothing."""
    owner = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey"))
    return t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), owner.alias("owner"), F.lit("core").alias("status"), F.col("c_mktsegment").alias("group_id"))


def countries(t) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").alias("country_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"), F.col("n_regionkey").alias("continent"))


def override_groups(t) -> DataFrame:
    """Segments that begin with B or M are live merge groups; M groups have no owner."""
    seg = t("customer").select(F.col("c_mktsegment").alias("group_id")).distinct().where(F.substring("group_id", 1, 1).isin("B", "M"))
    return seg.select("group_id", F.when(F.col("group_id").startswith("B"), F.length("group_id") % 25).alias("owner"), F.lit("core").alias("status"))


def grid(t) -> DataFrame:
    x, y = F.col("p_partkey") % 40, F.floor(F.col("p_partkey") / 40)
    return t("part").select(F.col("p_partkey").alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.col("p_type").alias("unit"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))


def grid_edges(t) -> DataFrame:
    return ed.edges(grid(t).withColumn("ring", g.unit_square("x", "y")), ["id", "unit", "size", "brand"])


def seeds(t) -> DataFrame:
    k = F.col("s_suppkey")
    return t("supplier").select(k.alias("id"), (k * 37 % 360 - 180).cast("double").alias("lon"), (k * 17 % 140 - 60).cast("double").alias("lat"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("country"))


def places(t) -> DataFrame:
    k = F.col("c_custkey")
    return t("customer").select(k.alias("point_id"), (k * 53 % 360 - 180).cast("double").alias("plon"), (k * 29 % 140 - 60).cast("double").alias("plat"))


OWNED = "(SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS owner, c_mktsegment AS group_id FROM customer)"
GRID = "(SELECT p_partkey AS id, p_partkey % 40 AS x, p_partkey // 40 AS y, p_type AS unit, p_size AS size, p_brand AS brand, p_name AS name, p_retailprice AS price FROM part)"
SEEDS = "(SELECT s_suppkey AS id, (s_suppkey*37)%360-180 AS lon, (s_suppkey*17)%140-60 AS lat, s_name AS name, s_nationkey AS country FROM supplier)"
PLACES = "(SELECT c_custkey AS point_id, (c_custkey*53)%360-180 AS plon, (c_custkey*29)%140-60 AS plat FROM customer)"
LINES = f"""(SELECT id, unit, size, brand, ax, ay, bx, "by", fwd FROM (
  SELECT id, unit, size, brand, x AS ax, y AS ay, x+1 AS bx, y AS "by", true AS fwd FROM {GRID} UNION ALL
  SELECT id, unit, size, brand, x, y, x, y+1, false FROM {GRID} UNION ALL
  SELECT id, unit, size, brand, x+1, y, x+1, y+1, true FROM {GRID} UNION ALL
  SELECT id, unit, size, brand, x, y+1, x+1, y+1, false FROM {GRID}))"""

# ownership


@query(f"SELECT n_nationkey AS country_id, n_name AS name, n_nationkey AS ord, count(o.id) AS n FROM nation LEFT JOIN {OWNED} o ON o.owner = n_nationkey GROUP BY ALL")
def country_legend(t):
    return ownership.legend(owned(t), countries(t))


@query(f"SELECT id, name, group_id, (CASE WHEN group_id[1] = 'B' THEN length(group_id) % 25 WHEN group_id[1] = 'M' THEN NULL ELSE owner END)::INTEGER AS owner, 'core' AS status FROM {OWNED}")
def effective_owner(t):
    return ownership.effective(owned(t), override_groups(t))


@query(f"SELECT owner, count(*) AS n FROM {OWNED} WHERE owner IS NOT NULL GROUP BY owner")
def owner_counts(t):
    return ownership.owner_counts(owned(t))


@query(f"SELECT id, name FROM {OWNED} WHERE owner IS NULL")
def unowned_features(t):
    o = owned(t)
    return ownership.unowned(o.select("id", "name"), o)


@query("WITH f AS (SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS owner, c_mktsegment AS country FROM customer), p AS (SELECT owner AS o, country AS c FROM f WHERE id = (SELECT min(id) FROM f WHERE owner IS NULL)) SELECT id, owner, country FROM f, p WHERE owner IS NOT DISTINCT FROM o AND (o IS NOT NULL OR c IS NULL OR country = c)")
def fill_same_owner(t):
    f = owned(t).select("id", "owner", F.col("group_id").alias("country"))
    return ownership.fill_like(f, f.where("owner is null").agg(F.min("id")).first()[0])


@query(f"SELECT id, x::DOUBLE AS x, y::DOUBLE AS y FROM {GRID} WHERE x BETWEEN 3 AND 20 AND y BETWEEN 1 AND 30")
def marquee_select(t):
    return ownership.in_box(grid(t).select("id", "x", "y"), 20, 30, 3, 1)


@query("SELECT kind, id, name FROM (SELECT * FROM (SELECT 'country' AS kind, n_nationkey::VARCHAR AS id, n_name AS name, n_nationkey AS o FROM nation WHERE lower(n_name) LIKE '%an%' ORDER BY o LIMIT 4) UNION ALL SELECT * FROM (SELECT 'feature', p_partkey::VARCHAR, p_name, p_partkey AS o FROM part WHERE lower(p_name) LIKE '%an%' ORDER BY o LIMIT 12)) ORDER BY kind, o LIMIT 12")
def search_topn(t):
    f = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return ownership.search(countries(t), f, " An ")


CLAIMS = "(SELECT l_suppkey AS region_id, p_type AS unit, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos FROM lineitem JOIN part ON p_partkey = l_partkey)"
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def claims(t) -> DataFrame:
    rows = t("lineitem").join(t("part").select("p_partkey", F.col("p_type").alias("unit")), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_suppkey").alias("region_id"), "unit", F.struct(*LINE_ORDER).alias("pos"))


@query(f"SELECT region_id, arg_max(unit, (n, -last)) AS unit, max(n) AS n FROM (SELECT region_id, unit, count(*) AS n, max(pos) AS last FROM {CLAIMS} GROUP BY ALL) GROUP BY region_id")
def plurality_owner(t):
    return ownership.plurality(claims(t), ["region_id"], "unit", "pos")


@query(f"SELECT region_id, arg_max(unit, (n, -first)) AS unit, max(n) AS n FROM (SELECT region_id, unit, count(*) AS n, min(pos) AS first FROM {CLAIMS} GROUP BY ALL) GROUP BY region_id")
def plurality_first_seen(t):
    return ownership.plurality(claims(t), ["region_id"], "unit", "pos", ties="first")


@query("SELECT c_custkey AS id, c_mktsegment AS country, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS rank FROM customer")
def group_by_country(t):
    f = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("country"))
    return ownership.group_by_country(f).select("id", "country", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT unit AS owner, round(sum(w), 4) AS w, round(sum(w*x), 4) AS wx, round(sum(w*y), 4) AS wy, round(sum(w*x*y), 4) AS wxy, sum(size)::BIGINT AS total, arg_max(id, (size, -id)) AS largest FROM (SELECT *, sqrt(greatest(1, size)) AS w FROM {GRID}) GROUP BY unit")
def owner_moments(t):
    m = ownership.owner_moments(grid(t).select("id", "x", "y", F.col("unit").alias("owner"), F.col("size").alias("area")))
    return m.select("owner", *(F.round(c, 4).alias(c) for c in ("w", "wx", "wy", "wxy")), "total", "largest")


@query(f"SELECT unit, min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0, max(x)+1::DOUBLE AS x1, max(y)+1::DOUBLE AS y1 FROM {GRID} GROUP BY unit")
def owner_bbox(t):
    return ownership.bounds(grid(t).select("unit", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 1).alias("x1"), (F.col("y") + 1).alias("y1")), "unit")


@query("SELECT c_nationkey AS key, CASE WHEN count(c_mktsegment) = count(*) AND min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) END AS segment, CASE WHEN min(sign) = max(sign) THEN min(sign) END AS sign FROM (SELECT *, c_acctbal >= 0 AS sign FROM customer) GROUP BY c_nationkey")
def unanimous_attribute(t):
    rows = t("customer").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") >= 0).alias("sign"))
    return ownership.unanimous(rows, ["key"], ["segment", "sign"])


def bridge(t) -> DataFrame:
    return t("lineitem").select(F.col("l_suppkey").alias("region_id"), F.col("l_partkey").alias("id"))


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def region_provinces(t):
    return regions.provinces_of(bridge(t), t("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("region_id")))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size NOT IN (1, 2) AND p_size <> 3 UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_size = 3 UNION ALL SELECT -s_suppkey - 1, s_name FROM supplier")
def overlay_apply(t):
    base = grid(t).select("id", "name", "size")
    changed = base.where("size = 3").select("id", F.upper("name").alias("name"))
    added = t("supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_name").alias("name"))
    return ownership.apply_edits(base.select("id", "name"), base.where("size in (1, 2)"), changed.unionByName(added))


@query("SELECT c_custkey AS id FROM customer WHERE (c_acctbal > 5000) <> (c_nationkey < 10)")
def toggle_selection(t):
    c = t("customer").withColumnRenamed("c_custkey", "id")
    return ownership.toggle(c.where("c_acctbal > 5000"), c.where("c_nationkey < 10"))


@query("SELECT DISTINCT c_custkey AS id FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 100 = 7)")
def group_closure(t):
    members = t("customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("id"))
    return ownership.expand_groups(members.where("id % 100 = 7").select("id"), members)


@query("WITH ch AS (SELECT o_custkey AS id, (max(o_orderkey) % 25)::BIGINT AS new FROM orders GROUP BY 1) SELECT c_custkey AS id, coalesce(ch.new, CASE WHEN c_acctbal >= 0 THEN c_nationkey END) AS owner FROM customer LEFT JOIN ch ON ch.id = c_custkey WHERE coalesce(ch.new, CASE WHEN c_acctbal >= 0 THEN c_nationkey END) IS NOT NULL")
def assign_upsert(t):
    rows = owned(t).select("id", F.col("owner").cast("long").alias("owner"), "status", F.lit(None).cast("string").alias("group_id"))
    changes = t("orders").groupBy(F.col("o_custkey").alias("id")).agg((F.max("o_orderkey") % 25).alias("owner"))
    groups = override_groups(t).withColumn("owner", F.col("owner").cast("long"))
    return ownership.assign(rows, groups, changes)[0].select("id", "owner")


@query(f"SELECT id, owner FROM {OWNED} WHERE owner NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def delete_country_cascade(t):
    rows = owned(t).select("id", "owner", "status")
    gone = countries(t).where("continent = 1").select("country_id")
    return ownership.delete_country(rows, override_groups(t), countries(t), gone)[0].select("id", "owner")


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS group_id FROM customer WHERE c_acctbal >= 0")
def ungroup_members(t):
    rows = t("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner"), F.lit("core").alias("status"), F.when(F.col("c_nationkey") == 3, "gone").otherwise(F.col("c_mktsegment")).alias("group_id"))
    groups = rows.select("group_id").distinct().select("group_id", F.lit(1).alias("owner"), F.lit("core").alias("status"))
    return ownership.ungroup(rows, groups, rows.select("group_id", "id"), "gone")[0].select("id", "group_id")


@query("WITH RECURSIVE up(c, o) AS (SELECT n_nationkey, n_nationkey - 3 FROM nation WHERE n_nationkey >= 3), chain(c, o, d) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT chain.c, up.o, d + 1 FROM chain JOIN up ON up.c = chain.o) SELECT c AS country_id, arg_max(o, d) AS overlord, max(d) AS depth FROM chain GROUP BY c")
def vassal_chain(t):
    c = countries(t).withColumn("vassal_of", F.when(F.col("country_id") >= 3, F.col("country_id") - 3))
    return ownership.vassal_chain(c)


# time


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders GROUP BY 1")
def snapshot_years(t):
    return timeline.years(t("orders").withColumn("year", F.year("o_orderdate")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) = 1998")
def year_exact(t):
    return timeline.at_year(t("orders").withColumn("year", F.year("o_orderdate")), 1998).select("o_orderkey", "o_custkey")


@query("SELECT year, count(*) AS n FROM (SELECT CASE WHEN year(o_orderdate) = 1996 THEN NULL ELSE year(o_orderdate)::INTEGER END AS year FROM orders) WHERE year IS NOT NULL GROUP BY 1 UNION ALL SELECT 1996, count(*) FROM orders WHERE year(o_orderdate) = 2000")
def snapshot_overwrite(t):
    snap = t("orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return timeline.years(timeline.add_year(snap, 1996, timeline.at_year(snap, 2000).drop("year")))


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def editlog_replay(t):
    return timeline.replay(t("events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@query("SELECT user_id, event_id, r::INTEGER AS depth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 60")
def undo_stack(t):
    return timeline.undo_stack(t("events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "depth")


@query("SELECT user_id, stroke, count(*) AS n FROM (SELECT user_id, (sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS stroke FROM (SELECT *, coalesce((epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600)::INTEGER, 0) AS cut FROM events)) GROUP BY ALL")
def edit_strokes(t):
    return timeline.strokes(t("events"), "user_id", "ts", 3600).groupBy("user_id", "stroke").agg(F.count("*").alias("n"))


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_edits(t):
    return stream.windowed(t("events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, coalesce((epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800)::INTEGER, 0) AS cut FROM events)) GROUP BY user_id, g")
def edit_sessions(t):
    return stream.sessions(t("events")).select("user_id", F.unix_timestamp("start").alias("start"), "n")


# ordered


@query("WITH c AS (SELECT DISTINCT l_suppkey AS region_id, l_partkey AS id FROM lineitem), z AS (SELECT region_id, count(*) AS size FROM c GROUP BY 1) SELECT id, arg_max(region_id, (-size, region_id)) AS region_id, min(size) AS size FROM c JOIN z USING (region_id) GROUP BY id")
def smallest_claimant(t):
    return regions.smallest_claimant(bridge(t).distinct())


@query("SELECT l_partkey AS id, max(l_suppkey) AS region_id FROM lineitem GROUP BY 1")
def province_region(t):
    return regions.region_of_province(bridge(t))


OCTANT = "['East','Northeast','North','Northwest','West','Southwest','South','Southeast'][1 + ((round_even(degrees(atan2(y - 25, x - 20)) / 45, 0)::INTEGER % 8 + 8) % 8)]"


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY size DESC, id) AS place, {OCTANT} AS octant FROM {GRID}), q AS (SELECT *, row_number() OVER (PARTITION BY brand, place = 1, octant ORDER BY size DESC, id) AS again FROM r) SELECT id, CASE WHEN place = 1 THEN brand ELSE brand || ' ' || octant || CASE WHEN again > 1 THEN ' ' || again ELSE '' END END AS label FROM q")
def octant_suffix_names(t):
    rows = grid(t).withColumn("octant", s.octant_name(F.col("x") - 20, F.col("y") - 25))
    return ordered.octant_suffix(rows, "brand", "octant", [F.desc("size"), "id"], "brand").select("id", "label")


@query("SELECT p_partkey AS id, p_name || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def dedup_name_suffix(t):
    return ordered.dedup_names(grid(t).select("id", "name"), "name", ["id"]).select("id", "unique_name")


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(t):
    return ordered.duplicates(grid(t), ["name"])


@query(f"SELECT id, (lon + 360 * sum(turn) OVER (PARTITION BY country ORDER BY id))::DOUBLE AS unwrapped FROM (SELECT *, CASE WHEN lon - lag(lon) OVER w > 180 THEN -1 WHEN lon - lag(lon) OVER w < -180 THEN 1 ELSE 0 END AS turn FROM {SEEDS} WINDOW w AS (PARTITION BY country ORDER BY id))")
def dateline_unwrap(t):
    return ordered.unwrap(seeds(t), ["country"], ["id"], "lon").select("id", F.col("unwrapped").alias("unwrapped"))


@query("SELECT event_id, (sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS segment FROM (SELECT *, coalesce((abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 20)::INTEGER, 0) AS cut FROM events)")
def jump_segments(t):
    o = ["ts", "event_id"]
    return ordered.segments(t("events"), ["user_id"], o, ordered.jump("value", ["user_id"], o, 20)).select("event_id", "segment")


@query(f"SELECT y AS r, unit AS v, min(x) AS first, max(x) AS last FROM (SELECT *, x - row_number() OVER (PARTITION BY y, unit ORDER BY x) AS island FROM {GRID}) GROUP BY y, unit, island")
def rle_runs(t):
    cells = grid(t).select(F.col("y").cast("long").alias("r"), F.col("x").cast("long").alias("c"), F.col("unit").alias("v"))
    return ordered.runs(cells, "r", "c", "v")


@query("SELECT k, v[1] AS low, v[n // 10 + 1] AS p10, v[n // 2 + 1] AS median, v[9 * n // 10 + 1] AS p90, v[n] AS high, n FROM (SELECT l_returnflag AS k, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY 1)")
def size_percentiles(t):
    return ordered.indexed_percentiles(t("lineitem").select(F.col("l_returnflag").alias("k"), "l_extendedprice"), ["k"], "l_extendedprice")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS n FROM orders")
def dense_renumber(t):
    return ordered.numbered(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "n")


@query(f"SELECT name, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM {SEEDS} WHERE lat BETWEEN -60 AND 85")
def seed_union(t):
    a = seeds(t).withColumn("ord", F.col("id"))
    return ordered.seeds(a, a.withColumn("name", F.concat(F.lit(" "), F.upper("name"))).withColumn("lat", F.lit(1.0))).select("name", "lat", "lon")


# scalars

FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"SELECT n_name AS name, {FNV.format(x='n_name')} AS h FROM nation UNION SELECT p_name, {FNV.format(x='p_name')} FROM part")
def fnv1a_hash(t):
    names = t("nation").select(F.col("n_name").alias("name")).union(t("part").select("p_name")).distinct()
    return names.select("name", s.fnv1a("name").alias("h"))


@query("SELECT s_suppkey AS id, printf('#%02x%02x%02x', (226 + (h & 15))::INTEGER, (226 + ((h >> 4) & 15))::INTEGER, (224 + ((h >> 8) & 15))::INTEGER) AS color FROM (SELECT s_suppkey, ('0x' || substr(md5(s_name), 1, 8))::BIGINT AS h FROM supplier)")
def md5_shade(t):
    return t("supplier").select(F.col("s_suppkey").alias("id"), s.md5_shade("s_name").alias("color"))


def _hex_sql(r, gr, b):
    return f"printf('#%02x%02x%02x', greatest(0, least(255, {r}))::INTEGER, greatest(0, least(255, {gr}))::INTEGER, greatest(0, least(255, {b}))::INTEGER)"


@query(f"SELECT id, {_hex_sql('188 + d', '143 + d', '90 + d')} AS color FROM (SELECT p_partkey AS id, (p_partkey * 37) % 21 - 10 AS d FROM part)")
def jitter_colour(t):
    return grid(t).select("id", s.jitter_colour(F.lit("#bc8f5a"), "id").alias("color"))


@query(f"""WITH h AS (SELECT p_partkey AS id, {FNV.format(x='p_partkey::VARCHAR')} AS h FROM part),
a AS (SELECT id, ((h % 100) / 100.0 - 0.5) * 0.17::DOUBLE AS l, (((h >> 7) % 100) / 100.0 - 0.5) * 0.10::DOUBLE AS w FROM h),
b AS (SELECT id, w, floor(216 + ((CASE WHEN l >= 0 THEN 0 ELSE 255 END) - 216) * abs(l) + 0.5) AS r, floor(207 + ((CASE WHEN l >= 0 THEN 0 ELSE 255 END) - 207) * abs(l) + 0.5) AS g, floor(184 + ((CASE WHEN l >= 0 THEN 0 ELSE 255 END) - 184) * abs(l) + 0.5) AS b FROM a)
SELECT id, {_hex_sql("floor(r + ((CASE WHEN w >= 0 THEN 202 ELSE 106 END) - r) * abs(w) + 0.5)", "floor(g + ((CASE WHEN w >= 0 THEN 164 ELSE 143 END) - g) * abs(w) + 0.5)", "floor(b + ((CASE WHEN w >= 0 THEN 106 ELSE 202 END) - b) * abs(w) + 0.5)")} AS color FROM b""")
def province_tint(t):
    return grid(t).select("id", s.province_tint(F.lit("#d8cfb8"), "id").alias("color"))


@query("SELECT event_id, event_type || ' ' || CASE WHEN user_id BETWEEN 1 AND 9 THEN user_id || ' BC' ELSE user_id::VARCHAR END AS text FROM (SELECT event_id, event_type, user_id FROM events)")
def year_text(t):
    return t("events").select("event_id", F.concat_ws(" ", "event_type", s.year_text(F.when(F.col("user_id") < 10, -F.col("user_id")).otherwise(F.col("user_id")))).alias("text"))


@query("SELECT s_suppkey AS id, round(1.25 * ln(tan(pi()/4 + 0.4 * radians(greatest(-60, least(85, (s_suppkey*17)%140-60))))), 6) AS y FROM supplier")
def miller_project(t):
    return seeds(t).select("id", F.round(s.miller_y("lat"), 6).alias("y"))


@query("SELECT s_suppkey AS id, round(degrees(2.5 * (atan(exp(0.8 * ((s_suppkey % 40) / 10.0 - 2))) - pi()/4)), 6) AS lat FROM supplier")
def cell_inverse(t):
    return seeds(t).select("id", F.round(s.inverse_miller((F.col("id") % 40) / 10 - 2), 6).alias("lat"))


GDIST = "sqrt(pow(least(abs(plon - lon), 360 - abs(plon - lon)) * greatest(cos(radians((plat + lat) / 2.0)), 0.15), 2) + pow(plat - lat, 2))"


@query(f"SELECT point_id, arg_min(id, (round({GDIST}, 9), id)) AS id, min(round({GDIST}, 9)) AS d FROM {PLACES}, {SEEDS} GROUP BY point_id")
def nearest_seed(t):
    return spatial.nearest_place(places(t), seeds(t)).select("point_id", "id", "d")


@query(f"SELECT id, CASE WHEN lat BETWEEN 34 AND 62 AND lon BETWEEN -11 AND 32 THEN 0.45 {' '.join(f'WHEN lat BETWEEN {a} AND {b} AND lon BETWEEN {c} AND {d} THEN {m}' for a, b, c, d, m in s.DENSITY)} ELSE 1.0 END::DOUBLE AS factor FROM {SEEDS}")
def density_class(t):
    return seeds(t).select("id", s.density("lat", "lon").alias("factor"))


@query("SELECT p_partkey AS id, CASE WHEN a > 0.45 THEN 'desert' WHEN b > 0.42 THEN 'mountain' WHEN c > 0.45 THEN 'hills' WHEN lat > 64 OR lat < -52 THEN 'tundra' WHEN abs(lat) < 13 THEN 'jungle' WHEN lat > 48 AND lat < 64 THEN 'forest' ELSE 'plains' END AS terrain FROM (SELECT p_partkey, (p_partkey * 7 % 100) / 100.0 AS a, (p_partkey * 11 % 100) / 100.0 AS b, (p_partkey * 13 % 100) / 100.0 AS c, p_partkey % 140 - 60 AS lat FROM part)")
def terrain_class(t):
    share = lambda m: (F.col("id") * m % 100) / 100
    return grid(t).select("id", s.terrain_class(share(7), share(11), share(13), F.col("id") % 140 - 60).alias("terrain"))


@query("SELECT event_id, CASE WHEN r <= 3 THEN 'major' WHEN r <= 5 THEN 'medium' ELSE 'minor' END AS importance FROM (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 9 ELSE user_id % 10 END AS r FROM events)")
def importance_bucket(t):
    return t("events").select("event_id", s.importance(F.col("user_id") % 10).alias("importance"))


@query("SELECT p_partkey AS id, ((p_partkey % 256) << 16) | ((p_partkey * 3 % 256) << 8) | (p_partkey * 5 % 256) AS key, ((p_partkey % 256 // 14) << 16) | ((p_partkey * 3 % 256 // 14) << 8) | (p_partkey * 5 % 256 // 14) AS coarse FROM part")
def colour_keys(t):
    c = [F.col("id") % 256, F.col("id") * 3 % 256, F.col("id") * 5 % 256]
    return grid(t).select("id", s.colour_key(*c).alias("key"), s.quantised_key(*c).alias("coarse"))


@query(f"SELECT doc_id, coalesce(length(text) = 0 OR regexp_matches(trim(text), '{s.GENERIC_NAME}'), true) AS generic FROM documents")
def generic_name_filter(t):
    return t("documents").select("doc_id", (~s.useful_name("text")).alias("generic"))


# geometry


@query(f"SELECT id, 1.0::DOUBLE AS area, 4.0::DOUBLE AS perimeter, round(pi() / 4, 9) AS compactness, x + 0.5::DOUBLE AS cx, y + 0.5::DOUBLE AS cy FROM {GRID}")
def ring_measures(t):
    r = grid(t).withColumn("ring", g.wound(g.unit_square("x", "y")))
    c = g.centroid("ring")
    return r.select("id", F.abs(g.ring_area("ring")).alias("area"), g.perimeter("ring").alias("perimeter"), F.round(g.compactness("ring"), 9).alias("compactness"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query(f"SELECT id, 'M' || printf('%.1f,%.1f', x::DOUBLE, y::DOUBLE) || 'L' || printf('%.1f,%.1f', x+1.0, y::DOUBLE) || 'L' || printf('%.1f,%.1f', x+1.0, y+1.0) || 'L' || printf('%.1f,%.1f', x::DOUBLE, y+1.0) || 'Z' AS path, 1 AS rings FROM {GRID}")
def svg_paths(t):
    p = grid(t).select("id", g.path_text(F.array(g.unit_square("x", "y"))).alias("path"))
    return p.select("id", "path", F.size(g.parse_path("path")).alias("rings"))


@query(f"SELECT point_id, id FROM (SELECT c_custkey AS point_id, (c_custkey * 7 % 400) / 10.0 + 0.05 AS px, (c_custkey * 3 % 500) / 10.0 + 0.05 AS py FROM customer) LEFT JOIN {GRID} ON floor(px) = x AND floor(py) = y")
def point_in_polygon(t):
    k = F.col("c_custkey")
    points = t("customer").select(k.alias("point_id"), ((k * 7 % 400) / 10 + 0.05).alias("px"), ((k * 3 % 500) / 10 + 0.05).alias("py"))
    squares = grid(t).select("id", F.array(g.unit_square("x", "y")).alias("polygon"))
    return spatial.point_in_polygon(points, squares, 2.0, keep="id").select("point_id", "id")


@query(f"SELECT ax::DOUBLE AS ax, ay::DOUBLE AS ay, bx::DOUBLE AS bx, \"by\"::DOUBLE AS \"by\", min(unit) AS u0, max(unit) AS u1 FROM {LINES} GROUP BY ax, ay, bx, \"by\" HAVING count(*) > 1 AND min(unit) <> max(unit)")
def border_edges(t):
    return ed.borders(grid_edges(t), "unit").drop("n")


@query(f"SELECT ax::DOUBLE AS ax, ay::DOUBLE AS ay, bx::DOUBLE AS bx, \"by\"::DOUBLE AS \"by\", min(unit) AS unit FROM {LINES} GROUP BY ax, ay, bx, \"by\" HAVING count(*) = 1")
def coast_edges(t):
    return ed.coast(grid_edges(t), "unit").select(*ed.EDGE, F.col("u0").alias("unit"))


@query(f"SELECT unit, count(*)::DOUBLE AS perimeter, (SELECT count(*) FROM part WHERE p_type = unit)::DOUBLE AS area FROM (SELECT unit, ax, ay, bx, \"by\" FROM {LINES} GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY unit")
def dissolve_measures(t):
    return ed.dissolved_measures(grid_edges(t), "unit")


@query(f"SELECT a, b, count(*)::DOUBLE AS length FROM (SELECT min(brand) AS a, max(brand) AS b FROM {LINES} GROUP BY ax, ay, bx, \"by\" HAVING count(*) = 2 AND min(brand) <> max(brand)) GROUP BY a, b")
def shared_border_lengths(t):
    return ed.shared_lengths(grid_edges(t), "brand")


@query(f"SELECT unit, sum(n)::DOUBLE AS area FROM (SELECT unit, count(*) AS n FROM {GRID} GROUP BY unit) GROUP BY unit")
def outline_areas(t):
    return ed.outlines(grid_edges(t), "unit").groupBy("unit").agg(F.sum("area").alias("area"))


@query(f"SELECT r, c, n FROM (SELECT y + i AS r, x + j AS c, count(DISTINCT unit) AS n FROM {GRID}, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) GROUP BY ALL) WHERE n >= 3")
def junction_points(t):
    cells = grid(t).select(F.col("y").cast("long").alias("r"), F.col("x").cast("long").alias("c"), F.col("unit").alias("v"))
    return ed.junctions(cells)


KNN = f"""WITH n AS (SELECT id, x, y FROM {GRID}), p AS (SELECT a.id AS a, b.id AS b, sqrt((least(abs(a.x-b.x), 40-abs(a.x-b.x)))**2 + (a.y-b.y)**2) AS d FROM n a JOIN n b ON a.id <> b.id AND abs(a.y-b.y) <= 2 AND least(abs(a.x-b.x), 40-abs(a.x-b.x)) <= 2),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p WHERE d <= 2) WHERE r <= 8), u AS (SELECT DISTINCT least(a,b) AS a, greatest(a,b) AS b, d FROM k)
SELECT a, b, round(d, 6) AS d FROM u UNION ALL SELECT b, a, round(d, 6) FROM u"""


@query(KNN)
def adjacency_knn(t):
    nodes = grid(t).select("id", "x", "y", F.lit(1.0).alias("r"))
    return spatial.neighbour_graph(nodes, 2.0, 8, 40.0).withColumn("d", F.round("d", 6))


@query(f"WITH b AS (SELECT id, x, y, size, x + 1 + size / 60.0 AS x1, y + 1 AS y1 FROM {GRID}) SELECT a.id AS lid, arg_max(b.id, (b.size, -b.id)) AS rid FROM b a JOIN b ON a.id <> b.id AND a.x - 0.5 <= b.x1 AND b.x <= a.x1 + 0.5 AND a.y - 0.5 <= b.y1 AND b.y <= a.y1 + 0.5 WHERE a.id % 50 = 0 GROUP BY a.id")
def largest_near_box(t):
    b = grid(t).select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 1 + F.col("size") / 60.0).alias("x1"), (F.col("y") + 1).alias("y1"), F.col("size").alias("area"))
    return spatial.largest_near(b, b.where("id % 50 = 0"), 3.0, 0.5)


# growth


def grid_graph(t) -> DataFrame:
    cells = grid(t).select("id", F.col("y").alias("r"), F.col("x").alias("c"))
    e = raster.cell_edges(cells).select("a", "b")
    return e.union(e.select("b", "a"))


@query(f"SELECT id, arg_min(seed, (d, seed)) AS seed, min(d)::DOUBLE AS dist FROM (SELECT g.id, s.id AS seed, abs(g.x - s.x) + abs(g.y - s.y) AS d FROM {GRID} g, (SELECT * FROM {GRID} WHERE id % 97 = 5) s WHERE (SELECT count(*) FROM part) % 40 = 0) GROUP BY id")
def grow_regions(t):
    cells = grid(t).select("id", F.col("y").alias("r"), F.col("x").alias("c"))
    return growth.grow_tiled(grid(t).where("id % 97 = 5").select("id", F.col("id").alias("seed")), grid_graph(t).withColumn("w", F.lit(1.0)), growth.square_tiles(cells))


@query(f"""WITH RECURSIVE e AS (SELECT a.id AS a, b.id AS b FROM {GRID} a JOIN {GRID} b ON a.unit = b.unit AND abs(a.x-b.x) + abs(a.y-b.y) = 1), reach(id, c) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.id) SELECT id, min(c) AS component FROM reach GROUP BY id""")
def region_components(t):
    cells = grid(t).select("id", F.col("y").alias("r"), F.col("x").alias("c"), F.col("unit").alias("v"))
    return raster.label_regions(cells)


@query(f"""WITH e AS (SELECT a.id AS a, b.id AS b, b.size AS s FROM {GRID} a JOIN {GRID} b ON abs(a.x-b.x) + abs(a.y-b.y) = 1 WHERE a.size < 5) SELECT a AS id, arg_max(b, (s, -b)) AS target FROM e GROUP BY a""")
def sliver_targets(t):
    shared = ed.shared_lengths(grid_edges(t), "id")
    best = spatial.best_neighbour(shared, grid(t).select("id", "size"))
    return best.join(grid(t).where("size < 5").select("id"), "id", "left_semi").select("id", "target")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 44)")
def coverage_gap(t):
    return regions.coverage_gap(grid(t).select("id"), t("lineitem").where("l_returnflag = 'R' and l_quantity > 44").select(F.col("l_partkey").alias("id")))


@query("SELECT count(*) AS total, count_if(l_returnflag = 'R')::BIGINT AS returned, count_if(l_discount > 0.05)::BIGINT AS discounted FROM lineitem")
def counter_report(t):
    return writers.report(t("lineitem"), {"returned": F.col("l_returnflag") == "R", "discounted": F.col("l_discount") > 0.05})


@query("SELECT p_partkey AS id, least(24, greatest(1, greatest(round_even(c / 540.0, 0), ceil(c / 4200.0))))::INTEGER AS parts FROM (SELECT p_partkey, p_size * 500 AS c FROM part)")
def province_parts(t):
    return grid(t).withColumn("cells", F.col("size") * 500).select("id", growth.part_count("cells").alias("parts"))


@query(f"SELECT y AS r, x AS c, (size > 25 OR coalesce(bool_or(nsize > 25), false)) AS v FROM (SELECT a.*, b.size AS nsize FROM {GRID} a LEFT JOIN {GRID} b ON abs(a.x-b.x) + abs(a.y-b.y) = 1) GROUP BY y, x, size")
def mask_dilate(t):
    cells = grid(t).select(F.col("y").cast("long").alias("r"), F.col("x").cast("long").alias("c"), (F.col("size") > 25).alias("v"))
    return raster.dilate(cells)


@query(f"SELECT id, r, c, arg_min(seed, (d, seed)) AS v FROM (SELECT a.id, a.y::DOUBLE AS r, a.x::DOUBLE AS c, b.size AS seed, abs(a.x-b.x) + abs(a.y-b.y) AS d FROM {GRID} a, {GRID} b WHERE b.size % 5 = 0 AND (SELECT count(*) FROM part) % 40 = 0) GROUP BY ALL")
def fill_raster_gaps(t):
    cells = grid(t).select("id", F.col("y").alias("r"), F.col("x").alias("c"), F.when(F.col("size") % 5 == 0, F.col("size")).alias("v"))
    return raster.fill_gaps(cells)


@query()
def merge_small_pieces(t):
    shared = ed.shared_lengths(grid_edges(t), "id")
    return growth.merge_small(grid(t).select("id", F.col("size").cast("double").alias("size")), shared, 30.0)


def _kmeans_sql(k: int, rounds: int) -> str:
    """Farthest-point seeds and the rounds of k-means, one table for each step."""
    steps = ["p AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)", "s1 AS MATERIALIZED (SELECT 0 AS k, v FROM p ORDER BY id LIMIT 1)"]
    d2 = "list_sum(list_transform(list_zip(p.v, s.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for n in range(1, k):
        steps.append(f"s{n + 1} AS MATERIALIZED (SELECT * FROM s{n} UNION ALL SELECT {n}, v FROM (SELECT id, any_value(p.v) AS v, min({d2}) AS d FROM p, s{n} s GROUP BY id ORDER BY d DESC, id LIMIT 1))")
    for n in range(rounds):
        near = f"n{n} AS MATERIALIZED (SELECT id, any_value(p.v) AS v, arg_min(k, ({d2}, k)) AS k FROM p, s{k + n} s GROUP BY id)"
        mean = f"m{n} AS MATERIALIZED (SELECT k, list(m ORDER BY i) AS v FROM (SELECT k, i, avg(v[i]) AS m FROM n{n}, range(1, len(v) + 1) r(i) GROUP BY k, i) GROUP BY k)"
        steps += [near, mean, f"s{k + n + 1} AS MATERIALIZED (SELECT s.k, coalesce(m.v, s.v) AS v FROM s{k + n} s LEFT JOIN m{n} m ON m.k = s.k)"]
    return f"WITH {', '.join(steps)} SELECT id, arg_min(k, ({d2}, k))::INT AS cluster, round(min({d2}), 6) AS d2 FROM p, s{k + rounds} s GROUP BY id"


@query(_kmeans_sql(10, 12))
def kmeans_clusters(t):
    points = t("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return growth.kmeans(points, 10).select("id", "cluster", F.round("d2", 6).alias("d2"))


def _noise_sql() -> str:
    def octave(n: int, share: float) -> str:
        at = lambda i, j: f"(xor(xor((y // {n} + {i})::BIGINT * 73856093, (x // {n} + {j})::BIGINT * 19349663), {n * 83492791 + 11}::BIGINT) % 2147483647 * 48271 % 2147483647 % 1000003 / 1000003::DOUBLE)"
        tr, tc = f"((y % {n}) / {n}::DOUBLE)", f"((x % {n}) / {n}::DOUBLE)"
        return f"{share} * (({at(0, 0)} * (1 - {tc}) + {at(0, 1)} * {tc}) * (1 - {tr}) + ({at(1, 0)} * (1 - {tc}) + {at(1, 1)} * {tc}) * {tr})"

    return f"(SELECT id, size, ({' + '.join(octave(n, share) for n, share in ((64, 1.0), (32, 0.5), (16, 0.25)))}) / 1.75 AS noise FROM {GRID})"


@query(f"SELECT id, round(noise, 6) AS noise, round_even(10 * (0.5 + noise), 0) + CASE WHEN size > 45 THEN 110 ELSE 0 END + CASE WHEN size % 3 = 0 THEN 26 ELSE 0 END + CASE WHEN size % 4 = 0 THEN 5 ELSE 0 END + CASE WHEN size % 5 = 0 THEN 6 ELSE 0 END AS cost FROM {_noise_sql()}")
def noise_costs(t):
    flag = lambda n: F.col("size") % n == 0
    cells = grid(t).select("id", F.col("y").cast("int").alias("r"), F.col("x").cast("int").alias("c"), (F.col("size") > 45).alias("river"), flag(3).alias("ranges"), flag(4).alias("desert"), flag(5).alias("plateau"))
    return raster.entry_cost(raster.noise(cells)).select("id", F.round("noise", 6).alias("noise"), "cost")


@query(f"SELECT id, r, c, arg_min(seed, (d2, seed)) AS v FROM (SELECT a.id, a.y AS r, a.x AS c, b.size AS seed, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) AS d2 FROM {GRID} a, {GRID} b WHERE b.size % 5 = 0) GROUP BY ALL")
def fill_nearest_gaps(t):
    cells = grid(t).select("id", F.col("y").cast("long").alias("r"), F.col("x").cast("long").alias("c"), F.when(F.col("size") % 5 == 0, F.col("size")).alias("v"))
    return raster.fill_nearest(cells)


# sources and sinks


@query(f"SELECT id, name, 5 AS points FROM {GRID}")
def geojson_roundtrip(t):
    squares = grid(t).select("id", "name", F.array(g.unit_square("x", "y")).alias("polygon"))
    lines = writers.feature_lines(squares, "polygon", ["name"])
    wrapped = lines.select(F.concat(F.lit(writers.HEAD), "value", F.lit(writers.TAIL)).alias("value"))
    back = readers.generic_features(readers.polygons(readers.feature_collection(wrapped)))
    return back.select(F.col("id").cast("long").alias("id"), "name", F.size(F.col("geom")[0][0]).alias("points"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS keys FROM events")
def event_properties(t):
    m = F.from_json("props", "map<string,string>")
    return t("events").select("event_id", F.map_values(m)[0].alias("first_value"), F.size(m).cast("long").alias("keys"))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS owner, n_name AS owner_name FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_acctbal >= 0 THEN c_nationkey END")
def effective_export(t):
    o = owned(t).withColumn("color", F.lit(None).cast("string"))
    c = countries(t).withColumn("color", s.auto_colour("ord"))
    return writers.effective_export(o.select("id", "name"), o, c).select("id", "name", "owner", "owner_name")


# pipelines


def atoms(t) -> DataFrame:
    """The grid as atoms: atlas regions are blocks of 10 x 10 cells, states a tilted pattern with gaps."""
    x, y = F.col("x"), F.col("y")
    state = F.floor((x + y) / 7).cast("long") * 100 + F.floor((x - y + 100) / 9).cast("long")
    return grid(t).select("id", "x", "y", F.lit(1.0).alias("size"), (F.col("size") * 40.0 + 600).alias("area"), (F.floor(y / 10) * 4 + F.floor(x / 10)).cast("long").alias("atlas"), F.when(F.col("id") % 11 != 0, state).alias("state"))


@query()
def merged_region_grid(t):
    from .plans import merged_regions as m

    a = atoms(t)
    names = a.select("atlas").distinct().select(F.lit("atlas").alias("kind"), F.col("atlas").alias("key"), F.concat(F.lit("Atlas "), F.col("atlas").cast("string")).alias("name"))
    names = names.unionByName(a.select("state").distinct().where("state is not null").select(F.lit("state").alias("kind"), F.col("state").alias("key"), F.concat(F.lit("Land "), F.col("state").cast("string")).alias("name")))
    return m.regions(m.merged(a), names).drop("region")


@query()
def world_provinces(t):
    from .plans import world as w

    flag = lambda n: F.col("size") % n == 0
    cells = grid(t).select("id", F.col("y").cast("int").alias("r"), F.col("x").cast("int").alias("c"), (F.col("size") > 4).alias("land"), flag(13).alias("river"), flag(3).alias("ranges"), flag(4).alias("desert"), flag(5).alias("plateau"))
    starts = grid(t).where("id % 211 = 9").select("id", F.col("y").cast("int").alias("r"), F.col("x").cast("int").alias("c"), "name")
    dealt = w.provinces(cells, w.territories(cells, starts), per_part=60)
    return w.described(cells, dealt, starts, lambda y: 85 - y * 2)


BOXES = "(SELECT s_suppkey AS sid, (s_suppkey * 37 % 36) + 0.5 AS bx, (s_suppkey * 17 % 46) + 0.25 AS byy FROM supplier)"


@query(f"SELECT id, sid, round((least(x + 1, bx + 2.5) - greatest(x, bx)) * (least(y + 1, byy + 2.5) - greatest(y, byy)), 6)::DOUBLE AS area FROM {GRID} JOIN {BOXES} ON x < bx + 2.5 AND bx < x + 1 AND y < byy + 2.5 AND byy < y + 1")
def overlap_areas(t):
    from .operators import overlay

    k = F.col("s_suppkey")
    x, y = F.col("rx0"), F.col("ry0")
    places = t("supplier").select(k.alias("sid"), ((k * 37 % 36).cast("double") + 0.5).alias("rx0"), ((k * 17 % 46).cast("double") + 0.25).alias("ry0"))
    # boxes of one place are laid over the cells once, under the smallest sid
    firsts = places.groupBy("rx0", "ry0").agg(F.min("sid").alias("first"))
    boxes = firsts.select("first", F.array(g.unit_square(x, y, 2.5)).alias("right"), x, (x + 2.5).alias("rx1"), y, (y + 2.5).alias("ry1"))
    cells = grid(t).select("id", F.array(g.unit_square("x", "y")).alias("left"), F.col("x").alias("lx0"), (F.col("x") + 1).alias("lx1"), F.col("y").alias("ly0"), (F.col("y") + 1).alias("ly1"))
    pairs = spatial.box_overlaps(cells, boxes, 4.0).select("id", "first", "left", "right")
    areas = overlay.overlay_pairs(pairs, "left", "right", "intersection").select("id", "first", F.round("polygon_area", 6).alias("area"))
    same = places.join(firsts.hint("merge"), ["rx0", "ry0"]).select("sid", "first")
    return same.join(areas.hint("merge"), "first").select("id", "sid", "area")


@query(f"WITH RECURSIVE s AS (SELECT s_suppkey AS id, s_suppkey * 7 % 40 AS x, s_suppkey * 3 % 50 AS y, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier), w AS MATERIALIZED (SELECT n, g.id AS node, (s.x-g.x)*(s.x-g.x) + (s.y-g.y)*(s.y-g.y) AS d FROM s JOIN {GRID} g ON abs(s.x-g.x) <= 6 AND abs(s.y-g.y) <= 6 WHERE size < 10 AND (s.x-g.x)*(s.x-g.x) + (s.y-g.y)*(s.y-g.y) <= 36), t(n, taken, node) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT UNION ALL SELECT n + 1, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best) END, best FROM (SELECT t.n, t.taken, arg_min(w.node, (w.d, w.node))::BIGINT AS best FROM t LEFT JOIN w ON w.n = t.n + 1 AND NOT list_contains(t.taken, w.node::BIGINT) WHERE t.n < (SELECT count(*) FROM supplier) GROUP BY t.n, t.taken)) SELECT s.id AS seed, t.node FROM t JOIN s ON s.n = t.n WHERE t.node IS NOT NULL")
def exclusive_seeds(t):
    s_ = t("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 40).cast("double").alias("x"), (F.col("s_suppkey") * 3 % 50).cast("double").alias("y"))
    return spatial.exclusive_nearest(s_, grid(t).where("size < 10").select("id", "x", "y"), 6.0)


# display and editing


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'имя ' || c_custkey ELSE c_name END AS shown FROM customer")
def display_names(t):
    from .functions import display

    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("имя "), F.col("c_custkey").cast("string"))).otherwise("").alias("ru"))
    return c.select("id", display.display_name("name", "ru", "ru").alias("shown"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '#cdbf86' WHEN 1 THEN '#5f8a52' WHEN 2 THEN '#e3cd8f' ELSE '#d8cfb8' END AS fill FROM part")
def terrain_fill(t):
    from .functions import display

    terrain = F.element_at(F.array(*map(F.lit, ("plains", "forest", "desert", "odd"))), (F.col("id") % 4 + 1).cast("int"))
    return grid(t).select("id", display.province_fill("terrain", "id", terrain, F.lit(None), F.lit(None)).alias("fill"))


@query("""SELECT s_suppkey AS id, round(l * (0.8707 - 0.131979*pow(p,2) - 0.013791*pow(p,4) + 0.003971*pow(p,10) - 0.001529*pow(p,12)), 6) AS x,
round(p * (1.007226 + 0.015085*pow(p,2) - 0.044475*pow(p,6) + 0.028874*pow(p,8) - 0.005916*pow(p,10)), 6) AS y
FROM (SELECT s_suppkey, radians((s_suppkey*37)%360-180) AS l, radians((s_suppkey*17)%140-60) AS p FROM supplier)""")
def natural_earth_project(t):
    from .functions import display

    x, y = display.natural_earth("lon", "lat")
    return seeds(t).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT c_mktsegment AS group_id, arg_max(c_custkey, (area, -c_custkey)) AS id, sum(area)::BIGINT AS total FROM (SELECT *, c_custkey % 97 AS area FROM customer) GROUP BY 1")
def group_labels(t):
    from .operators import editing

    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("group_id"), (F.col("c_custkey") % 97).alias("area"))
    return editing.group_labels(c.select("group_id", "id"), c)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_tally(t):
    from .operators import editing

    return editing.tally(t("events"), "event_type")


@query("SELECT user_id, trunc(median(r))::INTEGER AS r, trunc(median(g))::INTEGER AS g, trunc(median(b))::INTEGER AS b FROM (SELECT user_id, event_id % 256 AS r, event_id * 3 % 256 AS g, event_id * 7 % 256 AS b FROM events) GROUP BY 1")
def median_colours(t):
    from .operators import editing

    e = t("events").select("user_id", (F.col("event_id") % 256).alias("r"), (F.col("event_id") * 3 % 256).alias("g"), (F.col("event_id") * 7 % 256).alias("b"))
    return editing.median_colours(e, "user_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS key, coalesce(CASE WHEN p_size > 10 THEN p_partkey END, 0) AS province_id FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def colour_look_up(t):
    from .operators import editing

    definitions_ = t("part").where("p_size > 10").select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("province_id"))
    return editing.look_up(t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("key")), definitions_)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Local ' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'File ' || s_suppkey ELSE 'State ' || s_suppkey END AS name FROM supplier")
def localised_names(t):
    from .operators import editing

    k = F.col("s_suppkey")
    text = lambda p: F.concat(F.lit(p), k.cast("string"))
    states = t("supplier").select(k.alias("id"), text("STATE_").alias("name"), F.when(k % 3 == 2, text("x-State").substr(1, 7)).otherwise(F.concat(k.cast("string"), F.lit("-"), text("File "))).alias("file"))
    known = t("supplier").where(k % 3 == 0).select(text("STATE_").alias("key"), text("Local ").alias("text"))
    return editing.state_names(states, known)


@query("SELECT l_suppkey AS id, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 9) AS ratio FROM lineitem GROUP BY 1")
def cover_ratio(t):
    from .operators import editing

    lines = t("lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("area"), "l_returnflag")
    whole = lines.groupBy("id").agg(F.sum("area").alias("area"))
    return editing.cover_ratio(whole, lines.where("l_returnflag = 'R'")).select("id", F.round("ratio", 9).alias("ratio"))


@query("SELECT min(p_partkey) AS id FROM part GROUP BY p_partkey % 150")
def distinct_shapes(t):
    from .operators import editing

    ring = g.unit_square(F.col("id") % 150, F.lit(0))
    turned = F.when(F.col("id") % 2 == 0, F.reverse(ring)).otherwise(F.concat(F.slice(ring, 3, 2), F.slice(ring, 1, 3)))
    return editing.distinct_shapes(grid(t).select("id", turned.alias("ring")), "id").select("id")


@query("SELECT p_partkey AS id, coalesce(nullif(b, ''), 'Brand#' || 1) AS name FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'Brand#' || (p_partkey % 40 // 20 + 1) END AS b, p_partkey % 40 AS x FROM part) WHERE x <= 20 OR b <> '' UNION ALL SELECT p_partkey, 'Brand#2' FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 40 > 20")
def semantic_groups(t):
    from .operators import editing

    name = F.when(F.col("id") % 10 == 0, "").otherwise(F.concat(F.lit("Brand#"), (F.floor(F.col("x") / 20) + 1).cast("string")))
    return editing.semantic_groups(grid(t).select("id", "x", "y", name.alias("sub")), "sub", 2)


LLOYD = "SELECT id, x, y, arg_min(site, (round(sqrt((x-sx)*(x-sx)+(y-sy)*(y-sy)), 9), site)) AS site FROM {g}, {s} GROUP BY ALL"


@query(f"WITH s0 AS (SELECT id AS site, x AS sx, y AS sy FROM {GRID} WHERE id % 53 = 7), n0 AS ({LLOYD.format(g=GRID, s='s0')}), s1 AS (SELECT site, avg(x) AS sx, avg(y) AS sy FROM n0 GROUP BY site), n1 AS ({LLOYD.format(g=GRID, s='s1')}), s2 AS (SELECT site, avg(x) AS sx, avg(y) AS sy FROM n1 GROUP BY site), n2 AS ({LLOYD.format(g=GRID, s='s2')}) SELECT id, site FROM n2")
def lloyd_cells(t):
    from .operators import editing

    sites = grid(t).where("id % 53 = 7").select(F.col("id").alias("site"), "x", "y")
    return editing.lloyd(grid(t).select("id", "x", "y"), sites, 4.0)


@query(f"SELECT id, CASE WHEN x % 10 < 1 THEN x - x % 10 ELSE x END::DOUBLE AS x, y::DOUBLE AS y FROM {GRID}")
def snapped_points(t):
    from .operators import editing

    points = grid(t).select("id", (F.col("x") + F.when(F.col("x") % 10 == 0, 0.3).otherwise(0.0)).alias("x"), "y")
    return editing.snapped(points, grid(t).select("x", "y"), 0.5)


from . import file_queries, more_queries, region_queries  # noqa: E402, F401  these register their queries here
