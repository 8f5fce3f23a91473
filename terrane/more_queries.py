"""More registered queries: scalar functions, shapes, edits of tables, region layers and text sources, each with its SQL.

The roles of the tables are those of `queries`. Shapes are concave: an L of two rectangles, twice as large
for every third cell, with its corner at the cell.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import display
from .functions import geometry as g
from .functions import scalars as s
from .operators import ordered, ownership, regions, spatial, timeline
from .queries import FNV, GRID, OWNED, SEEDS, countries, grid, owned, query, seeds
from .sources import catalog, readers, writers
from .storage import spread

# shapes

_L = ((0, 0), (2, 0), (2, 1), (1, 1), (1, 3), (0, 3), (0, 0))
_SCALE = "(1 + (id % 3 = 0)::INT)"


def _ell(k, x="x", y="y"):
    return F.array(*(g.point(F.col(x) + a * k, F.col(y) + b * k) for a, b in _L))


def _ells(t):
    k = F.when(F.col("id") % 3 == 0, 2.0).otherwise(1.0)
    return spread(grid(t).select("id", "x", "y", "size"), "id").select("id", "x", "y", "size", _ell(k).alias("ring"), k.alias("k"))


@query(f"SELECT id, 4.0 * {_SCALE} * {_SCALE} AS area, 10.0::DOUBLE * {_SCALE} AS perimeter, round(16 * pi() / 100, 9) AS compactness, round(x + 0.75 * {_SCALE}, 6)::DOUBLE AS cx, round(y + 1.25 * {_SCALE}, 6)::DOUBLE AS cy, 2.0::DOUBLE * {_SCALE} AS width, 3.0::DOUBLE * {_SCALE} AS height FROM {GRID}".replace("4.0 *", "4.0::DOUBLE *"))
def concave_measures(t):
    c, b = g.centroid("ring"), g.bbox("ring")
    return _ells(t).select("id", F.abs(g.ring_area("ring")).alias("area"), g.perimeter("ring").alias("perimeter"), F.round(g.compactness("ring"), 9).alias("compactness"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), (b["x1"] - b["x0"]).alias("width"), (b["y1"] - b["y0"]).alias("height"))


_UV = "(id * 7 % 23) / 10.0 + 0.03 AS u, (id * 13 % 37) / 10.0 + 0.03 AS v"


@query(f"SELECT id, ((u < 2 AND v < 1) OR (u < 1 AND v < 3)) AND NOT (u > 0.2 AND u < 0.6 AND v > 0.2 AND v < 2.6) AS inside FROM (SELECT id, {_UV} FROM {GRID})")
def inside_with_hole(t):
    hole = F.array(*(g.point(F.col("x") + a, F.col("y") + b) for a, b in ((0.2, 0.2), (0.2, 2.6), (0.6, 2.6), (0.6, 0.2), (0.2, 0.2))))
    polygon = F.array(_ell(F.lit(1.0)), hole)
    u, v = (F.col("id") * 7 % 23) / 10 + 0.03, (F.col("id") * 13 % 37) / 10 + 0.03
    shapes = grid(t).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), u.alias("u"), v.alias("v"))
    return shapes.select("id", g.inside_polygon("u", "v", polygon).alias("inside"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 15.0 ELSE 3.0 END::DOUBLE AS area FROM {GRID}")
def areas_with_holes(t):
    hole = F.array(*(g.point(F.col("x") + a, F.col("y") + b) for a, b in ((0.25, 0.5), (0.25, 2.5), (0.75, 2.5), (0.75, 0.5), (0.25, 0.5))))
    return _ells(t).select("id", g.polygon_area(F.array("ring", hole)).alias("area"))


@query(f"SELECT id, 13 AS points, round(4 * {_SCALE} * {_SCALE} - 5 * 0, 6)::DOUBLE AS outline FROM {GRID}")
def corner_cut_rings(t):
    """One pass gives two points for each edge; five corners lose a triangle and the reflex corner gains one."""
    cut = _ells(t).withColumn("cut", g.corner_cut("ring"))
    lost = F.lit(sum(abs((a[0] - b[0]) * (c[1] - b[1]) - (a[1] - b[1]) * (c[0] - b[0])) / 32 * sign for a, b, c, sign in ((_L[(k - 1) % 6], _L[k], _L[k + 1], -1 if k == 3 else 1) for k in range(6))))
    return cut.select("id", F.size("cut").alias("points"), F.round(F.abs(g.ring_area("cut")) + lost * F.col("k") * F.col("k"), 6).alias("outline"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 4 ELSE 5 END AS points FROM {GRID}")
def decimated_rings(t):
    """Steps shorter than half a unit go; a ring of four points stays as it is."""
    long = F.array(*(g.point(F.col("x") + a, F.col("y") + b) for a, b in ((0, 0), (0.1, 0), (1, 0), (1.05, 0), (2, 0), (2, 2), (0, 0))))
    short = F.array(*(g.point(F.col("x") + a, F.col("y") + b) for a, b in ((0, 0), (0.1, 0), (0.1, 0.1), (0, 0))))
    return grid(t).select("id", F.size(g.decimate(F.when(F.col("id") % 3 == 0, short).otherwise(long), 0.5)).alias("points"))


@query(f"SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE 7 END AS points FROM {GRID}")
def cleaned_rings(t):
    """Repeated points go; a ring without area goes whole."""
    k = F.when(F.col("id") % 7 == 0, 0.0).otherwise(1.0)
    ring = F.flatten(F.transform(_ell(k), lambda p: F.array_repeat(p, 2)))
    return spread(grid(t).select("id", "x", "y"), "id").select("id", F.size(g.clean_ring(ring)).alias("points")).withColumn("points", F.when(F.col("points") > 0, F.col("points")))


@query("SELECT id, x + CASE WHEN x + 1 > 180 THEN -360 WHEN x + 1 < -180 THEN 360 ELSE 0 END AS x0 FROM (SELECT p_partkey AS id, (p_partkey % 90 * 10 - 450)::DOUBLE AS x FROM part)")
def turned_rings(t):
    far = grid(t).select("id", (F.col("id") % 90 * 10 - 450).cast("double").alias("x"), F.lit(0.0).alias("y"))
    return far.select("id", g.bbox(g.turned_parts(F.array(_ell(F.lit(1.0))))[0])["x0"].alias("x0"))


@query("SELECT id, (w * h <= 1e-5 OR (w * h < 0.006 AND c < 0.07)) AS needle, NOT (a < 3 OR (c < 0.06 AND a < 80)) AS shown FROM (SELECT *, w * h AS one, w * h * 10000 AS a, 4 * pi() * w * h / (4 * (w + h) * (w + h)) AS c FROM (SELECT p_partkey AS id, p_size * 0.0203 AS w, 0.0517 / (1 + p_partkey % 50) AS h FROM part))")
def needles_and_coasts(t):
    w, h = F.col("size") * 0.0203, F.lit(0.0517) / (1 + F.col("id") % 50)
    ring = lambda k: F.array(*(g.point(w * a * k, h * b * k) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    return spread(grid(t).select("id", "size"), "id").select("id", g.is_needle(ring(1)).alias("needle"), g.shown_on_coast(ring(100)).alias("shown"))


@query(f"SELECT id, round(x * 2 + 3, 6)::DOUBLE AS x0, round(y * 0.5 - 1, 6)::DOUBLE AS y0, 1 AS rings, round(4 * {_SCALE} * {_SCALE}, 3)::DOUBLE AS area FROM {GRID}")
def moved_rings(t):
    moved = g.bbox(g.moved("ring", 3, -1, 2, 0.5))
    parsed = g.once(g.parse_path(g.path_text(F.array("ring"))), lambda p: F.struct(F.size(p).alias("rings"), F.abs(g.ring_area(p[0])).alias("area")))
    each = _ells(t).select("id", moved.alias("moved"), parsed.alias("parsed"))
    return each.select("id", F.round("moved.x0", 6).alias("x0"), F.round("moved.y0", 6).alias("y0"), F.col("parsed.rings").alias("rings"), F.round("parsed.area", 3).alias("area"))


@query(f"SELECT id, round(4 * {_SCALE} * {_SCALE} * 111.32 * 111.32 * greatest(cos(radians(y + 1.25 * {_SCALE})), 0.08), 3) AS km2 FROM {GRID}")
def areas_in_km2(t):
    return _ells(t).select("id", F.round(g.area_km2("ring"), 3).alias("km2"))


# scalar functions

_HEX = "'#' || printf('%02x', {r}::INT) || printf('%02x', {g}::INT) || printf('%02x', {b}::INT)"
_rgb = ["(id * 7 % 256)", "(id * 11 % 256)", "(id * 13 % 256)"]


def _hsl(h: str, sat: str, light: str) -> str:
    one = lambda n: f"floor(255 * ({light} / 100.0 - ({sat} / 100.0) * least({light} / 100.0, 1 - {light} / 100.0) * greatest(-1.0, least(({n} + {h} / 30.0) % 12 - 3, 9 - ({n} + {h} / 30.0) % 12, 1.0))) + 0.5)"
    return _HEX.format(r=one(0), g=one(8), b=one(4))


@query(f"SELECT id, {_HEX.format(**{c: f'floor({v} + (255 - {v}) * 0.3 + 0.5)' for c, v in zip('rgb', _rgb)})} AS lighter, {_HEX.format(**{c: f'floor({v} - {v} * 0.25 + 0.5)' for c, v in zip('rgb', _rgb)})} AS darker, {_hsl('(id * 17 % 360)', '(20 + id % 60)', '(10 + id % 80)')} AS hsl FROM {GRID}")
def colour_arithmetic(t):
    c = s.rgb_hex(*(F.col("id") * k % 256 for k in (7, 11, 13)))
    return grid(t).select("id", s.lighten(c, 0.3).alias("lighter"), s.darken(c, 0.25).alias("darker"), s.hsl_hex(F.col("id") * 17 % 360, 20 + F.col("id") % 60, 10 + F.col("id") % 80).alias("hsl"))


_HUES = " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in s.TYPE_HUE.items())


@query(f"SELECT id, coalesce(nullif(own, ''), {_hsl('hue', '(34 + (h >> 7) % 16)', '(50 + (h >> 11) % 16)')}) AS color FROM (SELECT *, (CASE {_HUES} ELSE 320 END + h % 76 - 38 + 360) % 360 AS hue FROM (SELECT id, CASE WHEN id % 10 = 0 THEN '#123456' WHEN id % 10 = 1 THEN '' END AS own, CASE id % 4 WHEN 0 THEN 'state' WHEN 1 THEN 'cultural' WHEN 2 THEN 'political' ELSE 'other' END AS kind, {FNV.format(x='id::VARCHAR')} AS h FROM {GRID}))")
def region_colours(t):
    own = F.when(F.col("id") % 10 == 0, "#123456").when(F.col("id") % 10 == 1, "")
    kind = F.when(F.col("id") % 4 == 0, "state").when(F.col("id") % 4 == 1, "cultural").when(F.col("id") % 4 == 2, "political").otherwise("other")
    return grid(t).select("id", display.shown_colour(own, kind, F.col("id").cast("string")).alias("color"))


@query(f"SELECT id, floor(price / 3 + 0.5)::BIGINT AS up, round_even((size / 2.0)::DOUBLE, 0)::DOUBLE AS even, greatest(5.0, least(30.0, size))::DOUBLE AS clamped, substr(sha256(id::VARCHAR || '|' || name), 1, 7) AS stable FROM {GRID}")
def rounding_and_ids(t):
    return grid(t).select("id", s.round_up(F.col("price") / 3).alias("up"), s.round_even((F.col("size") / 2).cast("double")).cast("double").alias("even"), s.clamp(F.col("size").cast("double"), 5, 30).alias("clamped"), s.stable_id("id", "name").alias("stable"))


@query(f"SELECT id, array_to_string(list_transform(string_split(array_to_string(list_transform(range(1, len(low) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(low[i - 1], '[a-zé]') THEN upper(low[i]) ELSE low[i] END), ''), ' '), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ('of', 'the', 'al', 'el', 'de', 'da', 'do') THEN lower(w) ELSE w END), ' ') AS title, CASE WHEN id % 4 <= 1 OR lower(name) = 'red bolt' OR regexp_matches(other, '{s.GENERIC_NAME}') THEN 'Red Bolt' ELSE other END AS part_name, regexp_matches(other, '{s.PLACEHOLDER_NAME}') AS placeholder, CASE WHEN id % 3 = 0 THEN 'historical' WHEN id % 2 = 0 THEN 'cultural' ELSE 'geographical' END AS reason FROM (SELECT *, CASE WHEN id % 5 = 0 THEN 'State ' || id WHEN id % 5 = 1 THEN 'TS ' || id ELSE name END AS other, lower(replace(name, 'l', '-')) || ' the élan d''or of ' || id || 'th' AS low FROM {GRID})")
def names_of_parts(t):
    other = F.when(F.col("id") % 5 == 0, F.concat(F.lit("State "), F.col("id"))).when(F.col("id") % 5 == 1, F.concat(F.lit("TS "), F.col("id"))).otherwise(F.col("name"))
    rows = grid(t).select("id", "name", other.alias("other"))
    reason = s.region_reason(F.when(F.col("id") % 3 == 0, "x").otherwise(""), F.when(F.col("id") % 2 == 0, "y"))
    return rows.select("id", s.title_name(F.concat(F.regexp_replace("name", "l", "-"), F.lit(" the  Élan d'or of "), F.col("id").cast("string"), F.lit("th"))).alias("title"), s.split_name(F.lit("Red Bolt"), "other", F.col("id") % 4).alias("part_name"), s.is_placeholder("other").alias("placeholder"), reason.alias("reason"))


@query(f"SELECT id, coalesce(nullif(trim(regexp_replace(raw, '[^\\p{{L}}\\p{{N}} _-]+', '', 'g')), ''), 'map') AS base, coalesce(t, f, k) AS text FROM (SELECT id, CASE WHEN id % 3 = 0 THEN name || '/\"' || id || '\".*' WHEN id % 3 = 1 THEN '??' ELSE 'a_b-' || id END AS raw, CASE WHEN id % 4 = 0 THEN name END AS t, CASE WHEN id % 2 = 0 THEN 'fall ' || id END AS f, 'KEY_' || id AS k FROM {GRID})")
def file_names_and_texts(t):
    raw = F.when(F.col("id") % 3 == 0, F.concat("name", F.lit('/"'), "id", F.lit('".*'))).when(F.col("id") % 3 == 1, "??").otherwise(F.concat(F.lit("a_b-"), "id"))
    text = s.translated(F.when(F.col("id") % 4 == 0, F.col("name")), F.when(F.col("id") % 2 == 0, F.concat(F.lit("fall "), "id")), F.concat(F.lit("KEY_"), "id"))
    return grid(t).select("id", s.file_base(raw).alias("base"), text.alias("text"))


@query(f"SELECT id, round(CASE WHEN one * width > room THEN greatest(3.2, room / width) ELSE one END, 6) AS size, round(least(60.0, 0.55 * least(2000.0 / along, 1020.0 / across)), 6) AS zoom FROM (SELECT *, least(greatest(4.0, least(26.0, sqrt(price) * 0.14 * 10)), greatest(3.2, across * 0.7)) AS one, along * 0.92 AS room, greatest(1, length(name)) * 0.62 AS width FROM (SELECT *, (1 + id % 400)::DOUBLE AS along, (1 + id % 37)::DOUBLE AS across FROM {GRID}))")
def label_sizes(t):
    along, across = (1 + F.col("id") % 400).cast("double"), (1 + F.col("id") % 37).cast("double")
    size = s.label_size(F.col("price") * 100, F.length("name"), along, across)
    return grid(t).select("id", F.round(size, 6).alias("size"), F.round(s.zoom_scale(along, across), 6).alias("zoom"))


@query(f"SELECT id, round((id % 200) / 10.0, 6)::DOUBLE AS x, round(1.5 + 2 * ((id % 200) / 10.0) + 0.25 * ((id % 200) / 10.0) ** 3, 6)::DOUBLE AS y FROM {GRID}")
def cubic_and_back(t):
    c = [1.5, 2.0, 0.0, 0.25]
    y = s.polyval((F.col("id") % 200) / 10, c)
    return grid(t).select("id", F.round(s.inverse_cubic(y, c, -1, 30), 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT o_custkey AS id, count(*) || ':' || sum((o_orderstatus = 'O')::INT) || ':' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) || ':' || coalesce(string_agg(CASE WHEN o_orderstatus = 'O' THEN o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey::VARCHAR), '') AS key FROM orders GROUP BY o_custkey")
def edit_keys(t):
    k = F.col("o_orderkey").cast("string")
    lists = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(k).alias("removed"), F.collect_list(F.when(F.col("o_orderstatus") == "O", k)).alias("added"))
    return lists.select("id", s.edits_key("removed", "added").alias("key"))


# ownership and countries


_STRIPED = "(SELECT c_custkey AS id, '00a0' || lpad(c_nationkey::VARCHAR, 2, '0') AS a, '00a0' || lpad((c_custkey % 25)::VARCHAR, 2, '0') AS b, c_custkey % 3 AS kind FROM customer)"


@query(f"SELECT id, '#' || replace(pair, '-', ',#') AS colors, 'pat-' || pair AS pattern FROM (SELECT id, CASE WHEN kind = 0 AND a <> b THEN a || '-' || b WHEN kind = 1 AND a <> '00a002' THEN a || '-00a002' ELSE a END AS pair FROM {_STRIPED})")
def stripes(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k.alias("id"), F.col("c_nationkey").cast("string").alias("owner"), F.when(k % 3 == 0, "disputed").when(k % 3 == 1, "occupied").otherwise("core").alias("status"), F.array((k % 25).cast("string")).alias("claimants"), F.lit("2").alias("occupier"))
    c = t("nation").select(F.col("n_nationkey").cast("string").alias("country_id"), F.concat(F.lit("#00a0"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("color"))
    return ownership.stripe_colours(rows, c).select("id", F.array_join("colors", ",").alias("colors"), s.stripe_id("colors").alias("pattern"))


@query(f"SELECT id, CASE WHEN id % 2 = 1 THEN name ELSE '' END AS name, owner, 'core' AS status FROM {OWNED} WHERE owner IS NOT NULL OR id % 2 = 1")
def cleaned_ownership(t):
    o = owned(t).withColumn("name", F.when(F.col("id") % 2 == 1, F.col("name")).otherwise("")).withColumn("group_id", F.lit(None).cast("string"))
    return ownership.cleanup(o).drop("group_id")


@query("SELECT n_nationkey AS country_id, CASE WHEN n_nationkey % 3 = 0 THEN 'N' || n_nationkey ELSE n_name END AS name, n_nationkey AS ord, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 THEN 9 ELSE n_regionkey END AS continent FROM nation UNION ALL SELECT 100 + r_regionkey, 'N' || (100 + r_regionkey), NULL, NULL FROM region UNION ALL SELECT 200 + r_regionkey, r_name, r_regionkey, r_regionkey FROM region".replace("NULL, NULL FROM region", "NULL, CASE WHEN r_regionkey % 2 = 0 THEN 9 END FROM region"))
def patched_countries(t):
    key = t("nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("country_id")).unionByName(t("region").select((F.col("r_regionkey") + 100).alias("country_id")))
    changes = key.select("country_id", F.concat(F.lit("N"), "country_id").alias("name"), F.when(F.col("country_id") % 2 == 0, 9).alias("continent"))
    new = t("region").select((F.col("r_regionkey") + 200).alias("country_id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("ord"), F.col("r_regionkey").alias("continent"))
    table = countries(t)
    return ownership.insert(ownership.patch(table, "country_id", changes), new.unionByName(table), "country_id").select("country_id", "name", "ord", "continent")


@query(f"SELECT id, owner, status, CASE WHEN id % 5 = 2 THEN 'g-new' ELSE group_id END AS group_id, (SELECT arg_min(owner, id) FROM {OWNED} WHERE id % 5 = 2 AND owner IS NOT NULL) AS group_owner FROM (SELECT *, 'core' AS status FROM {OWNED})")
def merged_groups(t):
    o = owned(t).drop("name")
    members = o.select("group_id", "id", F.col("id").alias("pos"))
    picked = o.where("id % 5 = 2").select("id", F.col("id").alias("pos"))
    out, _, group = ownership.merge_group(o, members, picked, "g-new")
    return out.select("id", "owner", "status", "group_id").join(F.broadcast(group.select(F.col("owner").alias("group_owner"))))  # one row


@query(f"SELECT group_id, count(*) AS members FROM {OWNED} WHERE id % 5 <> 2 AND owner IS NOT NULL GROUP BY group_id HAVING count(*) > 0")
def groups_with_members(t):
    o = owned(t)
    groups = o.select("group_id").distinct().unionByName(t("nation").select(F.col("n_name").alias("group_id")))
    left = o.where("id % 5 <> 2 and owner is not null").select("group_id", "id")
    return ownership.drop_empty_groups(groups, left).join(left, "group_id").groupBy("group_id").agg(F.count("*").alias("members"))


@query("SELECT o_orderkey AS id, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) <> 1995")
def deleted_year(t):
    return timeline.delete_year(t("orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year")), 1995)


@query(f"SELECT id, concat_ws(' · ', concat_ws(' — ', nullif(name, ''), CASE WHEN owner IS NOT NULL THEN 'C' || owner END), CASE WHEN id % 3 = 0 THEN 'hills' END, nullif(CASE WHEN id % 2 = 0 THEN id || ' km' ELSE '' END, '')) AS text FROM {OWNED}")
def hover_texts(t):
    owner = F.when(F.col("owner").isNotNull(), F.concat(F.lit("C"), "owner"))
    return owned(t).select("id", ownership.hover_text(F.col("name"), owner, F.when(F.col("id") % 3 == 0, "hills"), F.when(F.col("id") % 2 == 0, F.concat("id", F.lit(" km"))).otherwise("")).alias("text"))


# region layers


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 8 = 0 THEN 'edited' ELSE s_name END AS name, 'core' || (s_suppkey % 3) AS kind, CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'old' END AS a, 'b' AS b, CASE WHEN s_suppkey % 4 = 0 THEN 'c' END AS c FROM supplier WHERE s_suppkey % 10 <> 3 UNION ALL SELECT s_suppkey, 'own', 'custom', NULL, 'own', NULL FROM supplier WHERE s_suppkey % 10 = 3")
def resolved_regions(t):
    k = F.col("s_suppkey")
    pairs = lambda **kv: F.create_map(*(F.lit(x) for p in kv.items() for x in p))
    base = t("supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("core"), k % 3).alias("kind"), pairs(a="old", b="b").alias("metadata"))
    edits = t("supplier").where("s_suppkey % 4 = 0").select(k.alias("id"), F.when(k % 8 == 0, "edited").alias("name"), F.lit(None).cast("string").alias("kind"), pairs(a="new", c="c").alias("metadata"))
    custom = t("supplier").where("s_suppkey % 10 = 3").select(k.alias("id"), F.lit("own").alias("name"), F.lit("custom").alias("kind"), pairs(b="own").alias("metadata"))
    out = regions.resolve(base, edits, custom, ["name", "kind"])
    return out.select("id", "name", "kind", *(F.try_element_at("metadata", F.lit(m)).alias(m) for m in "abc"))


_MEMBERS = "(SELECT DISTINCT l_suppkey AS region_id, l_partkey AS id FROM lineitem)"


def _members(t):
    return t("lineitem").select(F.col("l_suppkey").alias("region_id"), F.col("l_partkey").alias("id")).distinct()


@query(f"SELECT region_id, count(*) AS n FROM {_MEMBERS} WHERE NOT (region_id % 3 = 0 AND id % 2 = 0) AND region_id % 5 <> 1 GROUP BY region_id")
def subtracted_members(t):
    m = _members(t)
    left = regions.subtract_members(m, m.where("region_id % 3 = 0 and id % 2 = 0"))
    gone = m.where("region_id % 5 = 1").select("region_id").distinct()
    _, kept = regions.delete_regions(m.select(F.col("region_id").alias("id")).distinct(), left, gone)
    return kept.groupBy("region_id").agg(F.count("*").alias("n"))


@query(f"SELECT layer_id, region_id, count(*) AS n FROM (SELECT 'L' || (region_id % 4) AS layer_id, 'r' || region_id AS region_id FROM {_MEMBERS} UNION ALL SELECT 'copy', 'r' || region_id || '_copy' FROM {_MEMBERS} WHERE region_id % 4 = 2) GROUP BY ALL")
def duplicated_layer(t):
    m = _members(t).select(F.concat(F.lit("L"), F.col("region_id") % 4).alias("layer_id"), F.concat(F.lit("r"), "region_id").alias("region_id"))
    return regions.duplicate_layer(m, "L2", "copy").groupBy("layer_id", "region_id").agg(F.count("*").alias("n"))


_LAYERS = "(SELECT 'y' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'state' ELSE 'cultural' END AS type, n_nationkey AS ord, n_nationkey % 3 = 0 AS locked, n_nationkey % 4 = 0 AS builtin FROM nation)"


@query(f"SELECT id, type, ord, 'kept' AS step FROM {_LAYERS} WHERE id <> 'y6' OR builtin UNION ALL (SELECT id, type, ord, 'picked' FROM {_LAYERS} WHERE type = 'state' AND NOT locked AND NOT builtin ORDER BY ord LIMIT 1)")
def layer_choices(t):
    k = F.col("n_nationkey")
    layers = t("nation").select(F.concat(F.lit("y"), k).alias("id"), F.when(k % 2 == 0, "state").otherwise("cultural").alias("type"), k.alias("ord"), (k % 3 == 0).alias("locked"), (k % 4 == 0).alias("builtin"))
    kept, picked = regions.delete_layer(layers, "y6"), regions.pick_layer(layers, "state")
    return kept.select("id", "type", "ord", F.lit("kept").alias("step")).unionByName(picked.select("id", "type", "ord", F.lit("picked").alias("step")))


@query(f"SELECT region_id, arg_max(terrain, (n, -first)) AS terrain, max(n) AS n FROM (SELECT region_id, p_type AS terrain, count(*) AS n, min(id) AS first FROM {_MEMBERS} JOIN part ON p_partkey = id GROUP BY ALL) GROUP BY region_id")
def region_terrains(t):
    m = _members(t).withColumn("pos", F.col("id"))
    return regions.region_terrain(m, t("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("terrain")))


@query(f"SELECT CASE WHEN n = 1 THEN brand_id ELSE 999999 + row_number() OVER (PARTITION BY n > 1 ORDER BY brand_id, n) END AS brand_id, ord FROM (SELECT brand_id, ord, row_number() OVER (PARTITION BY brand_id ORDER BY ord) AS n FROM (SELECT id % 700 AS brand_id, id AS ord FROM {GRID}))")
def renumbered_ids(t):
    rows = grid(t).select((F.col("id") % 700).alias("brand_id"), F.col("id").alias("ord"))
    return regions.fresh_ids(rows, "brand_id", "ord").select(F.col("brand_id").cast("long").alias("brand_id"), "ord")


@query(f"SELECT brand AS brand, size, count(*) AS n FROM {GRID} GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(t):
    return ordered.duplicates(grid(t), ["brand", "size"])


@query(f"SELECT a.id, CASE WHEN h.n IS NULL THEN 'own' || (a.id % 3) ELSE 'k' || h.n END AS kind FROM {GRID} a LEFT JOIN (SELECT a.id, min(n) AS n FROM {GRID} a JOIN (SELECT n_nationkey AS n, n_nationkey * 5 % 40 AS bx, n_nationkey * 7 % 50 AS ny FROM nation) ON a.x + 0.5 > bx AND a.x + 0.5 < bx + 9 AND a.y + 0.5 > ny AND a.y + 0.5 < ny + 11 GROUP BY a.id) h ON h.id = a.id")
def ranked_areas(t):
    areas = t("nation").select(F.col("n_nationkey").alias("rank"), F.concat(F.lit("k"), "n_nationkey").alias("kind"))
    box = F.array(F.array(*(g.point(F.col("rank") * 5 % 40 + a, F.col("rank") * 7 % 50 + b) for a, b in ((0, 0), (9, 0), (9, 11), (0, 11), (0, 0)))))
    points = grid(t).select(F.col("id").alias("point_id"), (F.col("x") + 0.5).alias("px"), (F.col("y") + 0.5).alias("py"))
    out = spatial.ranked_cover(points, areas.withColumn("polygon", box), 6.0, F.concat(F.lit("own"), F.col("point_id") % 3))
    return out.select(F.col("point_id").alias("id"), "kind")


# text sources and documents


@query("SELECT 'N_' || (p_partkey % 300) AS key, arg_max(p_name || p_partkey, p_partkey) AS text FROM part WHERE p_partkey % 11 <> 0 GROUP BY ALL")
def localisation_lines(t):
    key = F.concat(F.lit(" N_"), F.col("id") % 300, F.lit(":"), F.col("id") % 2, F.lit(' "'))
    line = F.when(F.col("id") % 11 == 0, F.concat(key, F.lit('"'))).otherwise(F.concat(key, "name", "id", F.lit('"')))
    return readers.localisation(grid(t).select(F.col("id").alias("pos"), line.alias("value")))


@query("SELECT s_suppkey::INT AS id, 'STATE_' || s_suppkey AS name, CASE WHEN s_suppkey % 4 > 0 THEN 'C' || s_nationkey END AS owner, 'town' AS category, s_suppkey || ',' || (s_suppkey + 1) AS provinces FROM supplier")
def state_script_texts(t):
    k = F.col("s_suppkey")
    owner = F.when(k % 4 > 0, F.concat(F.lit(" owner = C"), "s_nationkey", F.lit("\n"))).otherwise(F.lit("# owner = XXX\n"))
    text = F.concat(F.lit("state = {\n id = "), k, F.lit(" # id = 9\n name = \"STATE_"), k, F.lit('"\n'), owner, F.lit(" state_category = town\n provinces = { "), k, F.lit("\n "), k + 1, F.lit(" } }"))
    return readers.state_scripts(t("supplier").select(text.alias("value"))).withColumn("provinces", F.array_join("provinces", ","))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey ELSE 'new' END AS name, 'en' AS lang, c_custkey::VARCHAR AS x FROM customer")
def project_documents(t):
    k = F.col("c_custkey")
    text = F.concat(F.lit('{"x": '), k, F.when(k % 3 == 0, F.concat(F.lit(', "name": "m'), k, F.lit('"'))).otherwise(F.lit("")), F.lit("}"))
    p = readers.project(t("customer").select(k.alias("id"), text.alias("value")).select("value"), {"name": "new", "lang": "en"})
    return p.select(F.col("project")["x"].cast("long").alias("id"), *(F.col("project")[c].alias(c) for c in ("name", "lang", "x")))


def _collection(t, properties):
    """The cells as one feature collection's features, read back from its text."""
    squares = grid(t).select("id", *(v.alias(k) for k, v in properties.items()), F.array(g.unit_square("x", "y")).alias("polygon"))
    lines = writers.feature_lines(squares, "polygon", list(properties))
    return readers.polygons(readers.feature_collection(lines.select(F.concat(F.lit(writers.HEAD), "value", F.lit(writers.TAIL)).alias("value"))))


@query(f"SELECT 'p' || id AS id, id::INT AS pid, name, CASE WHEN id % 4 = 0 THEN 'land' WHEN id % 4 = 1 THEN 'desert' END AS ptype FROM {GRID} WHERE id % 4 IN (0, 1)")
def pixel_regions(t):
    kind = F.when(F.col("id") % 4 == 0, "land").when(F.col("id") % 4 == 1, "desert").when(F.col("id") % 4 == 2, "Sea").otherwise("lake")
    f = _collection(t, {"name": F.col("name"), "type": kind, "provinceId": F.col("id").cast("string")})
    return readers.pixel_features(f).select("id", "pid", "name", "ptype")


@query(f"SELECT name, typ, CASE typ WHEN 'land' THEN 'land' WHEN 'sea' THEN 'seas' WHEN 'strait' THEN 'seas' WHEN 'river' THEN 'rivers' WHEN 'lake' THEN 'lakes' ELSE 'relief' END AS layer, CASE WHEN id % 2 = 0 THEN 'major' ELSE 'minor' END AS importance FROM (SELECT *, ['land', 'sea', 'strait', 'river', 'lake', 'mountain'][id % 6 + 1] AS typ FROM {GRID})")
def physical_layers(t):
    kind = F.element_at(F.array(*map(F.lit, ("land", "sea", "strait", "river", "lake", "mountain"))), (F.col("id") % 6 + 1).cast("int"))
    f = _collection(t, {"name": F.col("name"), "type": kind, "importance": F.when(F.col("id") % 2 == 0, "major").otherwise("minor")})
    return readers.physical_features(f).select("name", "typ", "layer", "importance")


@query(f"SELECT x AS country, id FROM (SELECT 'b' || (id % 5) AS x, id FROM {GRID} WHERE id % 5 IN (1, 3)) UNION ALL SELECT 'b' || r_regionkey, -r_regionkey FROM region WHERE r_regionkey NOT IN (1, 3)")
def hybrid_map(t):
    provinces = grid(t).select(F.concat(F.lit("b"), F.col("id") % 5).alias("country"), "id")
    whole = t("region").select(F.concat(F.lit("b"), "r_regionkey").alias("country"), (-F.col("r_regionkey")).cast("long").alias("id"))
    big = t("region").where("r_regionkey in (1, 3)").select(F.concat(F.lit("b"), "r_regionkey").alias("country"))
    return readers.hybrid(whole, provinces, big).select("country", "id")


@query(f"SELECT name, type FROM (SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'historical' WHEN s_suppkey % 2 = 0 THEN 'cultural' ELSE 'geographical' END AS type FROM supplier)")
def typed_seeds(t):
    names = t("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    return writers.typed_seeds(names.select("name"), names.where("k % 3 = 0").select("name"), names.where("k % 2 = 0").select("name")).select("name", "type")


@query("SELECT 'state' AS id, 0 AS ord UNION ALL SELECT n_name, n_nationkey + 1 FROM nation")
def layers_with_states(t):
    layers = t("nation").select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.lit("cultural").alias("type"), F.col("n_nationkey").cast("int").alias("ord"), F.lit(False).alias("builtin"), F.lit(False).alias("locked"))
    return catalog.with_state_layer(layers).select("id", F.col("ord").cast("int").alias("ord"))


@query(f"SELECT id, coalesce(CASE WHEN c = sc THEN NULL ELSE near END, sname) AS name FROM (SELECT r.id, r.country AS c, s.country AS sc, s.name AS sname, (SELECT arg_min(n.name, (sqrt((r.x - n.lon) ** 2 + (r.y - n.lat) ** 2), n.id)) FROM {SEEDS} n WHERE n.country = r.country) AS near FROM (SELECT c_custkey AS id, c_nationkey AS country, (c_custkey * 53) % 360 - 180 AS x, (c_custkey * 29) % 140 - 60 AS y, c_custkey % (SELECT count(*) FROM supplier) AS seed FROM customer) r LEFT JOIN {SEEDS} s ON s.id = r.seed)")
def home_seed_names(t):
    k, n = F.col("c_custkey"), t("supplier").count()
    r = t("customer").select(k.alias("id"), F.col("c_nationkey").alias("country"), (k * 53 % 360 - 180).cast("double").alias("x"), (k * 29 % 140 - 60).cast("double").alias("y"), (k % n).alias("seed"))
    return spatial.home_names(r, seeds(t).select("id", "country", F.col("lon").alias("x"), F.col("lat").alias("y"), "name"))


@query(f"SELECT id, count(*) AS runs, sum(c1 - c0 + 1)::BIGINT AS cells FROM (SELECT y AS id, min(x) AS c0, max(x) AS c1 FROM (SELECT *, x - row_number() OVER (PARTITION BY y, size % 3 ORDER BY x) AS island FROM {GRID}) GROUP BY y, size % 3, island) GROUP BY id")
def row_runs(t):
    cells = grid(t).select(F.col("y").cast("long").alias("id"), F.col("x").cast("long").alias("x"), (F.col("size") % 3).alias("v"))
    return ordered.runs(cells, "id", "x", "v").groupBy("id").agg(F.count("*").alias("runs"), F.sum(F.col("last") - F.col("first") + 1).alias("cells"))


_MOMENTS = f"(SELECT brand AS owner, sum(w) AS w, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * x * x) / sum(w) AS mxx, sum(w * y * y) / sum(w) AS myy, sum(w * x * y) / sum(w) AS mxy FROM (SELECT *, sqrt(greatest(1, size)) AS w FROM (SELECT brand, size, x * (1 + length(name) % 3) + y * 0.4 AS x, y FROM {GRID})) GROUP BY brand)"
_SPREAD = f"(SELECT owner, cx, cy, mxx - cx * cx AS xx, myy - cy * cy AS yy, mxy - cx * cy AS xy FROM {_MOMENTS})"
_AXES = f"(SELECT owner, cx, cy, CASE WHEN (m + o) / greatest(0.01, m - o) < 1.45 OR abs(a) < 7 THEN 0 ELSE greatest(-25, least(25, a)) END AS angle FROM (SELECT *, (xx + yy) / 2 AS m, sqrt(greatest(0, (xx + yy) * (xx + yy) / 4 - (xx * yy - xy * xy))) AS o, degrees(0.5 * atan2(2 * xy, xx - yy)) AS a FROM {_SPREAD}))"


@query(f"SELECT owner, round(any_value(angle), 4)::DOUBLE AS angle, round(greatest(4.0, coalesce(nullif(2 * least(-least(0, min(p - pe)), greatest(0, max(p + pe))), 0), greatest(0, max(p + pe)) - least(0, min(p - pe)))), 4)::DOUBLE AS along, round(greatest(3.0, coalesce(nullif(2 * least(-least(0, min(q - qe)), greatest(0, max(q + qe))), 0), greatest(0, max(q + qe)) - least(0, min(q - qe)))), 4)::DOUBLE AS across FROM (SELECT a.owner, angle, (x - cx) * cos(radians(angle)) + (y - cy) * sin(radians(angle)) AS p, (y - cy) * cos(radians(angle)) - (x - cx) * sin(radians(angle)) AS q, 0.8 * (0.5 * cos(radians(angle)) + abs(sin(radians(angle)))) AS pe, 0.8 * (abs(0.5 * sin(radians(angle))) + cos(radians(angle))) AS qe FROM (SELECT brand AS owner, x * (1 + length(name) % 3) + y * 0.4 AS x, y FROM {GRID}) f JOIN {_AXES} a ON a.owner = f.owner) GROUP BY owner")
def label_axes(t):
    x = F.col("x") * (1 + F.length("name") % 3) + F.col("y") * 0.4
    f = grid(t).select("id", F.col("brand").alias("owner"), x.alias("x"), "y", F.col("size").alias("area"), F.lit(1.0).alias("width"), F.lit(2.0).alias("height"))
    axes = ownership.label_axis(ownership.owner_moments(f))
    span = ownership.label_span(f, axes)
    return axes.join(span, "owner").select("owner", *(F.round(c, 4).alias(c) for c in ("angle", "along", "across")))


@query("SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'untitled' END AS name, 'true' AS labels, '0.8' AS border FROM customer")
def project_roundtrip(t):
    """Project documents written and read back, over the defaults of a new one."""
    projects = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"), F.lit(True).alias("labels"))
    back = readers.project(writers.project_texts(projects, ["id", "name", "labels"]), {"name": "untitled", "border": "0.8"})
    return back.select(*(F.col("project")[c].alias(c) for c in ("id", "name", "labels", "border")))
