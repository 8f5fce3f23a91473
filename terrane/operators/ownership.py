"""Who owns what: effective ownership, selections, statistics and edits of ownership tables.

Tables: features(id, ...), ownership(id, owner, status, group_id, ...), groups(group_id, owner, status, ...),
members(group_id, id, pos), countries(country_id, ord, ...). Edits return new tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import auto_colour

#: An ownership row without any of these says nothing and is not stored.
SPARSE = ("owner", "color", "name", "population", "culture", "religion", "language", "notes", "group_id")


def effective(ownership: DataFrame, groups: DataFrame, attributes: tuple[str, ...] = ("owner", "status")) -> DataFrame:
    """Ownership in which a live group replaces all attributes of its members, also by null; a dangling group id does not count."""
    g = groups.select("group_id", F.lit(True).alias("live"), *(F.col(a).alias(f"group_{a}") for a in attributes))
    joined = ownership.join(g, "group_id", "left")
    kept = [c for c in ownership.columns if c not in attributes]
    return joined.select(*kept, *(F.when(F.col("live"), F.col(f"group_{a}")).otherwise(F.col(a)).alias(a) for a in attributes))


def owner_counts(owned: DataFrame) -> DataFrame:
    return owned.where("owner is not null").groupBy("owner").agg(F.count("*").alias("n"))


def legend(owned: DataFrame, countries: DataFrame) -> DataFrame:
    """Countries in list order with the number of their regions, 0 without any."""
    return countries.join(owner_counts(owned), countries["country_id"] == F.col("owner"), "left").select("country_id", "name", "ord", F.coalesce("n", F.lit(0)).alias("n")).orderBy("ord")


def unowned(features: DataFrame, owned: DataFrame) -> DataFrame:
    return features.join(owned.where("owner is not null"), "id", "left_anti")


def owned_by(owned: DataFrame, owner) -> DataFrame:
    return owned.where(F.col("owner") == owner)


def fill_like(features: DataFrame, picked) -> DataFrame:
    """Features with the owner of the picked one; for an unowned one, unowned features of its country (of all, where it has none)."""
    one = features.where(F.col("id") == picked).select(F.col("owner").alias("o"), F.col("country").alias("c")).limit(1)
    same = F.col("owner").eqNullSafe(F.col("o")) & (F.col("o").isNotNull() | F.col("c").isNull() | (F.col("country") == F.col("c")))
    return features.join(F.broadcast(one), same).drop("o", "c")  # one row


def in_box(features: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return features.where(F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1)))


def search(countries: DataFrame, features: DataFrame, text: str, most_countries: int = 4, most: int = 12) -> DataFrame:
    """Countries, then features, whose name contains the text (two letters at least), in list order; kind, id and name."""
    wanted = text.strip().lower()
    if len(wanted) < 2:
        wanted = None
    hit = F.lower("name").contains(F.lit(wanted)) if wanted else F.lit(False)
    a = countries.where(hit).orderBy("ord").limit(most_countries).select(F.lit("country").alias("kind"), F.col("country_id").cast("string").alias("id"), "name", "ord")
    b = features.where(hit).orderBy("ord").limit(most).select(F.lit("feature").alias("kind"), F.col("id").cast("string").alias("id"), "name", "ord")
    return a.unionByName(b).orderBy("kind", "ord").limit(most).drop("ord")


def plurality(rows: DataFrame, keys: list[str], value: str, pos: str, ties: str = "reached") -> DataFrame:
    """The commonest value of each key. Ties go to the value that reached the count first, or ("first") that was seen first. pos is any value with an order."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), (F.max(pos) if ties == "reached" else F.min(pos)).alias("at"))
    return counted.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "at")).alias("best")).select(*keys, f"best.{value}", "best.n")


def group_by_country(features: DataFrame) -> DataFrame:
    """Each feature's country (its name where it has none), with the country's rank by name and automatic colour."""
    named = features.withColumn("country", F.coalesce(F.nullif("country", F.lit("")), "name"))
    from .ordered import numbered

    ranks = numbered(named.select("country").distinct(), ["country"], "rank").select("country", F.col("rank").cast("int").alias("rank"))
    return named.join(ranks, "country").withColumn("color", auto_colour("rank"))


def owner_moments(features: DataFrame) -> DataFrame:
    """Per owner: sums for label placement, weighted by the square root of area, and the largest member."""
    w = F.sqrt(F.greatest(F.lit(1.0), F.col("area")))
    x, y = F.col("x"), F.col("y")
    sums = {"w": w, "wx": w * x, "wy": w * y, "wxx": w * x * x, "wyy": w * y * y, "wxy": w * x * y, "total": F.col("area")}
    largest = F.max_by("id", F.struct("area", -F.col("id"))).alias("largest")
    return features.where("owner is not null").groupBy("owner").agg(*(F.sum(v).alias(k) for k, v in sums.items()), largest)


#: A label follows the long axis of its owner's regions only if that is this much longer and this many degrees off; it turns by so many at most (fixed values).
AXIS_RATIO, AXIS_LEAST, AXIS_MOST = 1.45, 7, 25


def label_axis(moments: DataFrame) -> DataFrame:
    """Centre and angle (degrees) of each owner's label, from its moments: 0 where no axis stands out, -25..25 else."""
    cx, cy = F.col("wx") / F.col("w"), F.col("wy") / F.col("w")
    spread = moments.select("owner", cx.alias("cx"), cy.alias("cy"), (F.col("wxx") / F.col("w") - cx * cx).alias("xx"), (F.col("wyy") / F.col("w") - cy * cy).alias("yy"), (F.col("wxy") / F.col("w") - cx * cy).alias("xy"))
    middle = (F.col("xx") + F.col("yy")) / 2
    off = F.sqrt(F.greatest(F.lit(0.0), middle * middle - F.col("xx") * F.col("yy") + F.col("xy") * F.col("xy")))
    ratio = (middle + off) / F.greatest(F.lit(0.01), middle - off)
    angle = F.degrees(0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")))
    flat = (ratio < AXIS_RATIO) | (F.abs(angle) < AXIS_LEAST)
    return spread.select("owner", "cx", "cy", F.when(flat, 0.0).otherwise(F.greatest(F.lit(-float(AXIS_MOST)), F.least(F.lit(float(AXIS_MOST)), angle))).alias("angle"))


def label_span(features: DataFrame, axes: DataFrame) -> DataFrame:
    """(owner, along, across): room for a centred label along and across its axis, from features (owner, x, y, width, height).

    A feature counts with 0.8 of its half extent; the room is the same on both sides of the centre.
    """
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    dx, dy, w, h = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("width") / 2, F.col("height") / 2
    seen = features.join(axes, "owner").select("owner", (dx * c + dy * s).alias("p"), (dy * c - dx * s).alias("q"), (0.8 * (F.abs(w * c) + F.abs(h * s))).alias("pe"), (0.8 * (F.abs(w * s) + F.abs(h * c))).alias("qe"))

    def room(at: str, extent: str, least: float) -> Column:
        low, high = F.least(F.lit(0.0), F.min(F.col(at) - F.col(extent))), F.greatest(F.lit(0.0), F.max(F.col(at) + F.col(extent)))
        return F.greatest(F.lit(least), F.coalesce(F.nullif(2 * F.least(-low, high), F.lit(0.0)), high - low))

    return seen.groupBy("owner").agg(room("p", "pe", 4.0).alias("along"), room("q", "qe", 3.0).alias("across"))


def bounds(features: DataFrame, key: str) -> DataFrame:
    return features.groupBy(key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def unanimous(rows: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Each attribute where all rows of a key agree (nulls count as a value), else null."""
    same = [F.when((F.count(a) == F.count("*")) & F.min(a).eqNullSafe(F.max(a)), F.min(a)).alias(a) for a in attributes]
    return rows.groupBy(*keys).agg(*same)


def cleanup(ownership: DataFrame) -> DataFrame:
    """Drops rows that hold only defaults."""
    says = F.lit(False)
    for c in SPARSE:
        if c in ownership.columns:
            says = says | F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    if "status" in ownership.columns:
        says = says | F.coalesce(F.col("status") != "core", F.lit(False))
    return ownership.where(says)


def assign(ownership: DataFrame, groups: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets owners from changes(id, owner). A grouped region passes its change to its group; without an owner the status is core."""
    live = ownership.join(groups.select("group_id"), "group_id", "left_semi").select("id", "group_id")
    of_group = changes.join(live, "id").groupBy("group_id").agg(F.max_by("owner", F.col("id").cast("string")).alias("new"), F.lit(True).alias("hit"))
    new_groups = _updated(groups, of_group, "group_id")
    direct = changes.join(live, "id", "left_anti").select("id", F.col("owner").alias("new"), F.lit(True).alias("hit"))
    both = ownership.join(direct, "id", "full")
    return cleanup(_set_owner(both).select(*ownership.columns)), new_groups


def _updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return _set_owner(table.join(changes, key, "left")).select(*table.columns)


def _set_owner(joined: DataFrame) -> DataFrame:
    hit = F.coalesce("hit", F.lit(False))
    out = joined.withColumn("owner", F.when(hit, F.col("new")).otherwise(F.col("owner")))
    if "status" in joined.columns:
        out = out.withColumn("status", F.when(hit & F.col("owner").isNull(), "core").otherwise(F.coalesce("status", F.lit("core"))))
    return out


def patch(table: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Upserts the columns of changes; a null in changes leaves the value."""
    other = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in other))
    joined = table.join(new, key, "full")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in other else F.col(c) for c in table.columns))


def insert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Adds the rows whose key is not there yet."""
    return table.unionByName(rows.join(table, key, "left_anti"), allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys, key, "left_anti")


def delete_country(ownership: DataFrame, groups: DataFrame, countries: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deletes countries (gone: country_id) and frees what they own; claims and vassals keep dangling and are dropped by readers."""
    lost = gone.select(F.col("country_id").alias("owner"), F.lit(True).alias("gone"))

    def freed(t: DataFrame) -> DataFrame:
        joined = t.join(lost, "owner", "left")
        cols = {"owner": F.when(F.col("gone").isNull(), F.col("owner"))} | ({"status": F.when(F.col("gone"), "core").otherwise(F.col("status"))} if "status" in t.columns else {})
        return joined.withColumns(cols).select(*t.columns)

    return cleanup(freed(ownership)), freed(groups), delete(countries, gone, "country_id")


def merge_group(ownership: DataFrame, members: DataFrame, picked: DataFrame, group_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Makes a group of picked(id, pos): it takes the first owner and status in order; members leave their old groups.

    Returns ownership, all members and the new group's row.
    """
    rows = picked.join(ownership, "id", "left")
    first = rows.where("owner is not null").agg(F.min_by(F.struct("owner", "status"), "pos").alias("f"))
    group = first.select(F.lit(group_id).alias("group_id"), "f.owner", F.coalesce("f.status", F.lit("core")).alias("status"))
    left = members.join(picked, "id", "left_anti").select("group_id", "id", "pos")
    new_members = left.unionByName(picked.select(F.lit(group_id).alias("group_id"), "id", "pos"))
    moved = ownership.join(picked.select("id", F.lit(True).alias("hit")), "id", "full")
    out = moved.withColumn("group_id", F.when(F.col("hit"), F.lit(group_id)).otherwise(F.col("group_id")))
    return out.select(*ownership.columns), new_members, group


def drop_empty_groups(groups: DataFrame, members: DataFrame) -> DataFrame:
    return groups.join(members, "group_id", "left_semi")


def ungroup(ownership: DataFrame, groups: DataFrame, members: DataFrame, group_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dissolves a group: its owner and status go down to its members."""
    one = groups.where(F.col("group_id") == group_id).select("group_id", F.col("owner").alias("o"), F.col("status").alias("s"))
    joined = ownership.join(one, "group_id", "left")
    hit = F.col("group_id").eqNullSafe(F.lit(group_id))
    cols = {"owner": F.when(hit, F.col("o")).otherwise(F.col("owner")), "status": F.when(hit, F.col("s")).otherwise(F.col("status"))}
    out = joined.withColumns(cols).withColumn("group_id", F.when(~hit, F.col("group_id"))).select(*ownership.columns)
    rest = F.col("group_id") != group_id
    return cleanup(out), groups.where(rest), members.where(rest)


def expand_groups(selected: DataFrame, members: DataFrame) -> DataFrame:
    """Ids of the selection and of all members of the groups that they are in."""
    groups = members.join(selected, "id", "left_semi").select("group_id").distinct()
    return selected.select("id").union(members.join(groups, "group_id", "left_semi").select("id")).distinct()


def toggle(selected: DataFrame, clicked: DataFrame) -> DataFrame:
    """Ids in exactly one of the two."""
    both = selected.select("id").distinct().union(clicked.select("id").distinct())
    return both.groupBy("id").count().where("count = 1").select("id")


def apply_edits(base: DataFrame, removed: DataFrame, replaced: DataFrame, key: str = "id") -> DataFrame:
    """The base without removed and replaced rows, and the replacements and additions."""
    return base.join(removed, key, "left_anti").join(replaced, key, "left_anti").unionByName(replaced)


def stripe_colours(owned: DataFrame, countries: DataFrame) -> DataFrame:
    """Per region the distinct colours of its stripes, in order: of its owner and its claimants where it is disputed,
    of its owner and the occupier where it is occupied, of its owner and the target where it is assimilated.

    Columns that the table lacks count as null; one colour alone is a stripe of its own.
    """
    part = lambda c, kind: F.col(c) if c in owned.columns else F.lit(None).cast(kind)
    none = F.array().cast("array<string>")
    others = F.when(F.col("status") == "disputed", F.coalesce(part("claimants", "array<string>"), none)).when(F.col("status") == "occupied", F.array(part("occupier", "string"))).when(F.col("status") == "assimilation", F.array(part("target", "string"))).otherwise(none) if "status" in owned.columns else F.coalesce(part("claimants", "array<string>"), none)
    every = owned.select("id", F.posexplode(F.concat(F.array("owner"), others)).alias("pos", "country_id"))
    joined = every.join(countries.select("country_id", "color"), "country_id")
    listed = joined.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "color"))).alias("c"))
    return listed.select("id", F.array_distinct(F.transform("c", lambda s: s["color"])).alias("colors"))


def vassal_chain(countries: DataFrame) -> DataFrame:
    """(country_id, overlord, depth): the top overlord of each country and how many steps away it is.

    Each round doubles the steps, so chains of n countries take log n rounds. Countries on or below a cycle
    have no top: their overlord and depth are null.
    """
    from ..storage import stored

    up = countries.select(F.col("country_id").alias("c"), F.col("vassal_of").alias("o")).where("o is not null and o <> c").join(countries.select(F.col("country_id").alias("o")), "o", "left_semi")
    now = countries.select("country_id").join(up.select(F.col("c").alias("country_id"), "o"), "country_id", "left")
    now = stored(now.select("country_id", F.coalesce("o", "country_id").alias("at"), F.when(F.col("o").isNull(), 0).otherwise(1).alias("depth")), "chain")
    for _ in range(countries.count().bit_length() + 1):
        step = now.select(F.col("country_id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        new = stored(now.join(step, "at").select("country_id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth")), "chain")
        if new.exceptAll(now).isEmpty():
            return now.select("country_id", F.col("at").alias("overlord"), "depth")
        now = new
    tops = now.where("country_id = at and depth = 0").select(F.col("country_id").alias("at"), F.col("country_id").alias("overlord"))
    return now.join(tops, "at", "left").select("country_id", "overlord", F.when(F.col("overlord").isNotNull(), F.col("depth")).alias("depth"))


def hover_text(name: Column, owner: Column, terrain: Column, area: Column) -> Column:
    """Name, then owner after a dash, then terrain and area after dots; missing parts are left out."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" · ", F.concat_ws(" — ", filled(name), filled(owner)), filled(terrain), filled(area))
