"""What changed: actions, windows, comparison of two instants, and rules that grade a change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions import keys, masks
from reachbase.operators import access, acl, history

SEVERITIES = ("info", "low", "medium", "high", "critical")
WRITE_BITS = 0x2 | 0x4 | 0x10 | 0x100 | 0x10000 | 0x40 | masks.ESCALATION


def feed(log: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Versions that open in [start, stop) with their action and the interval in which the change lies."""
    opened = history.with_predecessor(log).where((F.col("valid_from") >= start) & (F.col("valid_from") < stop))
    rows = opened.join(history.first_present(log), ["kind", "container"], "left").withColumn("at", F.col("valid_from"))
    rows = history.confirmed_before(log, rows)
    action = F.when(F.col("state").isNull(), "removed").when(~F.col("had_before"), F.when(F.col("first_at") < F.col("valid_from"), "added").otherwise("first_observed")).when(F.col("before_state").isNull(), "added").otherwise("modified")
    after = F.when(F.col("had_before"), F.col("before_seen_at")).otherwise(F.col("confirmed_at"))
    rows = rows.withColumns({"action": action, "changed_after": after})
    return rows.select("kind", "key", "container", "before_state", "state", "action", F.when(F.col("action") != "first_observed", F.col("changed_after")).alias("changed_after"), F.greatest("valid_from", "changed_after").alias("changed_by"))


def compare(log: DataFrame, t1: Column, t2: Column) -> DataFrame:
    """kind, key, state_1, state_2, change: two instants side by side; unobserved on a side is not absent."""
    a = history.as_of(log, t1).select("kind", "key", F.col("state").alias("state_1"), F.lit(True).alias("seen_1"))
    b = history.as_of(log, t2).select("kind", "key", F.col("state").alias("state_2"), F.lit(True).alias("seen_2"))
    both = a.join(b, ["kind", "key"], "full_outer")
    change = (
        F.when(F.col("seen_1").isNull(), F.when(F.col("state_2").isNotNull(), "first_observed").otherwise("absent")).when(F.col("seen_2").isNull(), "unobserved")
        .when(F.col("state_1").isNull() & F.col("state_2").isNotNull(), "added").when(F.col("state_1").isNotNull() & F.col("state_2").isNull(), "removed").when(F.col("state_1").eqNullSafe(F.col("state_2")), "same").otherwise("modified")
    )
    return both.select("kind", "key", "state_1", "state_2", change.alias("change"))


def nth_key(keys_: DataFrame, n: int, step: int = 2) -> DataFrame:
    """k: the n-th of the column ``k`` in order, no row if there are fewer; ties count each.

    Nothing is sorted as a whole: counts by prefix say in which one it lies, and longer prefixes narrow that down until the
    prefix is a key of its own or what shares it is few.
    """
    prefix, left, width = "", n, step
    while True:
        here = keys_.where(F.col("k").startswith(prefix)) if prefix else keys_
        counts = here.groupBy(F.substring("k", 1, width).alias("p")).agg(F.count("*").alias("c"), F.min("k").alias("least"), F.max("k").alias("most"))
        seats = counts.withColumn("upto", F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))  # one row for each prefix
        row = seats.where(F.col("upto") >= left).orderBy("p").first()
        if row is None:
            return keys_.select("k").limit(0)
        if row["least"] == row["most"]:
            return here.where(F.col("k") == row["most"]).select("k").limit(1)
        prefix, left, width = row["p"], left - (row["upto"] - row["c"]), width + step


def compare_cut(log: DataFrame, t1: Column, t2: Column, ceiling: int) -> tuple[DataFrame, DataFrame]:
    """(kind, key, state_1, state_2, change) and (outcome, boundary, scope): two instants of which each side is read up to ``ceiling`` present objects.

    A side with more is cut at its ceiling-th object in order of kind and key, and both sides end at the lesser of the cuts: behind it one side's
    objects would look absent on the other.  A cut comparison is partial and names its last (kind, key) and, as
    narrower scope, the container with most objects among those that fit on both sides.
    """
    mark = lambda kind, key: F.concat(kind, F.lit("\0"), key)
    sides = [history.as_of(log, t).where("state IS NOT NULL").select("container", mark(F.col("kind"), F.col("key")).alias("k")) for t in (t1, t2)]
    cuts = [nth_key(x.select("k"), ceiling) if x.count() > ceiling else x.select("k").limit(0) for x in sides]
    boundary = cuts[0].union(cuts[1]).agg(F.min("k").alias("boundary"))
    last = boundary.scalar()
    rows = compare(log, t1, t2).where(last.isNull() | (mark(F.col("kind"), F.col("key")) <= last))
    a, b = (x.groupBy("container").agg(F.count("*").alias(n)) for x, n in zip(sides, ("n_1", "n_2"), strict=True))
    fitting = a.join(b, "container", "full_outer").fillna(0, ["n_1", "n_2"]).where((F.col("n_1") <= ceiling) & (F.col("n_2") <= ceiling))
    scope = fitting.agg(F.min_by("container", F.struct(-(F.col("n_1") + F.col("n_2")), F.col("container"))).alias("scope"))
    partial = F.col("boundary").isNotNull()
    outcome = boundary.withColumn("scope", scope.scalar()).select(F.when(partial, "partial").otherwise("complete").alias("outcome"), F.replace("boundary", F.lit("\0"), F.lit("|")).alias("boundary"), F.when(partial, F.col("scope")).alias("scope"))
    return rows, outcome


def summary(changes: DataFrame, by: list[str]) -> DataFrame:
    """One pass for all tallies: a row for each value of each column, and the total; only these grouping sets are computed."""
    sets = changes.groupingSets([[F.col(c)] for c in by] + [[]], *[F.col(c) for c in by]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet, value = F.lit("total"), F.lit("")
    for i, name in enumerate(by):
        only = F.col("g") == (1 << len(by)) - 1 - (1 << (len(by) - 1 - i))
        facet, value = F.when(only, F.lit(name)).otherwise(facet), F.when(only, F.col(name)).otherwise(value)
    return sets.select(facet.alias("facet"), value.alias("value"), "n")


@dataclass(frozen=True)
class Grade:
    """A rule on changed entries and memberships; the first one that holds grades the change."""

    name: str
    severity: str
    direction: str
    test: Column


def entry_grades() -> list[Grade]:
    """Grades of changes to entries: columns action, ace_type, trustee_key, mask."""
    added, removed = F.col("action") == "added", F.col("action") == "removed"
    allow, deny, broad = F.col("ace_type") == "allow", F.col("ace_type") == "deny", keys.is_broad(F.col("trustee_key"))
    full, climb, write = masks.holds(F.col("mask"), masks.FILE_ALL), masks.has(F.col("mask"), masks.ESCALATION), masks.has(F.col("mask"), WRITE_BITS)
    return [
        Grade("first_observed", "info", "neutral", F.col("action") == "first_observed"),
        Grade("ace.allow.broad.full", "critical", "broadened", added & allow & broad & full),
        Grade("ace.allow.broad.escalation", "critical", "broadened", added & allow & broad & climb),
        Grade("ace.allow.broad.write", "high", "broadened", added & allow & broad & write),
        Grade("ace.allow.broad", "high", "broadened", added & allow & broad),
        Grade("ace.deny.removed", "high", "broadened", removed & deny),
        Grade("ace.allow.full", "high", "broadened", added & allow & full),
        Grade("ace.allow.escalation", "high", "broadened", added & allow & climb),
        Grade("ace.allow.added", "medium", "broadened", added & allow),
        Grade("ace.deny.added", "low", "narrowed", added & deny),
        Grade("ace.allow.removed", "low", "narrowed", removed & allow),
        Grade("unclassified", "medium", "undetermined", F.lit(True)),
    ]


def membership_grades() -> list[Grade]:
    """Grades of changes to memberships: columns action, group_key, member_key."""
    added, removed = F.col("action") == "added", F.col("action") == "removed"
    privileged = keys.is_privileged(F.col("group_key"))
    return [
        Grade("first_observed", "info", "neutral", F.col("action") == "first_observed"),
        Grade("membership.added.privileged", "critical", "broadened", added & privileged),
        Grade("membership.added.broad", "high", "broadened", added & keys.is_broad(F.col("member_key"))),
        Grade("membership.removed.privileged", "medium", "narrowed", removed & privileged),
        Grade("membership.added", "medium", "broadened", added),
        Grade("membership.removed", "low", "narrowed", removed),
        Grade("unclassified", "medium", "undetermined", F.lit(True)),
    ]


def graded(changes: DataFrame, grades: list[Grade]) -> DataFrame:
    """Adds rule, severity and direction: one conditional chain in the order of the grades."""
    chain = F.coalesce(*[F.when(g.test, F.struct(F.lit(g.name).alias("rule"), F.lit(g.severity).alias("severity"), F.lit(g.direction).alias("direction"))) for g in grades])
    return changes.withColumn("_g", chain).select(*changes.columns, "_g.rule", "_g.severity", "_g.direction")


def admitted(changes: DataFrame, floor: str = "info", actions: tuple[str, ...] | None = None, significance: tuple[str, ...] | None = None) -> DataFrame:
    """Changes at least as severe as ``floor`` with one of the actions and of the significances; none named admits all.

    Severities go by their place in ``SEVERITIES``; a change without one is below every floor.
    """
    if floor not in SEVERITIES:
        raise ValueError(f"no severity {floor}")
    if actions == () or significance == ():
        raise ValueError("a filter that excludes everything reads like a quiet time")
    rows = changes.where(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(floor) :]))
    rows = rows if actions is None else rows.where(F.col("action").isin(*actions))
    return rows if significance is None else rows.where(F.col("significance").isin(*significance))


def entry_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries added and removed between two sets of lists, an edit paired where container, trustee and type say which."""
    where = ["resource_key", "trustee_key", "ace_type"]
    gone = before.join(after.select("ace_key"), "ace_key", "left_anti").select(*where, F.col("access_mask").alias("old_mask"), F.lit(None).cast("long").alias("new_mask"))
    new = after.join(before.select("ace_key"), "ace_key", "left_anti").select(*where, F.lit(None).cast("long").alias("old_mask"), F.col("access_mask").alias("new_mask"))
    sides = gone.unionByName(new).groupBy(*where).agg(F.count("old_mask").alias("removed"), F.count("new_mask").alias("added"), F.max("old_mask").alias("old_mask"), F.max("new_mask").alias("new_mask"))
    one = (F.col("removed") == 1) & (F.col("added") == 1)
    gain, loss = masks.minus(F.col("new_mask"), F.col("old_mask")) != 0, masks.minus(F.col("old_mask"), F.col("new_mask")) != 0
    wider, narrower = F.when(F.col("ace_type") == "deny", loss).otherwise(gain), F.when(F.col("ace_type") == "deny", gain).otherwise(loss)
    way = F.when(wider & narrower, "mixed").when(wider, "broadened").when(narrower, "narrowed").otherwise("neutral")
    return sides.select(*where, "removed", "added", F.when(one, "edited").otherwise("ambiguous").alias("pairing"), F.when(one, way).alias("direction"))


#: Fields that matter for access; changes to others are cosmetic.
SIGNIFICANT = {"ntfs_ace": ("access_mask", "ace_flags", "ace_type", "trustee_key"), "resource": ("dacl_present", "dacl_protected", "owner_key"), "principal": ("enabled", "kind")}


def field_deltas(before: DataFrame, after: DataFrame, key: str, fields: list[str], kind: str) -> DataFrame:
    """key, field, old, new, significant: one row for each field that differs, a missing side counting as null."""
    side = lambda rows, name: rows.select(key, F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]).alias(name))
    both = side(before, "_a").join(side(after, "_b"), key, "full_outer")
    each = both.select(key, "_a", "_b", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    rows = each.select(key, "field", F.try_element_at("_a", F.col("field")).alias("old"), F.try_element_at("_b", F.col("field")).alias("new"))
    return rows.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("significant", F.col("field").isin(*SIGNIFICANT.get(kind, ())))


def order_changes(resources: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """resource_key, material: lists that hold the same entries at other places.

    Material: the list's normal form differs, in which places are ranks.  So a gap in the
    numbers alone is not material, and any other order is, whoever holds the trustees.
    """
    short = lambda c: F.unhex(F.md5(c.cast("binary")))
    seat = F.struct("order_index", short(F.col("ace_key")).alias("key"), short(acl.normal_line()).alias("line"))
    # Both sides of a list are gathered at once, its entries as digests; what follows is told in the list's row.
    dealt = lambda rows, now: rows.select(access.list_id().alias("list"), F.lit(now).alias("now"), seat.alias("seat"))
    side = lambda now: F.array_sort(F.collect_list(F.when(F.col("now") == now, F.col("seat"))))
    rows = dealt(before, False).unionByName(dealt(after, True)).groupBy("list").agg(side(False).alias("a"), side(True).alias("b"))
    part = lambda es, *names: F.transform(es, lambda x: F.struct(*[x[n].alias(n) for n in names]))
    same = rows.where(F.array_sort(part("a", "key")) == F.array_sort(part("b", "key"))).where(part("a", "order_index", "key") != part("b", "order_index", "key"))
    placed = lambda es: ~F.exists(es, lambda x: x["order_index"].isNull()) & (F.size(F.array_distinct(part(es, "order_index"))) == F.size(es))
    form = lambda es: F.when(placed(es), part(es, "line")).otherwise(F.array_sort(part(es, "line")))
    told = same.select("list", ((placed("a") != placed("b")) | (form("a") != form("b"))).alias("material"))
    return resources.select("resource_key", access.list_id().alias("list")).join(told, "list").select("resource_key", "material")


def siblings(changes: DataFrame, container: str) -> DataFrame:
    """Adds how many other changes of the window fall into the same container."""
    return changes.withColumn("siblings", F.count("*").over(Window.partitionBy(container)) - 1)
