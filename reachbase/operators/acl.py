"""Access-control lists: ordered evaluation, inheritance and digests, as expressions over sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions import keys, masks

#: Entries beyond this position are not evaluated, and a finding says so.
MAX_ENTRIES = 4096


def applies_here() -> Column:
    """Not an entry that only children get, nor one whose trustee is filled in on children."""
    return (F.col("ace_flags").bitwiseAND(masks.INHERIT_ONLY) == 0) & ~keys.sid_of(F.col("trustee_key")).isin(keys.CREATOR_OWNER, keys.CREATOR_GROUP)


def seated(aces: DataFrame) -> DataFrame:
    """Adds ``past``: entries beyond the ``MAX_ENTRIES``-th of their list.

    Only longer lists are sorted; they are fewer than entries by that factor, so their keys are broadcast and no entry is shuffled to find them.
    """
    long = F.broadcast(cut_lists(aces))
    seat = F.row_number().over(Window.partitionBy("resource_key").orderBy(F.col("order_index").asc_nulls_last(), "ace_key"))
    sorted_ = aces.join(long, "resource_key", "left_semi").withColumn("past", seat > MAX_ENTRIES)
    return aces.join(long, "resource_key", "left_anti").withColumn("past", F.lit(False)).unionByName(sorted_)


def considered(aces: DataFrame) -> DataFrame:
    """The entries of each list up to its ``MAX_ENTRIES``-th, before anything is joined to them."""
    return seated(aces).where(~F.col("past")).drop("past")


def cut_lists(aces: DataFrame) -> DataFrame:
    """resource_key: lists with more entries than are considered."""
    return aces.groupBy("resource_key").agg(F.count("*").alias("n")).where(F.col("n") > MAX_ENTRIES).select("resource_key")


def ordered_entries() -> Column:
    """Aggregate: a group's entries in evaluation order, generic rights expanded, what does not apply here left out."""
    kept = F.when(applies_here(), F.struct(
        F.coalesce("order_index", F.lit(2**31 - 1)).alias("at"), "ace_key", (F.col("ace_type") == "allow").alias("allow"), masks.expand_generic(F.col("access_mask")).alias("mask")))
    return F.array_sort(F.collect_list(kept))


def fold(entries: Column, owner_rights: Column | None = None) -> Column:
    """granted, denied, allow_union, deny_union of entries in order: an entry adds only what none before it settled."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("granted"), zero.alias("denied"), zero.alias("allowed"), zero.alias("refused"))

    def step(s: Column, e: Column) -> Column:
        gain, loss = masks.minus(e["mask"], s["denied"]), masks.minus(e["mask"], s["granted"])
        return F.struct(
            F.when(e["allow"], s["granted"].bitwiseOR(gain)).otherwise(s["granted"]).alias("granted"), F.when(e["allow"], s["denied"]).otherwise(s["denied"].bitwiseOR(loss)).alias("denied"),
            F.when(e["allow"], s["allowed"].bitwiseOR(e["mask"])).otherwise(s["allowed"]).alias("allowed"), F.when(e["allow"], s["refused"]).otherwise(s["refused"].bitwiseOR(e["mask"])).alias("refused"),
        )

    add = F.coalesce(owner_rights, zero) if owner_rights is not None else zero
    done = lambda s: F.struct(s["granted"].bitwiseOR(add).alias("granted"), s["denied"].alias("denied"), masks.minus(s["allowed"], s["refused"]).bitwiseOR(add).alias("canonical"))
    return F.aggregate(entries, start, step, done)


def contributions(aces: DataFrame, by: list[str]) -> DataFrame:
    """Each entry of a group with what it contributed beyond the entries before it; 'superseded' if nothing."""
    rows = aces.where(F.col("ace_flags").bitwiseAND(masks.INHERIT_ONLY) == 0).withColumn("mask", masks.expand_generic(F.col("access_mask")))
    zero = F.lit(0).cast("long")
    entries = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("order_index", F.lit(2**31 - 1)).alias("at"), "ace_key", "trustee_key", "ace_type", "mask"))).alias("_e"))
    start = F.struct(zero.alias("g"), zero.alias("d"), F.array().cast("array<bigint>").alias("c"))

    def step(s: Column, e: Column) -> Column:
        allow = e["ace_type"] == "allow"
        new = F.when(allow, masks.minus(e["mask"], s["d"])).otherwise(masks.minus(e["mask"], s["g"]))
        return F.struct(F.when(allow, s["g"].bitwiseOR(new)).otherwise(s["g"]).alias("g"), F.when(allow, s["d"]).otherwise(s["d"].bitwiseOR(new)).alias("d"), F.concat(s["c"], F.array(new)).alias("c"))

    each = entries.select(*by, F.explode(F.arrays_zip("_e", F.aggregate("_e", start, step, lambda s: s["c"]).alias("contributed"))).alias("x"))
    contributed = F.col("x.contributed")
    return each.select(*by, "x._e.ace_key", "x._e.trustee_key", "x._e.ace_type", "x._e.mask", contributed.alias("contributed"), F.when(contributed != 0, "applied").otherwise("superseded").alias("effect"))


def findings(resources: DataFrame, aces: DataFrame) -> DataFrame:
    """resource_key, finding: conditions that qualify what a list says."""
    held = aces.groupBy("resource_key").agg(F.count("*").alias("entries"), F.max(F.col("access_mask").bitwiseAND(F.lit(masks.GENERIC)) != 0).alias("generic"))
    rows = resources.join(held, "resource_key", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    named = F.array_compact(F.array(
        F.when(~F.col("dacl_present"), "null_dacl"), F.when(F.col("dacl_present") & (F.col("entries") == 0), "empty_dacl"), F.when(F.col("dacl_protected"), "protected_dacl"),
        F.when(F.col("entries") > MAX_ENTRIES, "acl_truncated"), F.when(F.coalesce("generic", F.lit(False)), "generic_rights_expanded"),
    ))
    return rows.select("resource_key", F.explode(named).alias("finding"))


def order_violations(aces: DataFrame) -> DataFrame:
    """resource_key, ace_key, violation: explicit after inherited, or deny after allow among equals."""
    run = Window.partitionBy("resource_key").orderBy(F.col("order_index").asc_nulls_last(), "ace_key").rowsBetween(Window.unboundedPreceding, -1)
    inherited = F.col("ace_flags").bitwiseAND(masks.INHERITED) != 0
    seen_inherited = F.coalesce(F.max(inherited).over(run), F.lit(False))
    seen_allow = F.coalesce(F.max(~inherited & (F.col("ace_type") == "allow")).over(run), F.lit(False))
    named = F.array_compact(F.array(F.when(~inherited & seen_inherited, "explicit_after_inherited"), F.when(~inherited & (F.col("ace_type") == "deny") & seen_allow, "deny_after_allow")))
    return aces.select("resource_key", "ace_key", named.alias("_v")).select("resource_key", "ace_key", F.explode("_v").alias("violation"))


def projected(aces: DataFrame, container: bool = True) -> DataFrame:
    """What each entry becomes on a child: nothing, one entry, or an effective and a propagating one.

    Keeps resource_key (the parent's), trustee_key, ace_type; order_index is renumbered.
    """
    flags = F.col("ace_flags")
    bit = lambda b: flags.bitwiseAND(b) != 0
    reach = flags.bitwiseAND(masks.OBJECT_INHERIT | masks.CONTAINER_INHERIT)
    split = (F.col("access_mask").bitwiseAND(F.lit(masks.GENERIC)) != 0) | F.col("trustee_key").isin(keys.CREATOR_OWNER, keys.CREATOR_GROUP)
    substituted = F.col("trustee_key").isin(keys.CREATOR_OWNER, keys.CREATOR_GROUP)
    entry = lambda f, m, seat: F.struct(f.cast("int").alias("ace_flags"), m.alias("access_mask"), F.lit(seat).alias("seat"))
    mask, mapped = F.col("access_mask"), masks.expand_generic(F.col("access_mask"))
    if container:
        plain = F.when(bit(masks.CONTAINER_INHERIT), F.when(bit(masks.NO_PROPAGATE), F.lit(masks.INHERITED)).otherwise(reach.bitwiseOR(masks.INHERITED)))
        plain = plain.when(bit(masks.OBJECT_INHERIT) & ~bit(masks.NO_PROPAGATE), F.lit(masks.INHERITED | masks.OBJECT_INHERIT | masks.INHERIT_ONLY))
        copies = F.array(
            F.when(~split & plain.isNotNull(), entry(plain, mask, 0)), F.when(split & bit(masks.CONTAINER_INHERIT) & ~substituted, entry(F.lit(masks.INHERITED), mapped, 0)),
            F.when(split & (reach != 0) & ~bit(masks.NO_PROPAGATE), entry(reach.bitwiseOR(masks.INHERITED | masks.INHERIT_ONLY), mask, 1)),
        )
    else:
        copies = F.array(F.when(~substituted & bit(masks.OBJECT_INHERIT), entry(F.lit(masks.INHERITED), mapped, 0)))
    rows = aces.select("resource_key", "trustee_key", "ace_type", "order_index", "ace_key", F.explode(F.array_compact(copies)).alias("x"))
    seat = F.row_number().over(Window.partitionBy("resource_key").orderBy(F.col("order_index").asc_nulls_last(), "ace_key", "x.seat")) - 1
    return rows.select("resource_key", "trustee_key", "ace_type", "x.access_mask", "x.ace_flags", seat.alias("order_index"))


def normal_line() -> Column:
    """What an entry is in a list's normal form, its place aside."""
    return F.concat_ws("|", "trustee_key", "ace_type", masks.hex_mask(F.col("access_mask")), masks.hex_mask(F.col("ace_flags"), 2))


def digests(resources: DataFrame, aces: DataFrame, version: str = "acl-normal/1") -> DataFrame:
    """resource_key, acl_hash, entries: SHA-256 of a list's normal form, one terminated line for each record.

    Positions become ranks.  Where a position is missing or claimed twice, entries are sorted by content
    and the document says that they are unordered.
    """
    line = normal_line()
    held = aces.groupBy("resource_key").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("order_index", F.lit(-1)).alias("at"), line.alias("line")))).alias("_o"), F.array_sort(F.collect_list(line)).alias("_u"),
        (F.count("order_index") == F.count("*")).alias("_all"), (F.count_distinct("order_index") == F.count("order_index")).alias("_once"),
    )
    rows = resources.select("resource_key", "dacl_present", "dacl_protected").join(held, "resource_key", "left")
    none, observed = F.array().cast("array<string>"), F.coalesce(F.col("_all") & F.col("_once"), F.lit(True))
    ranked = F.transform("_o", lambda x, i: F.concat(F.lit("ace="), i.cast("string"), F.lit("|"), x["line"]))
    plain = F.transform("_u", lambda x: F.concat(F.lit("ace=-|"), x))
    flag = lambda c: F.when(F.col(c), "true").otherwise("false")
    head = F.array(F.lit(version), F.concat(F.lit("dacl_present="), flag("dacl_present")), F.concat(F.lit("dacl_protected="), flag("dacl_protected")), F.concat(F.lit("order="), F.when(observed, "observed").otherwise("unordered")))
    lines = F.concat(head, F.coalesce(F.when(observed, ranked).otherwise(plain), none))
    return rows.select("resource_key", F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("acl_hash"), F.coalesce(F.size("_u"), F.lit(0)).alias("entries"))


def boundaries(resources: DataFrame, aces: DataFrame) -> DataFrame:
    """resource_key, boundary_reason: null means that the list is just what the parent hands down."""
    own = digests(resources, aces).select("resource_key", "acl_hash")
    parents = resources.select(F.col("resource_key").alias("parent_key"), F.col("dacl_present").alias("parent_present"))
    shown = resources.select("resource_key", F.lit(True).alias("dacl_present"), F.lit(False).alias("dacl_protected"))
    handed = digests(shown, projected(aces)).select(F.col("resource_key").alias("parent_key"), F.col("acl_hash").alias("handed_down"))
    rows = resources.join(own, "resource_key").join(parents, "parent_key", "left").join(handed, "parent_key", "left")
    reason = (
        F.when(F.col("dacl_protected"), "protected_dacl").when(~F.col("dacl_present"), "null_dacl").when(F.col("parent_key").isNull(), "share_root").when(F.col("parent_present").isNull(), "parent_unreadable")
        .when(~F.col("parent_present"), "parent_null_dacl").when(F.col("handed_down").isNull(), "parent_unreadable").when(F.col("acl_hash") != F.col("handed_down"), "acl_differs_from_parent")
    )
    return rows.select("resource_key", reason.alias("boundary_reason"))


def digest_checks(resources: DataFrame, aces: DataFrame, reported: DataFrame) -> DataFrame:
    """resource_key, digest_agrees, count_agrees from reported (resource_key, acl_hash, ace_count), recomputed from the entries; null where nothing was reported."""
    own = digests(resources, aces).select("resource_key", F.col("acl_hash").alias("own_hash"), F.col("entries").alias("own_count"))
    rows = own.join(reported.select("resource_key", "acl_hash", "ace_count"), "resource_key", "left")
    return rows.select("resource_key", (F.col("acl_hash") == F.col("own_hash")).alias("digest_agrees"), (F.col("ace_count") == F.col("own_count")).alias("count_agrees"))


def reprotected(aces: DataFrame, resources: DataFrame, keep: bool) -> DataFrame:
    """The entries of lists whose inheritance is switched off: handed-down ones become the list's own, or go."""
    down = F.col("ace_flags").bitwiseAND(masks.INHERITED) != 0
    named = aces.join(resources.select("resource_key"), "resource_key", "left_semi")
    if not keep:
        return named.where(~down)
    flags = F.when(down, F.col("ace_flags") - masks.INHERITED).otherwise(F.col("ace_flags"))
    return named.withColumn("ace_flags", flags.cast("int")).withColumn("ace_key", keys.ntfs_ace_key(F.col("resource_key"), F.col("trustee_key"), F.col("ace_type"), F.col("access_mask"), F.col("ace_flags")))
