"""What-if: changes laid over an estate, and the difference that they make.

An overlay only builds another ``Estate``; nothing is changed in place, and every operator runs on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions import keys, masks
from reachbase.functions.tables import cut
from reachbase.operators import access, acl
from reachbase.plans.estate import Estate


def with_edges(e: Estate, removed: DataFrame | None = None, added: DataFrame | None = None) -> Estate:
    edges = e.edges if removed is None else e.edges.join(removed, ["group_key", "member_key"], "left_anti")
    if added is not None:
        new = added.join(edges, ["group_key", "member_key"], "left_anti").select("group_key", "member_key", F.lit("planned").alias("edge_kind"))
        edges = edges.unionByName(new)
    return e.with_(edges=edges)


def touched_lists(aces: DataFrame, removed: DataFrame | None = None, modified: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """resource_key: the lists that a plan says anything about."""
    named = [rows.select("ace_key") for rows in (removed, modified) if rows is not None]
    out = [added.select("resource_key")] if added is not None else []
    if named:
        keys_ = named[0] if len(named) == 1 else named[0].union(named[1])
        out.append(aces.join(keys_.distinct(), "ace_key", "left_semi").select("resource_key"))
    return (out[0] if len(out) == 1 else out[0].union(out[1])).distinct()


def changed_entries(aces: DataFrame, removed: DataFrame | None = None, modified: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """Removes by ace_key, sets masks by (ace_key, new_mask), adds rows; then renumbers each list.

    A new entry goes where canonical order puts it: explicit before inherited, denials first.
    """
    if removed is not None:
        aces = aces.join(removed.select("ace_key").distinct(), "ace_key", "left_anti")
    if modified is not None:
        aces = aces.join(modified.select("ace_key", "new_mask"), "ace_key", "left").withColumn("access_mask", F.coalesce("new_mask", "access_mask")).drop("new_mask")
    if added is not None:
        aces = aces.unionByName(added.withColumn("order_index", F.lit(None).cast("int")), allowMissingColumns=True)
    band = F.when(F.col("ace_flags").bitwiseAND(masks.INHERITED) != 0, 2).when(F.col("ace_type") == "deny", 0).otherwise(1)
    known = F.when(F.col("order_index").isNull(), band)
    last = F.max(F.when(band <= 0, F.col("order_index"))).over(Window.partitionBy("resource_key"))
    place = F.coalesce(F.col("order_index").cast("double"), F.when(known == 0, F.lit(-0.5)).when(known == 1, F.coalesce(last, F.lit(-1)) + 0.5).otherwise(F.lit(1e9)))
    seat = F.row_number().over(Window.partitionBy("resource_key").orderBy("_place", "ace_key")) - 1
    return aces.withColumn("_place", place).withColumn("order_index", seat).drop("_place")


def with_entries(e: Estate, removed: DataFrame | None = None, modified: DataFrame | None = None, added: DataFrame | None = None) -> Estate:
    """The estate with ``changed_entries`` in the lists that the plan touches; other lists are not renumbered."""
    there = touched_lists(e.ntfs_aces, removed, modified, added)
    changed = changed_entries(e.ntfs_aces.join(there, "resource_key", "left_semi"), removed, modified, added)
    return e.with_(ntfs_aces=e.ntfs_aces.join(there, "resource_key", "left_anti").unionByName(changed.select(*e.ntfs_aces.columns)))


def with_shares(e: Estate, removed: DataFrame | None = None, modified: DataFrame | None = None, added: DataFrame | None = None) -> Estate:
    """Share entries removed by ace_key, given another permission by (ace_key, new_permission), or added.

    A share that loses its last entry is a share that lets nobody in and not one that nobody read: it gets a denial of
    the identifier that stands for no one.
    """
    aces = e.share_aces if removed is None else e.share_aces.join(removed.select("ace_key").distinct(), "ace_key", "left_anti")
    if modified is not None:
        aces = aces.join(modified.select("ace_key", "new_permission"), "ace_key", "left").withColumn("permission", F.coalesce("new_permission", "permission")).drop("new_permission")
    if added is not None:
        aces = aces.unionByName(added.select(*aces.columns))
    bare = e.share_aces.select("share_key").distinct().join(aces.select("share_key").distinct(), "share_key", "left_anti")
    closed = bare.select("share_key", F.lit(keys.NOBODY).alias("trustee_key"), F.lit("deny").alias("ace_type"), F.lit("full").alias("permission"))
    closed = closed.withColumn("ace_key", keys.share_ace_key(F.col("share_key"), F.col("trustee_key"), F.col("ace_type"), F.col("permission")))
    return e.with_(share_aces=aces.unionByName(closed.select(*aces.columns)))


def with_protection(e: Estate, changes: DataFrame) -> Estate:
    """Lists whose inheritance is switched: (resource_key, protected, keep).

    Protected: entries handed down become the list's own (keep) or go.  Cleared: what the parent hands down now, by its
    own planned-for list, goes behind the explicit entries; where the parent's list is not read, entries stay as they are.
    """
    aces, own = e.ntfs_aces, e.ntfs_aces.columns
    asked = aces.join(changes, "resource_key")
    down = F.col("ace_flags").bitwiseAND(masks.INHERITED) != 0
    protected = asked.where("protected").where(~down | F.col("keep"))
    flags = F.when(down, F.col("ace_flags") - masks.INHERITED).otherwise(F.col("ace_flags")).cast("int")
    renamed = protected.withColumn("ace_flags", flags).withColumn("ace_key", keys.ntfs_ace_key(F.col("resource_key"), F.col("trustee_key"), F.col("ace_type"), F.col("access_mask"), F.col("ace_flags")))
    cleared = changes.where("NOT protected").select("resource_key").join(e.resources.select("resource_key", "parent_key"), "resource_key")
    read = cleared.join(aces.select(F.col("resource_key").alias("parent_key")).distinct(), "parent_key", "left_semi")
    parents = aces.join(read.select(F.col("parent_key").alias("resource_key")).distinct(), "resource_key", "left_semi")
    handed = acl.projected(parents).withColumnRenamed("resource_key", "parent_key").join(read, "parent_key").withColumn("order_index", F.col("order_index") + 2**20)
    handed = handed.withColumn("ace_key", keys.ntfs_ace_key(F.col("resource_key"), F.col("trustee_key"), F.col("ace_type"), F.col("access_mask"), F.col("ace_flags")))
    explicit = asked.where("NOT protected").join(read.select("resource_key", F.lit(True).alias("read")), "resource_key", "left").where(~down | F.col("read").isNull())
    changed = renamed.select(*own).unionByName(explicit.select(*own)).unionByName(handed.select(*own))
    # Two entries of a list that became equal are one.
    changed = changed.groupBy("resource_key", "ace_key").agg(*[F.min_by(c, F.coalesce("order_index", F.lit(2**31 - 1))).alias(c) for c in own if c not in ("resource_key", "ace_key")]).select(*own)
    seat = F.row_number().over(Window.partitionBy("resource_key").orderBy(F.col("order_index").asc_nulls_last(), "ace_key")) - 1
    there = changes.select("resource_key").distinct()
    flag = e.resources.join(changes.select("resource_key", F.col("protected").alias("_p")), "resource_key", "left").withColumn("dacl_protected", F.coalesce("_p", "dacl_protected")).drop("_p")
    return e.with_(ntfs_aces=aces.join(there, "resource_key", "left_anti").unionByName(changed.withColumn("order_index", seat)), resources=flag)


#: What a plan's change comes to on the estate as it is.
OUTCOMES = ("applied", "already_present", "already_absent", "mask_unchanged", "target_unknown", "repeated")


def applicability(e: Estate, plan: DataFrame) -> DataFrame:
    """change_no, outcome for a plan (change_no, action, target, member, value).

    Actions and their targets: remove_entry and modify_entry (an ace_key; value is the new mask), add_entry (ace_key of the new entry; member is its list),
    remove_member and add_member (a group; member).  Of changes that say the same, the first counts and the others are repeated.
    """
    same = Window.partitionBy("action", "target", "member").orderBy("change_no")
    digest = lambda rows, keys_, *more: rows.select(*[access.list_id(key).alias(c) for key, c in keys_], *more)
    # Keys travel as digests.  A change meets only the tables that its action asks for, and is dealt once by what it names.
    slim = plan.select("change_no", "action", access.list_id("target").alias("target"), access.list_id("member").alias("member"), "value")
    entries = digest(e.ntfs_aces, [("ace_key", "target")], "access_mask", F.lit(True).alias("entry"))
    lists = digest(e.resources, [("resource_key", "member")], F.lit(True).alias("list"))
    pairs = digest(e.edges, [("group_key", "target"), ("member_key", "member")], F.lit(True).alias("edge")).distinct()
    described = lambda c: digest(e.principals, [("principal_key", c)])
    no = lambda kind, *columns: [F.lit(None).cast(kind).alias(c) for c in columns]
    on_entry = F.coalesce(F.col("action").isin("remove_entry", "modify_entry", "add_entry"), F.lit(False))

    about = slim.where(on_entry).repartition("target").withColumn("seat", F.row_number().over(same)).join(entries, "target", "left")
    adds = about.where("action = 'add_entry'").join(lists, "member", "left")
    about = about.where("action <> 'add_entry'").withColumn("list", F.lit(None).cast("boolean")).unionByName(adds)
    about = about.select("change_no", "action", "seat", "value", "access_mask", "entry", "list", *no("boolean", "edge", "group", "who"))
    others = slim.where(~on_entry).repartition("target", "member").withColumn("seat", F.row_number().over(same)).join(pairs, ["target", "member"], "left")
    groups = cut(described("target").join(slim.where(~on_entry).select("target").distinct(), "target", "left_semi").withColumn("group", F.lit(True)))
    others = others.join(groups, "target", "left").join(described("member").withColumn("who", F.lit(True)), "member", "left")
    rows = about.unionByName(others.select("change_no", "action", "seat", "value", *no("long", "access_mask"), *no("boolean", "entry", "list"), "edge", "group", "who"))
    is_ = lambda c: F.col(c).isNotNull()
    action = F.col("action")
    outcome = (
        F.when(F.col("seat") > 1, "repeated")
        .when(action.isin("add_member", "remove_member") & (~is_("group") | ~is_("who")), "target_unknown").when(action == "add_member", F.when(is_("edge"), "already_present").otherwise("applied"))
        .when(action == "remove_member", F.when(is_("edge"), "applied").otherwise("already_absent")).when(action == "remove_entry", F.when(is_("entry"), "applied").otherwise("already_absent"))
        .when(action == "modify_entry", F.when(~is_("entry"), "target_unknown").when(F.col("access_mask") == F.col("value"), "mask_unchanged").otherwise("applied"))
        .when(action == "add_entry", F.when(~is_("list"), "target_unknown").when(is_("entry"), "already_present").otherwise("applied"))
    )
    return rows.select("change_no", outcome.alias("outcome"))


def affected_resources(e: Estate, lists: DataFrame, max_depth: int | None = None) -> DataFrame:
    """resource_key, distance: the lists a plan touches (resource_key) and what inherits from them: everything below, down to a list that is protected or missing.

    Resources find the touched lists above them through their own paths, so a subtree is never walked.
    """
    own = e.resources.select("resource_key", "dacl_protected", "dacl_present")
    above = own.select("resource_key", F.explode(keys.ancestors(F.col("resource_key"))).alias("a")).select("resource_key", "a.distance", F.col("a.key").alias("source"))
    if max_depth is not None:
        above = above.where(F.col("distance") <= max_depth)
    stops = own.where(F.col("dacl_protected") | ~F.col("dacl_present")).select(F.col("resource_key").alias("source"), F.lit(True).alias("stops"))
    nearest = above.join(stops, "source").groupBy("resource_key").agg(F.min("distance").alias("wall"))
    hit = above.join(lists.select(F.col("resource_key").alias("source")).distinct(), "source")
    # The wall itself hands down its own list, so a touched list at the wall still counts.
    reached = hit.join(nearest, "resource_key", "left").where(F.col("wall").isNull() | (F.col("distance") <= F.col("wall"))).join(own.where("dacl_present AND NOT dacl_protected"), "resource_key", "left_semi")
    direct = own.join(lists.select("resource_key").distinct(), "resource_key", "left_semi").select("resource_key", F.lit(0).alias("distance"))
    return reached.select("resource_key", "distance").unionByName(direct).groupBy("resource_key").agg(F.min("distance").alias("distance"))


def direction(before: Column, after: Column) -> Column:
    gained, lost = masks.minus(after, before), masks.minus(before, after)
    return (
        F.when((before == 0) & (after != 0), "gain").when((before != 0) & (after == 0), "lose").when((gained != 0) & (lost != 0), "change").when(gained != 0, "expand").when(lost != 0, "reduce").otherwise("same")
    )


def entry_impact(e: Estate, planned: Estate, touched: DataFrame | None = None) -> DataFrame:
    """class_key, resource_key, before, after, direction: only on lists that the plan touches.

    ``touched`` (resource_key) names those lists where the plan knows them; else they are found by comparing
    all.  Classes come from the trustees of both estates, so one principal has one class on either side.
    """
    if touched is None:
        # Equal lists have equal sums of hashes, whatever the order of their entries in the tables.
        mark = lambda x, name: x.ntfs_aces.groupBy("resource_key").agg(F.sum(F.xxhash64("ace_key", "access_mask", "order_index").cast("decimal(38,0)")).alias(name), F.count("*").alias(f"n_{name}"))
        both = mark(e, "was").join(mark(planned, "now"), "resource_key", "full_outer")
        touched = both.where(~F.col("was").eqNullSafe(F.col("now")) | ~F.col("n_was").eqNullSafe(F.col("n_now"))).select("resource_key")
    touched = cut(touched)
    now, then = (cut(x.ntfs_aces.join(touched, "resource_key", "left_semi")) for x in (e, planned))
    trustees = e.ntfs_aces.select("trustee_key").union(planned.ntfs_aces.select("trustee_key")).union(e.share_aces.select("trustee_key"))
    _, members = access.classes(access.tokens(e), cut(trustees.distinct()))
    # Both plans are layers of one list, so before and after meet where the list lies.
    entries = access.list_entries(now).unionByName(access.list_entries(then, 1))
    names = touched.select("resource_key").distinct().withColumn("list", access.list_id())
    said = [F.col("granted_now").alias("before"), F.col("granted_then").alias("after"), direction(F.col("granted_now"), F.col("granted_then")).alias("direction")]
    named = lambda rows, *more: rows.join(names, "list").select(*more, "resource_key", *said)
    shared, single, of = access.rights_by_base(members, entries, ("now", "then"), named)
    return access.opened(access.by_base(shared), single, of, "resource_key", "before", "after", "direction")


def membership_impact(e: Estate, planned: Estate) -> DataFrame:
    """principal_key, gained, lost: groups held after and not before, and the other way round."""
    now, then = (access.tokens(x).where("origin = 'membership'").groupBy("principal_key").agg(F.collect_set("sid").alias(n)) for x, n in ((e, "before"), (planned, "after")))
    none = F.array().cast("array<string>")
    both = now.join(then, "principal_key", "full_outer").withColumns({"before": F.coalesce("before", none), "after": F.coalesce("after", none)})
    out = both.select("principal_key", F.array_sort(F.array_except("after", "before")).alias("gained"), F.array_sort(F.array_except("before", "after")).alias("lost"))
    return out.where((F.size("gained") > 0) | (F.size("lost") > 0))


def narrows(old: Column, new: Column) -> Column:
    """A change to an entry that takes rights away and gives none."""
    return (masks.minus(new, old) == 0) & (new != old)
