"""Why a principal has the rights it has: what each entry and membership gives, and what would be left without it.

An entry decides a bit of the mask only if no entry before it in the list has that bit.  So, bit by bit, the first entry
decides and the second one takes its place when the first is removed: two neighbours in one window answer for every
entry of a list at once, in place of as many evaluations as it has entries.  A membership takes all entries with it
whose trustees it alone leads to; where it leads to none, nothing changes and nothing is evaluated.

Every function takes pairs (principal_key, resource_key) and reads only their lists and tokens.  Access is remote:
the token holds NETWORK, and the share's rights bound those of the list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions import keys, masks
from reachbase.functions.tables import cut
from reachbase.operators import access, acl
from reachbase.operators.graph import closure, expand
from reachbase.plans.estate import Estate

PAIR = ["principal_key", "resource_key"]
#: Edges of an explanation that a change can take away, by kind.
REMOVABLE = ("membership", "ntfs_ace", "share_ace")


def _spoken(estate: Estate, pairs: DataFrame, *about: DataFrame) -> DataFrame:
    """One row for each pair, with what ``about`` (principal_key, ...) adds: ``on_list`` and ``on_share``, the entries that speak to it in order (at, ace_key, trustee_key, origin, allow, mask), and own, ntfs, share, rights, denied.

    A list travels as one row of entries; a pair meets it, and then the token of its kind, in its own row, and what is asked of a pair is
    answered there, so neither tokens nor the entries that speak to pairs are shuffled or written for each pair.
    """
    more = [c for rows in about for c in rows.columns if c != "principal_key"]
    asked = cut(pairs.select(*PAIR).distinct())
    where = asked.select("resource_key").distinct()
    of, held_by = access.tokens_by_kind(estate, asked.select("principal_key").distinct())
    zero, total = F.lit(0).cast("long"), F.lit(masks.FILE_ALL).cast("long")
    at = lambda order: F.struct(order.alias("order_index"), F.col("ace_key")).alias("at")
    entry = lambda order, mask, to_owner: F.struct(at(order), "trustee_key", (F.col("ace_type") == "allow").alias("allow"), F.coalesce(mask, zero).alias("mask"), to_owner.alias("to_owner"))
    to_owner = keys.sid_of(F.col("trustee_key")) == keys.OWNER_RIGHTS
    lists = access.on_lists(acl.considered(estate.ntfs_aces).where(acl.applies_here()), where, entry(F.coalesce("order_index", F.lit(2**31 - 1)), masks.expand_generic(F.col("access_mask")), to_owner))
    # Denials of a share go before what it allows.
    rank = F.when(F.col("ace_type") == "deny", 0).otherwise(1)
    shares = cut(estate.share_aces.groupBy("share_key").agg(F.array_sort(F.collect_list(entry(rank, masks.share_mask(F.col("permission")), F.lit(False)))).alias("allowances")))
    on = estate.resources.join(where, "resource_key", "left_semi").select("resource_key", "share_key", "dacl_present", "owner_key").join(lists, "resource_key", "left")
    rows = asked.join(of, "principal_key", "left")
    for extra in about:
        rows = rows.join(extra, "principal_key", "left")
    rows = rows.join(on, "resource_key").join(shares, "share_key", "left").join(held_by, "kind", "left")
    # Access is remote; a token names an identifier once, and what it is assumed to hold after what it holds.
    holds = lambda sid, origin: F.array(F.struct(sid.alias("sid"), F.lit(origin).alias("origin")))
    beside = F.concat(holds(F.col("principal_key"), "subject"), F.filter("token", lambda t: t["sid"] != F.col("principal_key")))
    rows = rows.withColumn("token", F.concat(holds(F.lit(keys.NETWORK), "assumed"), F.coalesce(beside, F.array().cast(rows.schema["token"].dataType))))
    empty = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    rows = rows.withColumns({"entries": empty("entries"), "read": F.col("allowances").isNotNull(), "allowances": empty("allowances")})
    rows = rows.withColumn("owns", F.exists("token", lambda t: F.coalesce(t["sid"] == F.col("owner_key"), F.lit(False))))
    held = lambda e: F.exists("token", lambda t: t["sid"] == e["trustee_key"])
    origin = lambda e: F.coalesce(F.get(F.filter("token", lambda t: t["sid"] == e["trustee_key"]), F.lit(0))["origin"], F.lit("owner"))
    shown = lambda es, test: F.transform(F.filter(es, test), lambda e: F.struct(e["at"].alias("at"), e["at"]["ace_key"].alias("ace_key"), e["trustee_key"].alias("trustee_key"), origin(e).alias("origin"), e["allow"].alias("allow"), e["mask"].alias("mask")))
    rows = rows.withColumns({"on_list": shown("entries", lambda e: F.col("dacl_present") & (held(e) | (e["to_owner"] & F.col("owns")))), "on_share": shown("allowances", held), "restated": F.exists("entries", lambda e: e["to_owner"])})
    rows = rows.select(*PAIR, *more, "on_list", "on_share", "read", "dacl_present", F.when(F.col("owns") & ~F.col("restated"), F.lit(access.OWNER_BITS).cast("long")).otherwise(zero).alias("own"), acl.fold(F.col("on_list")).alias("l"), acl.fold(F.col("on_share")).alias("s"))
    ntfs, share = F.when(F.col("dacl_present"), F.col("l.granted")).otherwise(total).bitwiseOR(F.col("own")), F.when(F.col("read"), F.col("s.granted"))
    return rows.select(*PAIR, *more, "on_list", "on_share", "own", ntfs.alias("ntfs"), share.alias("share"), _crossed(ntfs, share).alias("rights"), F.col("l.denied").alias("denied"))


def evidence(estate: Estate, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries that speak to each pair, and each pair's rights.

    Entries: principal_key, resource_key, layer (ntfs, share), ace_key, trustee_key, origin, at, allow, mask.  Pairs: ntfs and
    share rights, owner bits, rights (both layers crossed; an unread share does not bound them), denied.
    """
    spoken = cut(_spoken(estate, pairs))
    side = lambda es, layer: spoken.select(*PAIR, F.lit(layer).alias("layer"), F.explode(es).alias("e"))
    entries = side("on_list", "ntfs").unionByName(side("on_share", "share")).select(*PAIR, "layer", "e.ace_key", "e.trustee_key", "e.origin", "e.at", "e.allow", "e.mask")
    return entries, spoken.drop("on_list", "on_share")


def _crossed(ntfs: Column, share: Column) -> Column:
    return F.when(share.isNull(), ntfs).otherwise(ntfs.bitwiseAND(share))


def _without_each(es: str, kind: str, lost_of, won_of) -> Column:
    """array(kind, edge_key, lost, won): what goes and comes when each entry of the array ``es`` is gone, one at a time."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    # What each entry settles, and the bits that those behind it would allow: one walk from either end.
    settles = F.aggregate(es, F.struct(zero.alias("seen"), none.alias("out")), lambda s, e: F.struct(s["seen"].bitwiseOR(e["mask"]).alias("seen"), F.concat(s["out"], F.array(masks.minus(e["mask"], s["seen"]))).alias("out")), lambda s: s["out"])
    then = lambda s, e: F.when(e["allow"], s["then"].bitwiseOR(e["mask"])).otherwise(masks.minus(s["then"], e["mask"]))
    behind = F.aggregate(F.reverse(es), F.struct(zero.alias("then"), none.alias("out")), lambda s, e: F.struct(then(s, e).alias("then"), F.concat(F.array(s["then"]), s["out"]).alias("out")), lambda s: s["out"])

    def effect(x: Column) -> Column:
        lost, won = F.when(x["e"]["allow"], masks.minus(x["novel"], x["behind"])).otherwise(zero), F.when(x["e"]["allow"], zero).otherwise(x["novel"].bitwiseAND(x["behind"]))
        return F.struct(F.lit(kind).alias("kind"), x["e"]["ace_key"].alias("edge_key"), lost_of(lost).alias("lost"), won_of(won).alias("won"))

    return F.transform(F.arrays_zip(F.col(es).alias("e"), settles.alias("novel"), behind.alias("behind")), effect)


def _entry_effects() -> Column:
    """array(kind, edge_key, lost, won) of a row of ``_spoken``: each entry that speaks to the pair gone, one at a time."""
    # An owner's own bits stay whatever the list says; the other layer bounds both ways.
    by_share, by_list = lambda c: _crossed(masks.minus(c, F.col("own")), F.col("share")), lambda c: c.bitwiseAND(F.col("ntfs"))
    return F.concat(_without_each("on_list", "ntfs_ace", by_share, by_share), _without_each("on_share", "share_ace", by_list, by_list))


def _membership_effects() -> Column:
    """The same for each of the row's ``ways`` (see ``_ways``) that leads to a trustee which speaks to the pair."""
    every = F.concat("on_list", "on_share")

    def effect(w: Column) -> Column:
        gone = lambda e: (e["origin"] == "membership") & F.array_contains(w["lost"], e["trustee_key"])
        left = lambda es: acl.fold(F.filter(es, lambda e: ~gone(e)))["granted"]
        # A list that has no entry for the pair (a missing list, say) gives what it gave; and only where an entry goes with the membership is anything evaluated.
        ntfs = F.when(F.size("on_list") > 0, left("on_list").bitwiseOR(F.col("own"))).otherwise(F.col("ntfs"))
        then = F.when(F.exists(every, gone), _crossed(ntfs, F.when(F.col("share").isNotNull(), left("on_share")))).otherwise(F.col("rights"))
        edge = keys.edge_key(w["group_key"], F.coalesce(w["member_key"], F.col("principal_key")), F.lit("*"))
        return F.struct(F.lit("membership").alias("kind"), edge.alias("edge_key"), masks.minus(F.col("rights"), then).alias("lost"), masks.minus(then, F.col("rights")).alias("won"))

    speaks = lambda w: F.exists(every, lambda e: (e["origin"] == "membership") & F.array_contains(w["leads"], e["trustee_key"]))
    return F.transform(F.filter("ways", speaks), effect)


def _effects(rows: DataFrame) -> DataFrame:
    after = masks.minus(F.col("rights"), F.col("lost")).bitwiseOR(F.col("won"))
    return rows.select(*PAIR, "kind", "edge_key", F.col("lost").alias("rights_removed"), F.col("won").alias("rights_added"), after.alias("rights_after"), ((F.col("rights") != 0) & (after == 0)).alias("revokes_all"))


def surviving(edges: DataFrame, principals: DataFrame) -> DataFrame:
    """principal_key, group_key, member_key, lost: for each membership on a principal's way up, a group that it alone leads to."""
    of, first = access.kinds(edges, principals)
    walked = _walked(access.edges_above(edges, first), first.select(F.col("first").alias("principal_key"))).withColumnRenamed("principal_key", "first").join(first, "first")
    member = F.when(F.col("member_key") == F.col("first"), F.col("principal_key")).otherwise(F.col("member_key"))
    return of.join(cut(walked), "kind").select("principal_key", "group_key", member.alias("member_key"), "lost")


def _ways(edges: DataFrame, principals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(principal_key, kind) and (kind, ways): the memberships on the way up of each kind, array(group_key, member_key, leads, lost).

    ``member_key`` is null for the principal's own; ``leads`` are the groups that the membership leads to, ``lost`` those that it alone leads to.
    """
    of, first = access.kinds(edges, principals)
    edges = access.edges_above(edges, first)
    reach = cut(closure(edges).select("member_key", "group_key"))
    up = first.select("kind", "first", F.col("first").alias("at")).unionByName(reach.join(first, F.col("member_key") == F.col("first")).select("kind", "first", F.col("group_key").alias("at"))).distinct()
    on_way = cut(up.join(edges.select(F.col("member_key").alias("at"), "group_key").distinct(), "at").select("kind", "first", "group_key", F.col("at").alias("member_key")))
    groups = on_way.select("group_key").distinct()
    leads = reach.join(groups.withColumnRenamed("group_key", "member_key"), "member_key", "left_semi").select(F.col("member_key").alias("group_key"), F.col("group_key").alias("far")).unionByName(groups.withColumn("far", F.col("group_key")))
    leads = cut(leads.groupBy("group_key").agg(F.collect_set("far").alias("leads")))
    lost = _walked(edges, first.select(F.col("first").alias("principal_key"))).withColumnRenamed("principal_key", "first").groupBy("first", "group_key", "member_key").agg(F.collect_set("lost").alias("lost"))
    rows = on_way.join(leads, "group_key").join(lost, ["first", "group_key", "member_key"], "left")
    way = F.struct("group_key", F.when(F.col("member_key") != F.col("first"), F.col("member_key")).alias("member_key"), "leads", F.coalesce("lost", F.array().cast("array<string>")).alias("lost"))
    return of, cut(rows.groupBy("kind").agg(F.collect_list(way).alias("ways")))


def _walked(edges: DataFrame, principals: DataFrame) -> DataFrame:
    step = cut(edges.select(F.col("member_key").alias("at"), F.col("group_key").alias("to")).distinct())
    who = principals.select(F.col("principal_key").alias("key")).distinct()
    reached, _ = expand(edges, who, False, None, None, None)
    reached = cut(reached.select(F.col("root").alias("principal_key"), "key").unionByName(who.select(F.col("key").alias("principal_key"), "key")).distinct())
    own = cut(reached.join(step, F.col("key") == F.col("at")).select("principal_key", F.col("to").alias("group_key"), F.col("at").alias("member_key")))
    frontier = known = cut(own.withColumn("at", F.col("principal_key")))
    while not frontier.isEmpty():
        further = frontier.join(step, "at").where((F.col("at") != F.col("member_key")) | (F.col("to") != F.col("group_key"))).select("principal_key", "group_key", "member_key", F.col("to").alias("at")).distinct()
        frontier = cut(further.join(known, ["principal_key", "group_key", "member_key", "at"], "left_anti"))
        known = known.unionByName(frontier)
    everything = own.join(reached.where("key <> principal_key"), "principal_key").withColumnRenamed("key", "at")
    return everything.join(known, ["principal_key", "group_key", "member_key", "at"], "left_anti").withColumnRenamed("at", "lost")


def entry_removals(entries: DataFrame, rights: DataFrame) -> DataFrame:
    """PAIR, kind, edge_key, rights_removed, rights_added, rights_after, revokes_all from ``evidence``: each entry that speaks to a pair gone, one at a time."""
    entry = F.struct("at", "ace_key", "trustee_key", "origin", "allow", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    side = lambda layer: F.array_sort(F.collect_list(F.when(F.col("layer") == layer, entry)))
    rows = entries.groupBy(*PAIR).agg(side("ntfs").alias("on_list"), side("share").alias("on_share")).join(rights, PAIR)
    return _effects(rows.select(*PAIR, "rights", F.explode(_entry_effects()).alias("x")).select(*PAIR, "rights", "x.*"))


def measured_removals(estate: Estate, pairs: DataFrame) -> DataFrame:
    """PAIR, kind, edge_key, rights_removed, rights_added, rights_after, revokes_all for every entry and membership that a pair's access runs through, each gone, one at a time."""
    of, ways = _ways(estate.edges, pairs)
    rows = _spoken(estate, pairs, of.withColumnRenamed("kind", "way")).join(ways.withColumnRenamed("kind", "way"), "way", "left")
    rows = rows.withColumn("ways", F.coalesce("ways", F.array().cast(ways.schema["ways"].dataType)))
    each = rows.select(*PAIR, "rights", F.explode(F.concat(_entry_effects(), _membership_effects())).alias("x"))
    return _effects(each.select(*PAIR, "rights", "x.*"))


def path_effects(entries: DataFrame, rights: DataFrame) -> DataFrame:
    """PAIR, layer, ace_key, trustee_key, relation, novel, delivered, constrained, effect; ownership is an entry of its own with the principal as trustee.

    Novel is what no entry before settled.  An entry without any is redundant; one whose novel bits the other layer
    all withholds is constrained; others contribute.
    """
    spot = Window.partitionBy(*PAIR, "layer").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    settled = F.coalesce(F.bit_or("mask").over(spot), F.lit(0).cast("long"))
    rows = entries.select(*PAIR, "layer", "ace_key", "trustee_key", F.when(F.col("allow"), "grant").otherwise("deny").alias("relation"), masks.minus(F.col("mask"), settled).alias("novel"))
    own = rights.where("own <> 0").select(*PAIR, F.lit("ntfs").alias("layer"), F.lit(None).cast("string").alias("ace_key"), F.col("principal_key").alias("trustee_key"), F.lit("grant").alias("relation"), F.col("own").alias("novel"))
    rows = rows.unionByName(own).join(rights.select(*PAIR, "ntfs", "share"), PAIR)
    other = F.when(F.col("share").isNull(), F.lit(masks.FULL_32).cast("long")).when(F.col("layer") == "ntfs", F.col("share")).otherwise(F.col("ntfs"))
    delivered, constrained = F.col("novel").bitwiseAND(other), masks.minus(F.col("novel"), other)
    effect = F.when(F.col("novel") == 0, "redundant").when((delivered == 0) & (constrained != 0), "constrained").otherwise("contributes")
    return rows.select(*PAIR, "layer", "ace_key", "trustee_key", "relation", "novel", delivered.alias("delivered"), constrained.alias("constrained"), effect.alias("effect"))


def explanation(estate: Estate, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed nodes (PAIR, node, kind) and edges (PAIR, kind, source, target, edge_key, effect) that lead from each principal to its resource.

    Memberships run from member to group along a shortest way to each trustee, trustee edges from a trustee to its
    entry, entry edges from the entry to the list or share, ownership from the principal to the list, and the share
    leads to the resource.  Identifiers are the keys themselves, so two runs give the same graph.
    """
    entries, rights = evidence(estate, pairs)
    effects = cut(path_effects(entries, rights))
    who = entries.where("origin = 'membership'").select(F.col("principal_key").alias("key")).distinct()
    ways, _ = expand(estate.edges, who, False, None, None, None)
    used = entries.where("origin = 'membership'").select(*PAIR, "trustee_key").distinct()
    hops = used.join(ways.select(F.col("root").alias("principal_key"), F.col("key").alias("trustee_key"), "path"), ["principal_key", "trustee_key"])
    hops = hops.select(*PAIR, F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("m"), F.slice("path", F.lit(2), F.size("path")).alias("g"))).alias("x")).select(*PAIR, F.col("x.m").alias("m"), F.col("x.g").alias("g")).distinct()
    node = lambda prefix, key: F.concat(F.lit(f"{prefix}:"), key)
    place = F.when(F.col("layer") == "ntfs", node("resource", F.col("resource_key"))).otherwise(node("share_of", F.col("resource_key")))
    listed = effects.where("ace_key IS NOT NULL").withColumns({"entry": node("entry", F.col("ace_key")), "place": place})
    none = F.lit(None).cast("string")
    edges = hops.select(*PAIR, F.lit("membership").alias("kind"), node("principal", F.col("m")).alias("source"), node("principal", F.col("g")).alias("target"), keys.edge_key(F.col("g"), F.col("m"), F.lit("*")).alias("edge_key"), none.alias("effect"))
    assumed = entries.where("origin = 'assumed'").select(*PAIR, "trustee_key").distinct()
    edges = edges.unionByName(assumed.select(*PAIR, F.lit("assumed").alias("kind"), node("principal", F.col("principal_key")).alias("source"), node("principal", F.col("trustee_key")).alias("target"), none.alias("edge_key"), none.alias("effect")))
    edges = edges.unionByName(listed.select(*PAIR, F.lit("trustee").alias("kind"), node("principal", F.col("trustee_key")).alias("source"), F.col("entry").alias("target"), F.col("ace_key").alias("edge_key"), none.alias("effect")))
    edges = edges.unionByName(listed.select(*PAIR, F.col("relation").alias("kind"), F.col("entry").alias("source"), F.col("place").alias("target"), none.alias("edge_key"), "effect"))
    edges = edges.unionByName(effects.where("ace_key IS NULL").select(*PAIR, F.lit("ownership").alias("kind"), node("principal", F.col("principal_key")).alias("source"), node("resource", F.col("resource_key")).alias("target"), none.alias("edge_key"), "effect"))
    shared = listed.where("layer = 'share'").select(*PAIR).distinct()
    edges = edges.unionByName(shared.select(*PAIR, F.lit("bounds").alias("kind"), node("share_of", F.col("resource_key")).alias("source"), node("resource", F.col("resource_key")).alias("target"), none.alias("edge_key"), none.alias("effect")))
    edges = cut(edges)
    nodes = reduce(DataFrame.unionByName, [edges.select(*PAIR, F.col(c).alias("node")) for c in ("source", "target")]).distinct()
    return nodes.select(*PAIR, "node", F.substring_index("node", ":", 1).alias("kind")), edges


def primary_routes(entries: DataFrame, rights: DataFrame) -> DataFrame:
    """PAIR, layer, ace_key, trustee_key, coverage, share_of_rights: for each layer the grant that brings most of the rights a pair ends with.

    Of equals, held and own trustees go before assumed ones, then the order of the list counts.  What an
    owner has by owning competes as a grant before the first entry.  Pairs without rights have no route.
    """
    own = rights.where("own <> 0").select(*PAIR, F.lit("ntfs").alias("layer"), F.lit(None).cast("string").alias("ace_key"), F.col("principal_key").alias("trustee_key"), F.lit("subject").alias("origin"), F.struct(F.lit(-1).alias("order_index"), F.lit("").alias("ace_key")).alias("at"), F.col("own").alias("novel"))
    spot = Window.partitionBy(*PAIR, "layer").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    settled = F.coalesce(F.bit_or("mask").over(spot), F.lit(0).cast("long"))
    grants = entries.withColumn("novel", masks.minus(F.col("mask"), settled)).where("allow").select(*own.columns)
    rows = grants.unionByName(own).join(rights.where("rights <> 0").select(*PAIR, "rights"), PAIR)
    rows = rows.withColumn("coverage", F.col("novel").bitwiseAND(F.col("rights"))).where("coverage <> 0")
    best = F.min(F.struct((-F.bit_count("coverage")).alias("less"), (F.col("origin") == "assumed").alias("assumed"), "at", "ace_key", "trustee_key", "coverage", "rights")).alias("x")
    return rows.groupBy(*PAIR, "layer").agg(best).select(*PAIR, "layer", "x.ace_key", "x.trustee_key", "x.coverage", (-F.col("x.less") / F.bit_count("x.rights")).alias("share_of_rights"))
