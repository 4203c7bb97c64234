"""Review campaigns: what their scopes select at a baseline, what is left out and why, whom an item is assigned to, and what a reviewer sees beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.functions import keys, masks
from reachbase.operators import access, simulate
from reachbase.operators.risk import SEVERITIES, rank, word
from reachbase.plans.estate import Estate

#: How firmly a version is known at an instant, weakest first.
CERTAINTIES = ("backfilled", "inferred", "observed")
INHERITED = 16


def weakest(certainty: Column) -> Column:
    """Aggregate: the weakest certainty of a group; a word outside the vocabulary counts as the weakest, no row as null."""
    return word(F.min(F.coalesce(rank(certainty, CERTAINTIES), F.lit(0))), CERTAINTIES)


def grants(e: Estate) -> DataFrame:
    """target_kind, target_key, principal_key, entry_key, ace_type, rights, inherited, certainty: every entry on lists and shares.

    Columns ``certainty`` of the two entry tables are kept, so entries of a past estate say how well they are known; without one
    they count as observed.
    """

    def side(rows: DataFrame, kind: str, key: str, rights: Column, inherited: Column) -> DataFrame:
        sure = F.col("certainty") if "certainty" in rows.columns else F.lit("observed")
        return rows.select(F.lit(kind).alias("target_kind"), F.col(key).alias("target_key"), F.col("trustee_key").alias("principal_key"), F.col("ace_key").alias("entry_key"), "ace_type", rights.alias("rights"), inherited.alias("inherited"), sure.alias("certainty"))

    lists = side(e.ntfs_aces, "resource", "resource_key", masks.hex_mask(F.col("access_mask")), F.coalesce(F.col("ace_flags").bitwiseAND(INHERITED) != 0, F.lit(False)))
    return lists.unionByName(side(e.share_aces, "share", "share_key", F.col("permission"), F.lit(False)))


def targets(e: Estate) -> DataFrame:
    """target_kind, target_key, scope_kind, scope_key: everything that a scope may name a target by.

    A share goes by itself and its server; a resource by its server, its share and every path from itself up to the share's root.
    A directory tree names no share: the share's list belongs to all of the share.
    """
    way = lambda kind, key: F.struct(F.lit(kind).alias("scope_kind"), key.alias("scope_key"))
    shares = e.shares.select(F.lit("share").alias("target_kind"), F.col("share_key").alias("target_key"), F.explode(F.array(way("share", F.col("share_key")), way("server", F.col("server_key")))).alias("s"))
    paths = F.concat(F.array("resource_key"), F.transform(keys.ancestors(F.col("resource_key")), lambda a: a["key"]))
    names = F.concat(F.array(way("server", F.col("server_key")), way("share", F.col("share_key"))), F.transform(paths, lambda p: way("directory_tree", p)))
    resources = e.resources.select(F.lit("resource").alias("target_kind"), F.col("resource_key").alias("target_key"), F.explode(names).alias("s"))
    return shares.unionByName(resources).select("target_kind", "target_key", "s.*")


def _named(scopes: DataFrame) -> DataFrame:
    """Scopes with keys as targets spell them: paths canonical, servers and shares in lower case, identifiers untouched."""
    key = F.when(F.col("scope_kind") == "directory_tree", keys.resource_key(F.col("scope_key"))).when(F.col("scope_kind") == "principal", F.col("scope_key")).otherwise(F.lower("scope_key"))
    return scopes.withColumn("scope_key", key)


def selected(e: Estate, scopes: DataFrame) -> DataFrame:
    """campaign and the columns of ``grants``, each entry once for a campaign: what the scopes (campaign, focus, scope_kind, scope_key) select.

    With focus ``principal``, entries whose trustee a scope names itself, never through a group: an entry is mended where
    it stands.  With focus ``resource``, all entries on the targets that a server, share or directory tree holds.  Scopes that overlap
    give an entry once, and a scope of a kind that its focus does not know gives none.  Scopes meet targets first and only the targets' keys
    are repeated for paths; entries are joined to the targets found.
    """
    asked = _named(scopes).select("campaign", "focus", "scope_kind", "scope_key").distinct()
    places = asked.where("focus = 'resource' AND scope_kind <> 'principal'").join(targets(e), ["scope_kind", "scope_key"]).select("campaign", "target_kind", "target_key").distinct()
    people = asked.where("focus = 'principal' AND scope_kind = 'principal'").select("campaign", F.col("scope_key").alias("principal_key")).distinct()
    every = grants(e)
    columns = ["campaign", *every.columns]
    on_places = every.join(places, ["target_kind", "target_key"]).select(*columns)
    return on_places.unionByName(every.join(people, "principal_key").select(*columns))


@dataclass(frozen=True)
class Options:
    """Which entries a campaign asks about beside plain grants that stand on the target itself."""

    inherited: bool = False
    builtin: bool = False
    deny: bool = False


def with_reason(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds reason: why an entry becomes no item, null if it does.

    Tried in this order, so that an entry with two reasons is always tallied under the same: inherited, builtin_trustee, deny.
    What is no identifier at all is no builtin trustee, for it is worth a look.
    """
    builtin = keys.sid_of(F.col("principal_key")).rlike(r"^S-1(-\d+)+$") & keys.is_well_known(F.col("principal_key"))
    no = F.lit(None).cast("string")
    reason = F.coalesce(
        no if options.inherited else F.when(F.col("inherited"), "inherited"),
        no if options.builtin else F.when(builtin, "builtin_trustee"),
        no if options.deny else F.when(F.col("ace_type") == "deny", "deny"),
    )
    return rows.withColumn("reason", reason)


def tally(rows: DataFrame) -> DataFrame:
    """campaign, reason, n from rows of ``with_reason``: one row for each reason that occurs, and ``included`` for the entries that became items."""
    return rows.groupBy("campaign", F.coalesce("reason", F.lit("included")).alias("reason")).agg(F.count("*").alias("n"))


def items(rows: DataFrame, principals: DataFrame) -> DataFrame:
    """campaign, target_kind, target_key, principal_key, principal_name, grants, complex, certainty, digest.

    One item for each target and trustee of a campaign, from the entries of ``with_reason`` without a reason.  The digest covers
    the item's entries in the order of their keys, with type and rights.  An item is complex if it rests on several entries, and as certain as the weakest.
    A trustee that nothing describes keeps a null name.
    """
    line = F.struct("entry_key", F.concat_ws("|", "entry_key", "ace_type", "rights").alias("line"))
    evidence = F.transform(F.array_sort(F.collect_set(line)), lambda x: x["line"])
    held = rows.where("reason IS NULL").groupBy("campaign", "target_kind", "target_key", "principal_key").agg(F.count("*").alias("grants"), weakest(F.col("certainty")).alias("certainty"), F.sha2(F.array_join(evidence, "\n"), 256).alias("digest"))
    named = held.join(principals.select("principal_key", F.col("name").alias("principal_name")), "principal_key", "left")
    return named.select("campaign", "target_kind", "target_key", "principal_key", "principal_name", "grants", (F.col("grants") > 1).alias("complex"), "certainty", "digest")


ITEM = ["campaign", "target_kind", "target_key", "principal_key"]


def assigned(e: Estate, items_: DataFrame, assignments: DataFrame) -> DataFrame:
    """Adds assignment_id, null for items that no assignment covers.

    ``assignments``: assignment_id, campaign, scope_kind and scope_key (both null: the whole campaign), assigned_at.  An item goes to the
    newest that covers it (then the greatest id), as the current answer to who is asked; a server or share covers its own list and all that lies in it, a
    principal all items about it.
    """
    asked = _named(assignments).select("assignment_id", "campaign", "scope_kind", "scope_key", F.struct("assigned_at", "assignment_id").alias("_at"))
    whole = asked.where("scope_kind IS NULL").groupBy("campaign").agg(F.max("_at").alias("_all"))
    on_target = targets(e).join(asked.where("scope_kind <> 'principal'"), ["scope_kind", "scope_key"]).groupBy("campaign", "target_kind", "target_key").agg(F.max("_at").alias("_target"))
    about = asked.where("scope_kind = 'principal'").groupBy("campaign", F.col("scope_key").alias("principal_key")).agg(F.max("_at").alias("_about"))
    found = items_.join(whole, "campaign", "left").join(on_target, ["campaign", "target_kind", "target_key"], "left").join(about, ["campaign", "principal_key"], "left")
    return found.select(*items_.columns, F.greatest("_all", "_target", "_about")["assignment_id"].alias("assignment_id"))


def queue(assigned_: DataFrame, assignments: DataFrame, campaigns: DataFrame, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """reviewer, campaign, assigned, decided, earliest_due: what waits for each reviewer in the campaigns (campaign, status) of these statuses.

    ``assigned_``: rows of ``assigned`` with ``decided`` (boolean).  Due is the earliest date of the reviewer's own assignments that hold an item: whoever
    has two is late with the first.  Revoked assignments (``revoked``) and unassigned items count for nobody.
    """
    per = assigned_.where("assignment_id IS NOT NULL").groupBy("campaign", "assignment_id").agg(F.count("*").alias("assigned"), F.count_if("decided").alias("decided"))
    live = assignments.where(~F.coalesce("revoked", F.lit(False))).select("assignment_id", "reviewer", "due_at")
    running = campaigns.where(F.col("status").isin(*statuses)).select("campaign")
    rows = per.join(live, "assignment_id").join(running, "campaign", "left_semi")
    return rows.groupBy("reviewer", "campaign").agg(F.sum("assigned").alias("assigned"), F.sum("decided").alias("decided"), F.min("due_at").alias("earliest_due"))


def context(items_: DataFrame, before: Estate, now: Estate, findings: DataFrame, changes: DataFrame, reach: DataFrame) -> DataFrame:
    """campaign, target_kind, target_key, principal_key and what a reviewer sees beside the item.

    ``drift``: unchanged, modified, removed (the target still stands) or target_removed.  ``resource_key``: what effective access is asked about,
    for a share the directory that it publishes, null if none is known; ``baseline_rights``, ``current_rights`` and ``direction``: remote access of the
    trustee there then and now, null for a trustee without a token.  ``findings`` (resource_key, severity): their number on that resource and the worst.
    ``changes`` (resource_key, at): number and newest.  ``reach`` (principal_key, n_members): how many hold the trustee, 0 if nobody.
    """
    current = items(with_reason(_on(items_, grants(now)), Options(True, True, True)), now.principals).select(*ITEM, F.col("digest").alias("_now"))
    shares = now.shares.select(F.lit("share").alias("target_kind"), F.col("share_key").alias("target_key"))
    standing = shares.unionByName(now.resources.select(F.lit("resource").alias("target_kind"), F.col("resource_key").alias("target_key"))).withColumn("_stands", F.lit(True))
    published = now.shares.select(F.lit("share").alias("target_kind"), F.col("share_key").alias("target_key"), keys.resource_key(F.concat(F.lit("\\\\"), F.replace("share_key", F.lit("|"), F.lit("\\")))).alias("_root"))
    rows = items_.join(current, ITEM, "left").join(standing, ["target_kind", "target_key"], "left").join(published, ["target_kind", "target_key"], "left")
    drift = F.when(F.col("_stands").isNull(), "target_removed").when(F.col("_now").isNull(), "removed").when(F.col("_now") == F.col("digest"), "unchanged").otherwise("modified")
    rows = rows.select(*ITEM, drift.alias("drift"), F.coalesce("_root", "target_key").alias("resource_key"))
    known = before.resources.select("resource_key").union(now.resources.select("resource_key")).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "resource_key", "left").withColumn("resource_key", F.when(F.col("_known"), F.col("resource_key"))).drop("_known")
    subjects = now.principals.where(F.col("kind").isin(*access.SUBJECT_KINDS)).select("principal_key")
    pairs = rows.where("resource_key IS NOT NULL").select("principal_key", "resource_key").distinct().join(subjects, "principal_key", "left_semi")
    side = lambda e, name: access.pair_access(e, pairs).select("principal_key", "resource_key", F.col("remote").alias(name))
    rights = side(before, "baseline_rights").join(side(now, "current_rights"), ["principal_key", "resource_key"], "full_outer")
    found = findings.groupBy("resource_key").agg(F.count("*").alias("findings"), word(F.max(rank(F.col("severity"), SEVERITIES)), SEVERITIES).alias("worst"))
    moved = changes.groupBy("resource_key").agg(F.count("*").alias("changes"), F.max("at").alias("last_change"))
    out = rows.join(rights, ["principal_key", "resource_key"], "left").join(found, "resource_key", "left").join(moved, "resource_key", "left").join(reach.select("principal_key", "n_members"), "principal_key", "left")
    way = F.when(F.col("baseline_rights").isNotNull() & F.col("current_rights").isNotNull(), simulate.direction(F.col("baseline_rights"), F.col("current_rights")))
    return out.select(*ITEM, "drift", "resource_key", "baseline_rights", "current_rights", way.alias("direction"), F.coalesce("findings", F.lit(0).cast("long")).alias("findings"), "worst", F.coalesce("changes", F.lit(0).cast("long")).alias("changes"), "last_change", F.coalesce("n_members", F.lit(0).cast("long")).alias("n_members"))


def _on(items_: DataFrame, every: DataFrame) -> DataFrame:
    """The entries that stand now for the items' targets and trustees, once for each campaign."""
    return every.join(items_.select(*ITEM).distinct(), ["target_kind", "target_key", "principal_key"]).select("campaign", *every.columns)


#: Ways in which access moves, gravest first.
GRAVITY = ("gain", "expand", "lose", "reduce", "change", "same")


def gravest_first(deltas: DataFrame) -> list[Column]:
    """Order of deltas (principal_key, resource_key, direction): gains before losses, unchanged last, ties by keys."""
    return [F.coalesce(rank(F.col("direction"), GRAVITY), F.lit(len(GRAVITY))).asc(), F.col("resource_key").asc(), F.col("principal_key").asc()]


def impact_summary(deltas: DataFrame) -> DataFrame:
    """One row: how many deltas were evaluated, how many went each way, and how many principals gain or lose and resources change."""
    way = F.col("direction")
    gains, losses = way.isin("gain", "expand"), way.isin("lose", "reduce")
    counts = [F.count_if(way == name).alias(name) for name in GRAVITY]
    who = [F.count_distinct(F.when(test, F.col(c))).alias(n) for test, c, n in ((gains, "principal_key", "principals_gaining"), (losses, "principal_key", "principals_losing"), (way != "same", "resource_key", "resources_affected"))]
    return deltas.agg(F.count("*").alias("evaluated"), *counts, *who)
