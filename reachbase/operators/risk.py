"""Risk rules: deterministic predicates over the estate, and what became of earlier findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.functions import keys, masks
from reachbase.functions.tables import cut
from reachbase.operators import acl, graph
from reachbase.operators.graph import expand
from reachbase.plans.estate import Estate

SEVERITIES = ("informational", "low", "medium", "high", "critical")
#: Severity by the band of rights, for each broad trustee.
BANDS = {
    "everyone_broad_access": {"read": "high", "write": "critical", "full_control": "critical"},
    "authenticated_users_broad_access": {"read": "medium", "write": "high", "full_control": "high"},
    "domain_users_broad_access": {"read": "low", "write": "medium", "full_control": "high"},
}


def broad_rule(trustee: Column) -> Column:
    """The rule on broad access that a trustee falls under; null for others."""
    return F.when(trustee == keys.EVERYONE, "everyone_broad_access").when(trustee == keys.AUTHENTICATED, "authenticated_users_broad_access").when(keys.rid(trustee) == "513", "domain_users_broad_access")


def broad_access(e: Estate) -> DataFrame:
    """What a broad trustee gets alone from each list, graded by band."""
    return broad_findings(e.ntfs_aces, e.resources)


def broad_findings(aces: DataFrame, resources: DataFrame) -> DataFrame:
    """The same from entries and from resources (resource_key, dacl_present) alone."""
    named = acl.considered(aces).withColumn("rule", broad_rule(F.col("trustee_key"))).where(F.col("rule").isNotNull())
    rights = named.groupBy("rule", "resource_key").agg(acl.fold(acl.ordered_entries()).alias("f")).select("rule", "resource_key", F.col("f.granted").alias("rights"))
    band = F.when(masks.holds(F.col("rights"), masks.CATEGORIES["full_control"]), "full_control").when(masks.has(F.col("rights"), 0x116), "write").when(masks.holds(F.col("rights"), masks.CATEGORIES["read"]), "read")
    severity = F.lit(None).cast("string")
    for name, bands in BANDS.items():
        for b, s in bands.items():
            severity = F.when((F.col("rule") == name) & (F.col("band") == b), F.lit(s)).otherwise(severity)
    found = rights.withColumn("band", band).where(F.col("band").isNotNull()).withColumn("severity", severity)
    nobody = resources.where(~F.col("dacl_present")).select(F.lit("everyone_broad_access").alias("rule"), "resource_key", F.lit(masks.FILE_ALL).cast("long").alias("rights"), F.lit("null_dacl").alias("band"), F.lit("critical").alias("severity"))
    return found.unionByName(nobody)


def direct_user_entries(e: Estate) -> DataFrame:
    """Entries that name a user or service instead of a group."""
    people = e.principals.where(F.col("kind").isin("user", "managed_service_account")).select(F.col("principal_key").alias("trustee_key"), "kind")
    return e.ntfs_aces.where(masks.expand_generic(F.col("access_mask")) != 0).join(people, "trustee_key").select("resource_key", "trustee_key", "kind", "ace_key")


def unresolved_entries(e: Estate) -> DataFrame:
    """Trustees on lists that no principal describes and that are not well known."""
    named = e.ntfs_aces.where(~keys.is_well_known(F.col("trustee_key")))
    missing = named.join(e.principals.select(F.col("principal_key").alias("trustee_key")), "trustee_key", "left_anti")
    return missing.groupBy("resource_key", "trustee_key").agg(F.count("*").alias("entries"))


def disabled_with_access(e: Estate, max_depth: int = 8) -> DataFrame:
    """Disabled principals that still hold a trustee of some list; unknown is not disabled."""
    off = e.principals.where(F.col("enabled").eqNullSafe(F.lit(False))).select(F.col("principal_key").alias("member_key"))
    named = e.ntfs_aces.where(F.col("ace_type") == "allow").groupBy("trustee_key").agg(F.count_distinct("resource_key").alias("resources"))
    held = graph.closure(e.edges, max_depth).join(off, "member_key", "left_semi").select("member_key", F.col("group_key").alias("trustee_key"))
    return held.unionByName(off.withColumn("trustee_key", F.col("member_key"))).join(named, "trustee_key").groupBy("member_key").agg(F.count("*").alias("trustees"), F.sum("resources").alias("grants"))


def broken_inheritance(e: Estate) -> DataFrame:
    """Protected lists below a share's root, and unprotected ones that differ from what is handed down."""
    reason = acl.boundaries(e.resources, e.ntfs_aces).where(F.col("boundary_reason").isin("protected_dacl", "acl_differs_from_parent"))
    below = e.resources.where(F.col("parent_key").isNotNull()).select("resource_key")
    kind = F.when(F.col("boundary_reason") == "protected_dacl", "protected").otherwise("diverged")
    return reason.join(below, "resource_key", "left_semi").select("resource_key", kind.alias("kind"), F.when(kind == "protected", "low").otherwise("informational").alias("severity"))


def deep_nesting(e: Estate, more_than: int = 3) -> DataFrame:
    """Groups whose longest chain of members below is deeper than the limit; the deepest chain alone."""
    named = e.principals.where("kind = 'group'").select(F.col("principal_key").alias("key"))
    nested = e.edges.join(e.edges.select(F.col("group_key").alias("member_key")).distinct(), "member_key", "left_semi")
    deep = graph.longest_chains(nested).join(named, "key", "left_semi").withColumn("depth", F.size("path"))
    return deep.where(F.col("depth") > more_than).select(F.col("key").alias("group_key"), "depth", F.col("path").alias("chain"))


def redundant_paths(e: Estate, at_least: int = 2) -> DataFrame:
    """Principals that a list names through several trustees."""
    people = e.principals.where("kind IN ('user', 'managed_service_account')").select(F.col("principal_key").alias("member_key"))
    held = graph.closure(e.edges, 8).join(people, "member_key", "left_semi").select("member_key", F.col("group_key").alias("trustee_key"))
    # Principals with the same groups have the same answer, so they are counted by their set of groups.
    sets = held.groupBy("member_key").agg(F.array_sort(F.collect_set("trustee_key")).alias("groups")).groupBy("groups").agg(F.count("*").alias("principals"))
    sets = cut(sets.withColumn("set", F.monotonically_increasing_id()))
    through = cut(sets.select("set", F.explode("groups").alias("trustee_key")).groupBy("trustee_key").agg(F.collect_list("set").alias("sets")))
    named = e.ntfs_aces.where("ace_type = 'allow'").select("resource_key", "trustee_key").repartition("resource_key").distinct()
    # A list gathers the sets that hold each of its trustees where it lies, so pairs of lists and sets are neither shuffled nor written.
    rows = named.join(through, "trustee_key").groupBy("resource_key").agg(F.array_sort(F.flatten(F.collect_list("sets"))).alias("held"))
    at = lambda i: F.get("held", i)
    several = F.filter("held", lambda x, i: (i >= at_least - 1) & at(i - (at_least - 1)).eqNullSafe(x) & ~at(i - at_least).eqNullSafe(x))
    none = F.lit(0).cast("long")
    longest = F.aggregate("held", F.struct(F.lit(-1).cast("long").alias("set"), none.alias("n"), none.alias("most")), lambda s, x: _run(s, x), lambda s: s["most"])
    found = rows.select("resource_key", several.alias("several"), longest.alias("most_trustees")).where(F.size("several") > 0)
    counted = found.select("resource_key", "most_trustees", F.explode("several").alias("set")).join(sets.select("set", "principals"), "set")
    return counted.groupBy("resource_key").agg(F.sum("principals").alias("principals"), F.max("most_trustees").alias("most_trustees"))


def _run(s: Column, x: Column) -> Column:
    """One step of the search for the longest run of equal neighbours: set, n (its length so far), most."""
    n = F.when(s["set"] == x, s["n"] + 1).otherwise(F.lit(1).cast("long"))
    return F.struct(x.alias("set"), n.alias("n"), F.greatest(s["most"], n).alias("most"))


def empty_groups(e: Estate, enumerated: DataFrame) -> DataFrame:
    """Groups on lists that were enumerated and have no member; one that nobody enumerated is no finding."""
    named = e.ntfs_aces.select("trustee_key").union(e.share_aces.select("trustee_key")).distinct()
    groups = e.principals.where("kind = 'group'").select(F.col("principal_key").alias("trustee_key"))
    return named.join(groups, "trustee_key", "left_semi").join(enumerated.select("trustee_key"), "trustee_key", "left_semi").join(e.edges.select(F.col("group_key").alias("trustee_key")), "trustee_key", "left_anti")


def tagged(resources: DataFrame, tags: DataFrame) -> DataFrame:
    """resource_key, tag for (path, tag): a tag holds for its path and all below; joined on every path above, not by prefix."""
    above = resources.select("resource_key", F.explode(F.concat(F.array("resource_key"), F.transform(keys.ancestors(F.col("resource_key")), lambda a: a["key"]))).alias("path"))
    return above.join(tags, "path").select("resource_key", "tag").distinct()


def reconcile(stored: DataFrame, matched: DataFrame, key: list[str]) -> DataFrame:
    """stored (key, status, digest) against matched (key, digest): what became of each finding."""
    both = stored.withColumnRenamed("digest", "old_digest").join(matched.withColumnRenamed("digest", "new_digest"), key, "full_outer")
    outcome = (
        F.when(F.col("status").isNull(), "opened").when(F.col("new_digest").isNull(), F.when(F.col("status") == "open", "resolved").otherwise("stays_resolved"))
        .when(F.col("status") == "resolved", "reopened").when(F.col("old_digest") == F.col("new_digest"), "reaffirmed").otherwise("evidence_changed")
    )
    return both.select(*key, outcome.alias("outcome"))


CONFIDENCES = ("low", "medium", "high")
#: What lowers the confidence of a finding, and to what.
QUALIFIERS = {"null_dacl": "high", "generic_rights_expanded": "medium", "acl_truncated": "low", "unobserved_trustee": "low", "protected_dacl": "high", "empty_dacl": "high"}


def rank(column: Column, names: tuple[str, ...]) -> Column:
    """The place of a word in a vocabulary, from 0; null for others."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(names):
        out = F.when(column == name, F.lit(i)).otherwise(out)
    return out


def word(at: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), at)


def confidence(qualifiers: DataFrame, by: list[str], column: str = "qualifier") -> DataFrame:
    """by, confidence: the weakest that any qualifier of a group leaves."""
    level = F.lit(None).cast("int")
    for name, stands in QUALIFIERS.items():
        level = F.when(F.col(column) == name, F.lit(CONFIDENCES.index(stands))).otherwise(level)
    return qualifiers.groupBy(*by).agg(word(F.min(F.coalesce(level, F.lit(len(CONFIDENCES) - 1))), CONFIDENCES).alias("confidence"))


def keyed(findings: DataFrame, subject: list[str], evidence: list[str]) -> DataFrame:
    """Adds finding_key and evidence_digest: what a finding is about, and what it rests on."""
    line = lambda columns: F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), 256)
    return findings.withColumns({"finding_key": line(["rule", *subject]), "evidence_digest": line(evidence)})


def report(findings: DataFrame, limit: int, after: int = 0) -> DataFrame:
    """A page by severity and confidence falling, then first_detected and key rising, with the exact total on each row."""
    order = [rank(F.col("severity"), SEVERITIES).desc(), rank(F.col("confidence"), CONFIDENCES).desc(), F.col("first_detected").asc(), F.col("finding_key").asc()]
    return findings.orderBy(*order).offset(after).limit(limit).withColumn("total", findings.agg(F.count("*")).scalar())


def reading(evaluated: Column, scopes: Column, collected: Column, stale: Column) -> Column:
    """How far totals may be trusted."""
    return F.when(~evaluated, "not_evaluated").when(collected == 0, "incomplete").when(stale > 0, "stale").when(collected < scopes, "partial").otherwise("complete")


# The kinds of objects that each rule reads.
DEPENDS_ON = {
    "everyone_broad_access": ("ntfs_ace", "ntfs_resource"),
    "authenticated_users_broad_access": ("ntfs_ace", "ntfs_resource"),
    "domain_users_broad_access": ("ntfs_ace", "ntfs_resource"),
    "direct_user_ace": ("ntfs_ace", "principal"),
    "unresolved_sid_on_acl": ("ntfs_ace", "principal", "membership_edge"),
    "disabled_principal_retains_access": ("ntfs_ace", "principal", "membership_edge"),
    "broken_inheritance": ("ntfs_ace", "ntfs_resource"),
    "deep_group_nesting": ("membership_edge",),
    "redundant_access_paths": ("ntfs_ace", "membership_edge"),
    "empty_permission_bearing_group": ("ntfs_ace", "principal", "membership_edge"),
}


def rules_affected(changed: DataFrame) -> DataFrame:
    """run_id, rule from (run_id, kind): the rules that read a kind of which the run opened or closed an object."""
    table = changed.sparkSession.createDataFrame([(k, rule) for rule, kinds in DEPENDS_ON.items() for k in kinds], "kind string, rule string")
    return changed.select("run_id", "kind").distinct().join(F.broadcast(table), "kind").select("run_id", "rule").distinct()  # a constant table


def resources_affected(e: Estate, changed: DataFrame) -> DataFrame:
    """resource_key: every list whose answer can depend on the changed objects (kind, key), before or after them.

    A changed entry (kind ntfs_ace; key is the entry's) or list (ntfs_resource) concerns its list and those right below; a principal or an end of a changed
    membership (kind principal or membership_edge; key is the principal's or the group's) concerns every list that names it or a group above it.
    """
    own = changed.where("kind = 'ntfs_ace'").select(F.col("key").alias("ace_key")).join(e.ntfs_aces, "ace_key").select("resource_key")
    own = own.unionByName(changed.where("kind = 'ntfs_resource'").select(F.col("key").alias("resource_key"))).distinct()
    below = e.resources.join(own.select(F.col("resource_key").alias("parent_key")), "parent_key", "left_semi").select("resource_key")
    who = cut(changed.where("kind IN ('principal', 'membership_edge')").select("key").distinct())
    above, _ = expand(e.edges, who, False, None, None, None)
    named = who.unionByName(above.select("key")).distinct().withColumnRenamed("key", "trustee_key")
    naming = e.ntfs_aces.join(named, "trustee_key", "left_semi").select("resource_key")
    return own.unionByName(below).unionByName(naming).distinct()
