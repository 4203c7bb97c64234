"""How grave a change is: what each field means, and one ordered table of rules.

A change is a row (kind, key, action, before, after, container_key, related_key, ordering_material, sibling_ace_changes) whose
states are maps of text.  Only a modification has deltas; each delta has the significance of its field.  The first rule
that holds names the change, and the table becomes one chain of conditions in a single projection.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.functions import keys, masks
from reachbase.operators.changes import WRITE_BITS

# What a change of each field means.
FIELDS = {
    "principal": {
        "identity": ("principal_key", "sid", "principal_kind", "host_key"),
        "derived": ("domain_sid",),
        "metadata": ("display_name", "sam_account_name", "user_principal_name", "distinguished_name", "unresolved_reason", "last_known_name"),
        "security": ("group_scope", "group_type", "enabled", "is_deleted"),
        "noise": ("source_key",),
    },
    "membership_edge": {
        "identity": ("edge_key", "group_key", "member_key", "group_sid", "member_sid", "edge_kind", "host_key"),
        "metadata": ("member_kind", "is_foreign_security_principal"),
        "noise": ("source_key",),
    },
    "server": {
        "identity": ("server_key", "name"),
        "metadata": ("dns_host_name", "netbios_name", "operating_system"),
        "security": ("computer_sid", "domain_sid", "is_domain_member"),
        "noise": ("source_key",),
    },
    "smb_share": {
        "identity": ("share_key", "server_key", "name"),
        "security": ("local_path", "share_type"),
        "metadata": ("description", "concurrent_user_limit", "caching_mode", "is_special"),
        "noise": ("source_key",),
    },
    "smb_ace": {
        "identity": ("ace_key", "share_key", "trustee_sid", "trustee_key", "ace_type", "access_mask", "permission", "right_token"),
        "order": ("order_index",),
        "noise": ("source_key",),
    },
    "ntfs_resource": {
        "identity": ("resource_key", "path", "server_key", "share_key"),
        "metadata": ("local_path", "group_sid", "resource_kind", "parent_acl_hash"),
        "security": ("owner_sid", "dacl_present", "dacl_protected", "inheritance_enabled", "acl_hash"),
        "derived": ("is_acl_boundary", "boundary_reason", "ace_count", "depth_from_share_root"),
        "noise": ("source_key",),
    },
    "ntfs_ace": {
        "identity": ("ace_key", "resource_key", "trustee_sid", "trustee_key", "ace_type", "access_mask", "ace_flags"),
        "security": ("source",),
        "metadata": ("inherited_from",),
        "order": ("order_index",),
        "noise": ("source_key",),
    },
}
ACES, ANY = ("smb_ace", "ntfs_ace"), ()


class Rule(NamedTuple):
    name: str
    kinds: tuple[str, ...]
    severity: str
    direction: str
    test: Column


def deltas(kind: Column, before: Column, after: Column) -> Column:
    """array(struct(field, before, after, significance)) of the fields that differ; a field that no table knows is unclassified."""
    known = [x for k, by in FIELDS.items() for meaning, names in by.items() for n in names for x in (F.lit(f"{k}.{n}"), F.lit(meaning))]
    both = F.array_union(F.map_keys(before), F.map_keys(after))
    moved = F.filter(both, lambda n: ~F.try_element_at(before, n).eqNullSafe(F.try_element_at(after, n)))
    meaning = lambda n: F.coalesce(F.try_element_at(F.create_map(*known), F.concat(kind, F.lit("."), n)), F.lit("unclassified"))
    return F.transform(moved, lambda n: F.struct(n.alias("field"), F.try_element_at(before, n).alias("before"), F.try_element_at(after, n).alias("after"), meaning(n).alias("significance")))


def rules() -> list[Rule]:
    """On columns kind, action, state, deltas, container_key, related_key, ordering_material, sibling_ace_changes, mask."""
    action, state, d = F.col("action"), F.col("state"), F.col("deltas")
    added, removed = action == "added", action == "removed"
    of = lambda name: F.try_element_at(state, F.lit(name))
    moved = lambda name: F.exists(d, lambda x: x["field"] == name)
    became = lambda name, value: F.exists(d, lambda x: (x["field"] == name) & x["after"].eqNullSafe(F.lit(value)))
    has = lambda meaning: F.exists(d, lambda x: x["significance"] == meaning)
    allow, deny, mask, broad = of("ace_type") == "allow", of("ace_type") == "deny", F.col("mask"), keys.is_broad(of("trustee_key"))
    full, climb, write = masks.holds(mask, masks.FILE_ALL), masks.has(mask, masks.ESCALATION), masks.has(mask, WRITE_BITS)
    material, siblings = F.col("ordering_material"), F.col("sibling_ace_changes")
    owner = F.exists(d, lambda x: (x["field"] == "owner_sid") & keys.is_broad(x["after"]))
    edge, who, res, share, server = ("membership_edge",), ("principal",), ("ntfs_resource",), ("smb_share",), ("server",)
    # Names, severities and directions, in the order in which they are tried.
    return [
        Rule("first_observed", ANY, "info", "neutral", action == "first_observed"),
        Rule("identity.drift", ANY, "high", "undetermined", has("identity")),
        Rule("ace.allow.broad.full", ACES, "critical", "broadened", added & allow & broad & full),
        Rule("ace.allow.broad.escalation", ACES, "critical", "broadened", added & allow & broad & climb),
        Rule("ace.allow.broad.write", ACES, "high", "broadened", added & allow & broad & write),
        Rule("ace.allow.broad", ACES, "high", "broadened", added & allow & broad),
        Rule("ace.deny.removed", ACES, "high", "broadened", removed & deny),
        Rule("ace.allow.full", ACES, "high", "broadened", added & allow & full),
        Rule("ace.allow.escalation", ACES, "high", "broadened", added & allow & climb),
        Rule("ace.order.material", ACES, "high", "undetermined", material),
        Rule("ace.allow.added", ACES, "medium", "broadened", added & allow),
        Rule("ace.deny.added", ACES, "low", "narrowed", added & deny),
        Rule("ace.allow.removed", ACES, "low", "narrowed", removed & allow),
        Rule("ace.source.explicit", ACES, "medium", "neutral", became("source", "explicit")),
        Rule("ace.source.inherited", ACES, "low", "neutral", became("source", "inherited")),
        Rule("ace.order.immaterial", ACES, "info", "neutral", ~material),
        Rule("ace.order.undetermined", ACES, "medium", "undetermined", moved("order_index") & material.isNull()),
        Rule("membership.added.privileged", edge, "critical", "broadened", added & keys.is_privileged(F.col("container_key"))),
        Rule("membership.added.broad", edge, "high", "broadened", added & keys.is_broad(F.col("related_key"))),
        Rule("membership.removed.privileged", edge, "medium", "narrowed", removed & keys.is_privileged(F.col("container_key"))),
        Rule("membership.added", edge, "medium", "broadened", added),
        Rule("membership.removed", edge, "low", "narrowed", removed),
        Rule("principal.group_type.security", who, "high", "broadened", became("group_type", "security")),
        Rule("principal.group_type.distribution", who, "medium", "narrowed", became("group_type", "distribution")),
        Rule("principal.enabled", who, "medium", "broadened", became("enabled", "true")),
        Rule("principal.disabled", who, "low", "narrowed", became("enabled", "false")),
        Rule("principal.undeleted", who, "medium", "broadened", became("is_deleted", "false")),
        Rule("principal.deleted", who, "medium", "narrowed", became("is_deleted", "true")),
        Rule("principal.group_scope", who, "low", "undetermined", moved("group_scope")),
        Rule("principal.removed", who, "low", "narrowed", removed),
        Rule("principal.added", who, "low", "neutral", added),
        Rule("resource.null_dacl", res, "critical", "broadened", became("dacl_present", "false")),
        Rule("resource.added.null_dacl", res, "high", "broadened", added & (of("dacl_present") == "false")),
        Rule("resource.unprotected", res, "high", "undetermined", became("dacl_protected", "false")),
        Rule("resource.protected", res, "medium", "undetermined", became("dacl_protected", "true")),
        Rule("resource.inheritance", res, "medium", "undetermined", moved("inheritance_enabled")),
        Rule("resource.owner.broad", res, "high", "broadened", owner),
        Rule("resource.owner", res, "medium", "broadened", moved("owner_sid")),
        Rule("resource.acl_hash.unexplained", res, "medium", "undetermined", moved("acl_hash") & (siblings == 0)),
        Rule("resource.acl_hash", res, "low", "undetermined", moved("acl_hash")),
        Rule("resource.removed", res, "low", "narrowed", removed),
        Rule("resource.added", res, "info", "neutral", added),
        Rule("share.local_path", share, "high", "undetermined", moved("local_path")),
        Rule("share.type", share, "medium", "undetermined", moved("share_type")),
        Rule("share.added", share, "medium", "broadened", added),
        Rule("share.removed", share, "low", "narrowed", removed),
        Rule("server.computer_sid", server, "high", "undetermined", moved("computer_sid")),
        Rule("server.domain", server, "medium", "undetermined", moved("is_domain_member") | moved("domain_sid")),
        Rule("server.removed", server, "low", "neutral", removed),
        Rule("server.added", server, "info", "neutral", added),
        Rule("unclassified.field", ANY, "medium", "undetermined", has("unclassified")),
        Rule("security.other", ANY, "medium", "undetermined", has("security")),
        Rule("derived.other", ANY, "info", "neutral", has("derived")),
        Rule("metadata.other", ANY, "info", "neutral", has("metadata")),
        Rule("provenance.only", ANY, "info", "neutral", (F.size(d) > 0) & F.forall(d, lambda x: x["significance"] == "noise")),
        Rule("unclassified", ANY, "medium", "undetermined", F.lit(True)),
    ]


def classified(changes: DataFrame) -> DataFrame:
    """The changes with deltas, rule, severity and direction."""
    none = F.create_map().cast("map<string,string>")
    kind, both = F.col("kind"), F.col("action") == "modified"
    rows = changes.withColumn("state", F.coalesce("after", "before", none))
    moved = deltas(kind, F.coalesce("before", none), F.coalesce("after", none))
    rows = rows.withColumn("deltas", F.when(both, moved).otherwise(F.slice(moved, 1, 0)))
    raw = F.expr("try_cast(try_element_at(state, 'access_mask') AS bigint)")
    level = masks.share_mask(F.try_element_at(F.col("state"), F.lit("permission")))
    rows = rows.withColumn("mask", F.when(kind.isin(*ACES), F.coalesce(masks.expand_generic(raw), F.when(kind == "smb_ace", level))))
    chain = F.coalesce(*[F.when((kind.isin(*r.kinds) if r.kinds else F.lit(True)) & r.test, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.direction).alias("direction"))) for r in rules()])
    return rows.withColumn("_rule", chain).select(*changes.columns, "deltas", "_rule.rule", "_rule.severity", "_rule.direction")
