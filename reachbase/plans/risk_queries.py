"""Queries on risk, planned changes and reviews, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.functions import keys, masks
from reachbase.functions.tables import cut
from reachbase.operators import changes, governance, operations, risk, simulate
from reachbase.plans import access_queries as base
from reachbase.plans.access_queries import CLASSES, FOLD, REACH, TOKENS
from reachbase.plans.estate import DOMAIN_USERS, Estate
from reachbase.plans.oracle import expand, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def on_estate(body: str | None = None):
    def add(f):
        base.on_estate(body)(f)
        QUERIES[f.__name__] = base.QUERIES.pop(f.__name__)
        if body is not None:
            ORACLE[f.__name__] = base.ORACLE.pop(f.__name__)
        return f

    return add


_BROAD = ", b AS (SELECT CASE trustee_key WHEN 'S-1-1-0' THEN 'everyone_broad_access' WHEN 'S-1-5-11' THEN 'authenticated_users_broad_access' ELSE 'domain_users_broad_access' END AS rule, * FROM ntfs_aces WHERE trustee_key IN ('S-1-1-0', 'S-1-5-11', 'S-1-5-21-1-1-1-513') AND ace_flags & 8 = 0), br AS (SELECT rule, resource_key, " + FOLD + ".g AS rights FROM b GROUP BY 1, 2), bb AS (SELECT *, CASE WHEN rights & 983551 = 983551 THEN 'full_control' WHEN rights & 278 <> 0 THEN 'write' WHEN rights & 131209 = 131209 THEN 'read' END AS band FROM br), found AS (SELECT rule, resource_key, rights, band, CASE WHEN rule[1] = 'e' THEN CASE band WHEN 'read' THEN 'high' ELSE 'critical' END WHEN rule[1] = 'a' THEN CASE band WHEN 'read' THEN 'medium' ELSE 'high' END ELSE CASE band WHEN 'read' THEN 'low' WHEN 'write' THEN 'medium' ELSE 'high' END END AS severity FROM bb WHERE band IS NOT NULL UNION ALL SELECT 'everyone_broad_access', resource_key, 2032127, 'null_dacl', 'critical' FROM resources WHERE NOT dacl_present)"


@on_estate(_BROAD + " SELECT rule, resource_key, rights, band, severity FROM found")
def risk_broad_access(e: Estate) -> DataFrame:
    return risk.broad_access(e)


@on_estate("SELECT resource_key, a.trustee_key, p.kind, ace_key FROM ntfs_aces a JOIN principals p ON principal_key = trustee_key WHERE p.kind IN ('user', 'managed_service_account')")
def risk_direct_user_entries(e: Estate) -> DataFrame:
    return risk.direct_user_entries(e)


@on_estate("SELECT resource_key, trustee_key, count(*) AS entries FROM ntfs_aces WHERE starts_with(trustee_key, 'S-1-5-21-') AND trustee_key NOT IN (SELECT principal_key FROM principals) GROUP BY 1, 2")
def risk_unresolved_entries(e: Estate) -> DataFrame:
    return risk.unresolved_entries(e)


@on_estate(REACH + ", n AS (SELECT trustee_key, count(DISTINCT resource_key) AS r FROM ntfs_aces WHERE ace_type = 'allow' GROUP BY 1), h AS (SELECT member_key, group_key AS t FROM reach WHERE depth <= 8 UNION ALL SELECT principal_key, principal_key FROM principals) SELECT member_key, count(*) AS trustees, sum(r)::bigint AS grants FROM h JOIN n ON n.trustee_key = h.t JOIN principals p ON p.principal_key = member_key WHERE p.enabled = false GROUP BY 1")
def risk_disabled_with_access(e: Estate) -> DataFrame:
    return risk.disabled_with_access(e)


@on_estate()
def risk_broken_inheritance(e: Estate) -> DataFrame:
    return risk.broken_inheritance(e)


ORACLE["risk_broken_inheritance"] = "SELECT b.resource_key, CASE boundary_reason WHEN 'protected_dacl' THEN 'protected' ELSE 'diverged' END AS kind, CASE boundary_reason WHEN 'protected_dacl' THEN 'low' ELSE 'informational' END AS severity FROM (" + base.ORACLE["list_boundaries"] + ") b WHERE boundary_reason IN ('protected_dacl', 'acl_differs_from_parent') AND b.resource_key LIKE '\\\\%\\%\\%'".replace("\\\\%\\%\\%", "\\\\%\\%\\%")


@on_estate(""", g AS (SELECT * FROM edges WHERE member_key IN (SELECT group_key FROM edges)), c(start, node, path) AS (SELECT DISTINCT group_key, group_key, [group_key] FROM g UNION ALL SELECT start, member_key, list_append(path, member_key) FROM c JOIN g ON g.group_key = c.node WHERE NOT list_contains(path, member_key) AND len(path) < 9)
SELECT start AS group_key, max(len(path))::int AS depth, array_to_string(first(path ORDER BY -len(path), path), '>') AS chain FROM c GROUP BY 1 HAVING max(len(path)) > 2""")
def risk_deep_nesting(e: Estate) -> DataFrame:
    return risk.deep_nesting(e, more_than=2).withColumn("chain", F.array_join("chain", ">"))


@on_estate(REACH + """, h AS (SELECT member_key, group_key FROM reach JOIN principals p ON p.principal_key = member_key WHERE p.kind IN ('user', 'managed_service_account') AND depth <= 8), st AS (SELECT member_key, list(group_key ORDER BY group_key) AS gs FROM h GROUP BY 1), ct AS (SELECT gs, count(*) AS n FROM st GROUP BY 1),
t AS (SELECT DISTINCT resource_key, trustee_key FROM ntfs_aces WHERE ace_type = 'allow'), x AS (SELECT resource_key, gs, n, count(*) AS k FROM (SELECT gs, n, unnest(gs) AS g FROM ct) JOIN t ON trustee_key = g GROUP BY 1, 2, 3)
SELECT resource_key, sum(n)::bigint AS principals, max(k) AS most_trustees FROM x WHERE k >= 2 GROUP BY 1""")
def risk_redundant_paths(e: Estate) -> DataFrame:
    return risk.redundant_paths(e)


@on_estate("SELECT DISTINCT trustee_key FROM (SELECT trustee_key FROM ntfs_aces UNION SELECT trustee_key FROM share_aces) JOIN principals ON principal_key = trustee_key WHERE kind = 'group' AND trustee_key IN (SELECT group_key FROM edges) AND trustee_key NOT IN (SELECT group_key FROM edges WHERE NOT ends_with(group_key, '3'))")
def risk_empty_groups(e: Estate) -> DataFrame:
    """With the members of some enumerated groups taken out."""
    without = e.with_(edges=e.edges.where("NOT endswith(group_key, '3')"))
    return risk.empty_groups(without, e.edges.select(F.col("group_key").alias("trustee_key")).distinct())


@on_estate("SELECT r.resource_key, tag FROM resources r JOIN (SELECT resource_key AS path, 'secret' AS tag FROM resources WHERE depth = 1 AND resource_key LIKE '%\\1%' UNION ALL SELECT resource_key, 'audited' FROM resources WHERE depth = 0) ON r.resource_key = path OR starts_with(r.resource_key, path || '\\')")
def sensitive_resources(e: Estate) -> DataFrame:
    secret = e.resources.where((F.col("depth") == 1) & F.col("resource_key").contains("\\1")).select(F.col("resource_key").alias("path"), F.lit("secret").alias("tag"))
    return risk.tagged(e.resources, secret.unionByName(e.resources.where("depth = 0").select(F.col("resource_key").alias("path"), F.lit("audited").alias("tag"))))


@on_estate(_BROAD + ", st AS (SELECT rule, resource_key, CASE WHEN length(resource_key) % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN length(resource_key) % 2 = 0 THEN band ELSE 'x' END AS digest FROM found WHERE rule[1] <> 'd'), nw AS (SELECT rule, resource_key, band AS digest FROM found WHERE length(resource_key) % 5 <> 0) SELECT coalesce(st.rule, nw.rule) AS rule, coalesce(st.resource_key, nw.resource_key) AS resource_key, CASE WHEN status IS NULL THEN 'opened' WHEN nw.digest IS NULL THEN CASE status WHEN 'open' THEN 'resolved' ELSE 'stays_resolved' END WHEN status = 'resolved' THEN 'reopened' WHEN st.digest = nw.digest THEN 'reaffirmed' ELSE 'evidence_changed' END AS outcome FROM st FULL JOIN nw ON st.rule = nw.rule AND st.resource_key = nw.resource_key")
def risk_reconcile(e: Estate) -> DataFrame:
    found = risk.broad_access(e)
    n = F.length("resource_key")
    stored = found.where(F.substring("rule", 1, 1) != "d").select("rule", "resource_key", F.when(n % 3 == 0, "resolved").otherwise("open").alias("status"), F.when(n % 2 == 0, F.col("band")).otherwise("x").alias("digest"))
    return risk.reconcile(stored, found.where(n % 5 != 0).select("rule", "resource_key", F.col("band").alias("digest")), ["rule", "resource_key"])


@on_estate(_BROAD + " SELECT s AS severity, coalesce(n, 0) AS n FROM (VALUES ('informational'), ('low'), ('medium'), ('high'), ('critical')) v(s) LEFT JOIN (SELECT severity, count(*) AS n FROM found GROUP BY 1) ON severity = s")
def risk_facets(e: Estate) -> DataFrame:
    return operations.facets(risk.broad_access(e), "severity", list(risk.SEVERITIES))


_EDITED = ", after_aces AS (SELECT resource_key, trustee_key, ace_type, CASE WHEN order_index % 5 = 1 THEN access_mask & 1179785 ELSE access_mask END AS access_mask, CASE WHEN order_index % 5 = 1 THEN ace_key || '#' ELSE ace_key END AS ace_key FROM ntfs_aces WHERE order_index % 7 <> 2)"


def _edited(e: Estate) -> DataFrame:
    edit = F.col("order_index") % 5 == 1
    rows = e.ntfs_aces.where("order_index % 7 <> 2")
    return rows.withColumns({"access_mask": F.when(edit, F.col("access_mask").bitwiseAND(F.lit(1179785).cast("long"))).otherwise(F.col("access_mask")), "ace_key": F.when(edit, F.concat("ace_key", F.lit("#"))).otherwise(F.col("ace_key"))})


@on_estate(_EDITED + """, g AS (SELECT resource_key, trustee_key, ace_type, access_mask AS o, NULL::bigint AS n FROM ntfs_aces WHERE ace_key NOT IN (SELECT ace_key FROM after_aces) UNION ALL SELECT resource_key, trustee_key, ace_type, NULL, access_mask FROM after_aces WHERE ace_key NOT IN (SELECT ace_key FROM ntfs_aces)),
s AS (SELECT resource_key, trustee_key, ace_type, count(o) AS removed, count(n) AS added, max(o) AS o, max(n) AS n FROM g GROUP BY 1, 2, 3)
SELECT resource_key, trustee_key, ace_type, removed, added, CASE WHEN removed = 1 AND added = 1 THEN 'edited' ELSE 'ambiguous' END AS pairing, CASE WHEN removed = 1 AND added = 1 THEN CASE WHEN n & (4294967295 - o) = 0 AND o & (4294967295 - n) = 0 THEN 'neutral'
  WHEN n & (4294967295 - o) <> 0 AND o & (4294967295 - n) <> 0 THEN 'mixed' WHEN (n & (4294967295 - o) <> 0) = (ace_type = 'allow') THEN 'broadened' ELSE 'narrowed' END END AS direction FROM s""")
def entry_edits(e: Estate) -> DataFrame:
    return changes.entry_edits(e.ntfs_aces, _edited(e))


_GRADE = """CASE WHEN {a} AND allow AND broad AND full_ THEN 'ace.allow.broad.full' WHEN {a} AND allow AND broad AND climb THEN 'ace.allow.broad.escalation' WHEN {a} AND allow AND broad AND wr THEN 'ace.allow.broad.write' WHEN {a} AND allow AND broad THEN 'ace.allow.broad'
  WHEN NOT {a} AND NOT allow THEN 'ace.deny.removed' WHEN {a} AND allow AND full_ THEN 'ace.allow.full' WHEN {a} AND allow AND climb THEN 'ace.allow.escalation' WHEN {a} AND allow THEN 'ace.allow.added' WHEN {a} THEN 'ace.deny.added' ELSE 'ace.allow.removed' END""".replace("{a}", "added")


@on_estate(", c AS (SELECT ace_key, order_index % 2 = 0 AS added, ace_type = 'allow' AS allow, trustee_key IN ('S-1-1-0', 'S-1-5-11', 'S-1-5-21-1-1-1-513') AS broad, " + expand("access_mask") + " AS m FROM ntfs_aces), f AS (SELECT *, m & 983551 = 983551 AS full_, m & 786432 <> 0 AS climb, m & 852310 <> 0 AS wr FROM c), r AS (SELECT ace_key, " + _GRADE + " AS rule FROM f) SELECT ace_key, rule, CASE WHEN rule IN ('ace.allow.broad.full', 'ace.allow.broad.escalation') THEN 'critical' WHEN rule IN ('ace.allow.added') THEN 'medium' WHEN rule IN ('ace.deny.added', 'ace.allow.removed') THEN 'low' ELSE 'high' END AS severity, CASE WHEN rule IN ('ace.deny.added', 'ace.allow.removed') THEN 'narrowed' ELSE 'broadened' END AS direction FROM r")
def entry_grades(e: Estate) -> DataFrame:
    rows = e.ntfs_aces.select("ace_key", "ace_type", "trustee_key", F.when(F.col("order_index") % 2 == 0, "added").otherwise("removed").alias("action"), masks.expand_generic(F.col("access_mask")).alias("mask"))
    return changes.graded(rows, changes.entry_grades()).select("ace_key", "rule", "severity", "direction")


@on_estate("SELECT group_key, member_key, CASE WHEN length(member_key) % 2 = 0 THEN CASE WHEN member_key = 'S-1-5-21-1-1-1-513' THEN 'membership.added.broad' ELSE 'membership.added' END ELSE 'membership.removed' END AS rule, CASE WHEN length(member_key) % 2 = 0 THEN 'medium' ELSE 'low' END AS severity FROM edges")
def membership_grades(e: Estate) -> DataFrame:
    rows = e.edges.select("group_key", "member_key", F.when(F.length("member_key") % 2 == 0, "added").otherwise("removed").alias("action"))
    return changes.graded(rows, changes.membership_grades()).select("group_key", "member_key", "rule", "severity")


@on_estate(CLASSES + ", cutk AS (SELECT ace_key FROM ntfs_aces WHERE trustee_key = 'S-1-1-0' AND starts_with(resource_key, '\\\\brand2\\')), later AS (SELECT class_key, resource_key, " .replace("\\\\\\\\", "\\\\") + FOLD + ".g AS g FROM ntfs_aces JOIN members ON trustee_key = sid WHERE ace_flags & 8 = 0 AND ace_key NOT IN (SELECT ace_key FROM cutk) GROUP BY 1, 2), touched AS (SELECT DISTINCT resource_key FROM ntfs_aces WHERE ace_key IN (SELECT ace_key FROM cutk)), j AS (SELECT class_key, resource_key, f.g AS before, coalesce(later.g, 0) AS after FROM folded LEFT JOIN later USING (class_key, resource_key) WHERE resource_key IN (SELECT resource_key FROM touched)) SELECT class_key, resource_key, before, after, CASE WHEN before = 0 AND after <> 0 THEN 'gain' WHEN before <> 0 AND after = 0 THEN 'lose' WHEN after & (4294967295 - before) <> 0 AND before & (4294967295 - after) <> 0 THEN 'change' WHEN after & (4294967295 - before) <> 0 THEN 'expand' WHEN before & (4294967295 - after) <> 0 THEN 'reduce' ELSE 'same' END AS direction FROM j")
def simulate_entry_removal(e: Estate) -> DataFrame:
    e = e.with_(ntfs_aces=cut(e.ntfs_aces))
    gone = e.ntfs_aces.where((F.col("trustee_key") == keys.EVERYONE) & F.col("resource_key").startswith("\\\\brand2\\"))
    return simulate.entry_impact(e, simulate.with_entries(e, removed=gone.select("ace_key")), gone.select("resource_key").distinct())


@on_estate(TOKENS + f", e2 AS (SELECT * FROM edges WHERE NOT (group_key = '{DOMAIN_USERS}' AND member_key = 'S-1-5-21-1-1-4-1002')), w2(m, g, d) AS (SELECT DISTINCT member_key, group_key, 1 FROM e2 UNION SELECT w2.m, e2.group_key, w2.d + 1 FROM w2 JOIN e2 ON e2.member_key = w2.g WHERE w2.d < 12), lost AS (SELECT principal_key, sid FROM tokens WHERE origin = 'membership' AND (principal_key, sid) NOT IN (SELECT (m, g) FROM w2)) SELECT principal_key, '' AS gained, string_agg(sid, ',' ORDER BY sid) AS lost FROM lost GROUP BY 1")
def simulate_membership_removal(e: Estate) -> DataFrame:
    gone = e.edges.where((F.col("group_key") == DOMAIN_USERS) & (F.col("member_key") == "S-1-5-21-1-1-4-1002")).select("group_key", "member_key")
    out = simulate.membership_impact(e, simulate.with_edges(e, removed=gone))
    return out.select("principal_key", F.array_join("gained", ",").alias("gained"), F.array_join("lost", ",").alias("lost"))


_ITEMS = ", items AS (SELECT resource_key AS target_key, trustee_key AS principal_key, count(*) AS grants, sha256(string_agg(DISTINCT ace_key, chr(10) ORDER BY ace_key)) AS digest FROM ntfs_aces GROUP BY 1, 2)"


def _items(rows: DataFrame) -> DataFrame:
    return governance.review_items(rows.select(F.col("resource_key").alias("target_key"), F.col("trustee_key").alias("principal_key"), F.col("ace_key").alias("evidence")))


@on_estate(_ITEMS + " SELECT target_key, principal_key, grants, digest FROM items")
def review_items(e: Estate) -> DataFrame:
    return _items(e.ntfs_aces)


@on_estate(_EDITED + _ITEMS + ", i2 AS (SELECT resource_key AS target_key, trustee_key AS principal_key, sha256(string_agg(DISTINCT ace_key, chr(10) ORDER BY ace_key)) AS digest FROM after_aces GROUP BY 1, 2) SELECT coalesce(i.target_key, i2.target_key) AS target_key, coalesce(i.principal_key, i2.principal_key) AS principal_key, CASE WHEN i.digest IS NULL THEN 'new' WHEN i2.digest IS NULL THEN 'gone' WHEN i.digest = i2.digest THEN 'unchanged' ELSE 'changed' END AS drift FROM items i FULL JOIN i2 ON i.target_key = i2.target_key AND i.principal_key = i2.principal_key")
def review_drift(e: Estate) -> DataFrame:
    return governance.drift(_items(e.ntfs_aces), _items(_edited(e)))


@on_estate("SELECT DISTINCT ace_key AS key, CASE WHEN order_index % 3 = 0 THEN 'satisfied' WHEN order_index % 3 = 1 THEN 'changed' ELSE 'unobserved' END AS outcome FROM ntfs_aces")
def plan_preconditions(e: Estate) -> DataFrame:
    planned = e.ntfs_aces.select(F.col("ace_key").alias("key"), F.col("trustee_key").alias("digest"))
    now = e.ntfs_aces.where("order_index % 3 < 2").select(F.col("ace_key").alias("key"), F.when(F.col("order_index") % 3 == 0, F.col("trustee_key")).otherwise("other").alias("digest"))
    return governance.preconditions(planned, now)


def review_snapshot(e: Estate) -> DataFrame:
    return governance.snapshot_digest(_items(e.ntfs_aces))


on_estate()(review_snapshot)
