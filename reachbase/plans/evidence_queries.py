"""Queries on the evidence of findings, on filters and on what is told, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.functions import masks
from reachbase.functions.tables import cut
from reachbase.operators import changes, evidence, operations, risk
from reachbase.plans import risk_queries
from reachbase.plans.estate import Estate, project
from reachbase.plans.oracle import sql
from reachbase.plans.risk_queries import _BROAD

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def on_estate(body: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(project(spark, sf_dir))
        ORACLE[f.__name__] = sql(body)
        return f

    return add


_KEYED = _BROAD + ", keyed AS (SELECT *, sha256('rule=' || rule || chr(10) || 'resource_key=' || resource_key) AS finding_key, length(resource_key) AS n FROM found)"


def _keyed(e: Estate) -> DataFrame:
    return cut(risk.keyed(risk.broad_access(e), ["resource_key"], ["band", "rights"]))


@on_estate(_KEYED + """, named AS (SELECT CASE WHEN trustee_key = 'S-1-1-0' THEN 'everyone_broad_access' WHEN trustee_key = 'S-1-5-11' THEN 'authenticated_users_broad_access' WHEN trustee_key LIKE 'S-1-5-21-%-513' THEN 'domain_users_broad_access' END AS rule, * FROM ntfs_aces),
ev AS (SELECT finding_key, 'ntfs_ace' || chr(9) || ace_key || chr(9) || '{"trustee_key":"' || trustee_key || '","ace_type":"' || ace_type || '","access_mask":' || access_mask || ',"ace_flags":' || ace_flags || ',"order_index":' || order_index || '}' AS line FROM keyed JOIN named ON named.rule = keyed.rule AND named.resource_key = keyed.resource_key
  UNION ALL SELECT finding_key, 'ntfs_resource' || chr(9) || resource_key || chr(9) || '{"dacl_present":' || dacl_present::varchar || '}' FROM keyed JOIN resources USING (resource_key))
SELECT finding_key, count(*) AS items, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM ev GROUP BY 1""")
def finding_evidence(e: Estate) -> DataFrame:
    e = e.with_(ntfs_aces=cut(e.ntfs_aces))
    return evidence.digests(evidence.of_broad_access(e, _keyed(e)))


@on_estate(_KEYED + """, low(rule, s) AS (VALUES ('everyone_broad_access', 'high'), ('authenticated_users_broad_access', 'medium'), ('domain_users_broad_access', 'low')),
o AS (SELECT finding_key, severity, s, CASE WHEN band = 'null_dacl' THEN severity WHEN n % 7 = 0 THEN NULL WHEN n % 11 = 0 THEN s ELSE severity END AS severity_now FROM keyed JOIN low USING (rule))
SELECT finding_key, CASE WHEN severity_now IS NULL THEN 'unreproduced' WHEN severity_now = severity THEN 'reproduced' ELSE 'changed_severity' END AS outcome, severity_now FROM o""")
def findings_reproduced(e: Estate) -> DataFrame:
    """From whole evidence, from none of the entries, and from entries that only allow reading."""
    e = e.with_(ntfs_aces=cut(e.ntfs_aces))
    found = _keyed(e)
    n = F.length("resource_key")
    weak = e.ntfs_aces.where(n % 7 != 0).withColumns({"access_mask": F.when(n % 11 == 0, F.lit(masks.CATEGORIES["read"]).cast("long")).otherwise(F.col("access_mask")), "ace_type": F.when(n % 11 == 0, "allow").otherwise(F.col("ace_type"))})
    return evidence.reproduced(found, evidence.of_broad_access(e.with_(ntfs_aces=weak), found))


@on_estate(_KEYED + " SELECT finding_key FROM keyed WHERE n % 3 <> 0 AND severity IN ('high', 'critical') AND starts_with(resource_key, '\\\\brand1\\') AND n >= 20 UNION ALL SELECT finding_key FROM keyed WHERE n % 3 = 0 AND rule = 'everyone_broad_access'")
def findings_matching(e: Estate) -> DataFrame:
    n = F.length("resource_key")
    rows = _keyed(e).withColumns({"status": F.when(n % 3 == 0, "resolved").otherwise("open"), "first_detected": n, "last_evaluated": n, "principal_key": F.when(F.col("rule") == "everyone_broad_access", "S-1-1-0")})
    a = evidence.matching(rows, severities=("high", "critical"), place="//BRAND1/", first_seen_from=F.lit(20))
    return a.unionByName(evidence.matching(rows, ("resolved",), principal="s-1-1-0 ")).select("finding_key")


_OUTCOMES = _KEYED + ", oc AS (SELECT *, CASE n % 4 WHEN 0 THEN 'opened' WHEN 1 THEN 'reopened' WHEN 2 THEN 'resolved' ELSE 'reaffirmed' END AS outcome FROM keyed), told AS (SELECT sha256('critical_risk_finding_opened' || chr(10) || resource_key || chr(10) || finding_key) AS alert, finding_key, outcome = 'resolved' AS ends FROM oc WHERE (outcome IN ('opened', 'reopened') AND severity = 'critical') OR outcome = 'resolved')"


def _events(e: Estate) -> DataFrame:
    n = F.length("resource_key") % 4
    outcome = F.when(n == 0, "opened").when(n == 1, "reopened").when(n == 2, "resolved").otherwise("reaffirmed")
    return evidence.events(_keyed(e).withColumns({"outcome": outcome, "at": F.lit("2024-01-01").cast("timestamp_ntz"), "digest": F.col("evidence_digest")}))


@on_estate(_OUTCOMES + " SELECT alert, finding_key, ends FROM told")
def finding_events(e: Estate) -> DataFrame:
    return _events(e).select("alert", "finding_key", "ends")


@on_estate(_OUTCOMES + ", box AS (SELECT CASE WHEN ends THEN 'delivered' WHEN ascii(alert) % 2 = 0 THEN 'pending' ELSE 'failed' END AS status FROM told) SELECT s AS status, coalesce(n, 0)::bigint AS n FROM (VALUES ('pending'), ('delivered'), ('failed'), ('abandoned')) v(s) LEFT JOIN (SELECT status, count(*) AS n FROM box GROUP BY 1) ON status = s")
def outbox_depth(e: Estate) -> DataFrame:
    """A message for each event."""
    status = F.when(F.col("ends"), "delivered").when(F.ascii("alert") % 2 == 0, "pending").otherwise("failed")
    return operations.facets(_events(e).select(status.alias("status")), "status", ["pending", "delivered", "failed", "abandoned"])


def admitted_changes(e: Estate) -> DataFrame:
    """Entries that came, graded medium or worse."""
    rows = e.ntfs_aces.select("ace_key", "ace_type", "trustee_key", F.when(F.col("order_index") % 2 == 0, "added").otherwise("removed").alias("action"), masks.expand_generic(F.col("access_mask")).alias("mask"))
    return changes.admitted(changes.graded(rows, changes.entry_grades()), "medium", ("added", "modified")).select("ace_key", "rule", "severity", "direction")


QUERIES["admitted_changes"] = lambda spark, sf_dir: admitted_changes(project(spark, sf_dir))
ORACLE["admitted_changes"] = "SELECT * FROM (" + risk_queries.ORACLE["entry_grades"] + ") WHERE severity IN ('medium', 'high', 'critical') AND rule NOT LIKE '%.removed'"
