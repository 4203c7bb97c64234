"""What findings rest on: their evidence as rows, whether it is enough to find them again, and whom they are told to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.functions import keys
from reachbase.functions.tables import cut
from reachbase.operators import acl, risk
from reachbase.plans.estate import Estate

_ENTRY = ("trustee_key", "ace_type", "access_mask", "ace_flags", "order_index")
_ENTRY_TYPE = "trustee_key string, ace_type string, access_mask bigint, ace_flags int, order_index int"


def of_broad_access(e: Estate, findings: DataFrame) -> DataFrame:
    """finding_key, kind, key, record for findings (finding_key, rule, resource_key): each entry that names the rule's trustee, and the list's own row."""
    asked = findings.select("finding_key", "rule", "resource_key")
    named = acl.considered(e.ntfs_aces).withColumn("rule", risk.broad_rule(F.col("trustee_key"))).join(asked, ["rule", "resource_key"])
    plain = {"ignoreNullFields": "false"}
    entries = named.select("finding_key", F.lit("ntfs_ace").alias("kind"), F.col("ace_key").alias("key"), F.to_json(F.struct(*_ENTRY), plain).alias("record"))
    lists = e.resources.join(asked.select("finding_key", "resource_key"), "resource_key")
    return entries.unionByName(lists.select("finding_key", F.lit("ntfs_resource").alias("kind"), F.col("resource_key").alias("key"), F.to_json(F.struct("dacl_present"), plain).alias("record")))


def canonical(evidence: DataFrame) -> DataFrame:
    """One row for each finding, kind and key; of two records under one key the least stays, in whatever order they came."""
    return evidence.groupBy("finding_key", "kind", "key").agg(F.min("record").alias("record"))


def digests(evidence: DataFrame) -> DataFrame:
    """finding_key, items, digest: over the canonical set in the order of kind and key, so that neither order nor repeats count.

    The items of a finding are entries of one trustee on one list, which is cut at a fixed length before.
    """
    item = F.struct("kind", "key", "record")
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws("\t", x["kind"], x["key"], x["record"]))
    return canonical(evidence).groupBy("finding_key").agg(F.count("*").alias("items"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def reproduced(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding_key, outcome, severity_now: whether findings (finding_key, rule, severity) come out again from their evidence and nothing else.

    Each finding becomes a list of its own that holds only what it cites, so one run of the rules tries all of them apart from each other.  reproduced,
    changed_severity (the same finding, graded otherwise now), or unreproduced: the rule had read what it does not cite.
    """
    cited = cut(canonical(evidence))
    aces = cited.where("kind = 'ntfs_ace'").select(F.col("finding_key").alias("resource_key"), F.from_json("record", _ENTRY_TYPE).alias("r"), F.col("key").alias("ace_key")).select("resource_key", "r.*", "ace_key")
    lists = cited.where("kind = 'ntfs_resource'").select(F.col("finding_key").alias("resource_key"), F.from_json("record", "dacl_present boolean")["dacl_present"].alias("dacl_present"))
    again = risk.broad_findings(aces, lists).groupBy(F.col("resource_key").alias("finding_key"), "rule").agg(F.max(F.struct(risk.rank(F.col("severity"), risk.SEVERITIES), "severity"))["severity"].alias("severity_now"))
    rows = findings.select("finding_key", "rule", "severity").join(again, ["finding_key", "rule"], "left")
    outcome = F.when(F.col("severity_now").isNull(), "unreproduced").when(F.col("severity_now") == F.col("severity"), "reproduced").otherwise("changed_severity")
    return rows.select("finding_key", outcome.alias("outcome"), "severity_now")


def matching(
    findings: DataFrame, statuses: tuple[str, ...] = ("open",), rules: tuple[str, ...] = (), severities: tuple[str, ...] = (), confidences: tuple[str, ...] = (),
    place: str | None = None, principal: str | None = None, first_seen_from: Column | None = None, last_seen_to: Column | None = None,
) -> DataFrame:
    """Findings that pass every filter that is set; ``place`` is a server, a share's key or a path, and holds all that lies in it."""
    rows = findings.where(F.col("status").isin(*statuses))
    for column, names in (("rule", rules), ("severity", severities), ("confidence", confidences)):
        rows = rows.where(F.col(column).isin(*names)) if names else rows
    if place is not None:
        root = place.strip().lower().replace("/", "\\")
        root = root.rstrip("\\") if root.startswith("\\\\") else "\\\\" + root.replace("|", "\\")
        rows = rows.where(keys.under(F.col("resource_key"), root))
    if principal is not None:
        rows = rows.where(F.lower("principal_key") == principal.strip().lower())
    if first_seen_from is not None:
        rows = rows.where(F.col("first_detected") >= first_seen_from)
    return rows if last_seen_to is None else rows.where(F.col("last_evaluated") <= last_seen_to)


def events(outcomes: DataFrame, threshold: str = "critical") -> DataFrame:
    """alert, finding_key, at, digest, ends from what became of findings (finding_key, resource_key, severity, outcome, at, digest).

    A finding that opened or reopened at the threshold or above is told of, estate-wide and without a watch; one that was resolved ends its alert whatever its
    severity is by then.  The alert's key rests on finding and place alone, so a resolution can only end what its own finding began.
    """
    told = F.col("outcome").isin("opened", "reopened") & (risk.rank(F.col("severity"), risk.SEVERITIES) >= risk.SEVERITIES.index(threshold))
    ends = F.col("outcome") == "resolved"
    alert = F.sha2(F.concat_ws("\n", F.lit("critical_risk_finding_opened"), "resource_key", "finding_key"), 256)
    return outcomes.where(told | ends).select(alert.alias("alert"), "finding_key", "at", "digest", ends.alias("ends"))
