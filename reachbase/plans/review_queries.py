"""Queries on review campaigns and on what collectors hand in, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachbase.functions.tables import cut
from reachbase.operators import campaigns, graph, history, intake
from reachbase.plans import history_queries as past
from reachbase.plans.access_queries import TOKENS
from reachbase.plans.estate import Estate, project
from reachbase.plans.oracle import sql
from reachbase.plans.report_queries import _DIRECTION, _IMPACT, _T1, _T2, _at, _entry_log, _impact

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def on_estate(body: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(project(spark, sf_dir))
        ORACLE[f.__name__] = sql(body)
        return f

    return add


def on_log(body: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(past.log(spark, sf_dir))
        ORACLE[f.__name__] = past.LOG + body
        return f

    return add


def on_runs(body: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(past.runs(spark, sf_dir))
        ORACLE[f.__name__] = past.RUNS + body
        return f

    return add


# Three campaigns: servers that overlap with shares, trees, and principals; and one whose scope its focus does not know.

_SELECTED = """, sure AS (SELECT *, CASE WHEN order_index % 3 = 1 THEN 'inferred' ELSE 'observed' END AS certainty FROM ntfs_aces),
g AS (SELECT 'resource' AS target_kind, resource_key AS target_key, trustee_key AS principal_key, ace_key AS entry_key, ace_type, '0x' || lpad(lower(to_hex(access_mask)), 8, '0') AS rights, ace_flags & 16 <> 0 AS inherited, certainty FROM sure
  UNION ALL SELECT 'share', share_key, trustee_key, ace_key, ace_type, permission, false, 'observed' FROM share_aces),
places AS (SELECT 'resource' AS target_kind, resource_key AS target_key, server_key, share_key, parent_key, depth FROM resources UNION ALL SELECT 'share', share_key, server_key, share_key, NULL, NULL FROM shares),
picked AS (SELECT 'servers' AS campaign, g.* FROM g JOIN places p ON p.target_kind = g.target_kind AND p.target_key = g.target_key WHERE substr(server_key, 6)::int % 2 = 0 OR length(share_key) % 2 = 0
  UNION ALL SELECT 'trees', g.* FROM g JOIN places p ON p.target_kind = g.target_kind AND p.target_key = g.target_key WHERE (depth = 1 AND length(p.target_key) % 2 = 0) OR (depth = 2 AND length(parent_key) % 2 = 0)
  UNION ALL SELECT 'people', g.* FROM g JOIN principals p ON p.principal_key = g.principal_key WHERE kind IN ('group', 'managed_service_account')),
judged AS (SELECT *, CASE WHEN inherited THEN 'inherited' WHEN principal_key NOT LIKE 'S-1-5-21-%' THEN 'builtin_trustee' WHEN ace_type = 'deny' THEN 'deny' END AS reason FROM picked),
items AS (SELECT campaign, target_kind, target_key, j.principal_key, any_value(name) AS principal_name, count(*) AS grants, count(*) > 1 AS complex, min(certainty) AS certainty, sha256(string_agg(entry_key || '|' || ace_type || '|' || rights, chr(10) ORDER BY entry_key || '|' || ace_type || '|' || rights)) AS digest
  FROM judged j LEFT JOIN principals p ON p.principal_key = j.principal_key WHERE reason IS NULL GROUP BY 1, 2, 3, 4)"""


def _scopes(e: Estate) -> DataFrame:
    scope = lambda rows, campaign, focus, kind, key: rows.select(F.lit(campaign).alias("campaign"), F.lit(focus).alias("focus"), F.lit(kind).alias("scope_kind"), key.alias("scope_key"))
    out = scope(e.servers.where(F.substring("server_key", 6, 9).cast("int") % 2 == 0), "servers", "resource", "server", F.upper("server_key"))
    out = out.unionByName(scope(e.shares.where(F.length("share_key") % 2 == 0), "servers", "resource", "share", F.col("share_key")))
    out = out.unionByName(scope(e.resources.where("depth = 1").where(F.length("resource_key") % 2 == 0), "trees", "resource", "directory_tree", F.concat(F.upper("resource_key"), F.lit("\\"))))
    out = out.unionByName(scope(e.principals.where("kind IN ('group', 'managed_service_account')"), "people", "principal", "principal", F.col("principal_key")))
    return out.unionByName(scope(e.principals.where("kind = 'group'"), "nothing", "resource", "principal", F.col("principal_key")))


def _judged(e: Estate) -> DataFrame:
    sure = e.with_(ntfs_aces=e.ntfs_aces.withColumn("certainty", F.when(F.col("order_index") % 3 == 1, "inferred").otherwise("observed")))
    return campaigns.with_reason(campaigns.selected(sure, _scopes(e)))


@on_estate(_SELECTED + " SELECT campaign, coalesce(reason, 'included') AS reason, count(*) AS n FROM judged GROUP BY 1, 2")
def campaign_exclusions(e: Estate) -> DataFrame:
    return campaigns.tally(_judged(e))


@on_estate(_SELECTED + " SELECT * FROM items")
def campaign_items(e: Estate) -> DataFrame:
    return campaigns.items(_judged(e), e.principals)


_ASSIGNED = _SELECTED + """, asks AS (SELECT 'all servers' AS id, 'servers' AS campaign, 1 AS assigned_at, NULL AS scope_kind, NULL AS scope_key
  UNION ALL SELECT 'server ' || server_key, 'servers', 2 + substr(server_key, 6)::int % 4, 'server', server_key FROM servers WHERE substr(server_key, 6)::int % 3 = 0
  UNION ALL SELECT 'share ' || share_key, 'servers', 3, 'share', share_key FROM shares WHERE length(share_key) % 3 = 0
  UNION ALL SELECT 'about ' || principal_key, 'servers', 4, 'principal', principal_key FROM principals WHERE kind = 'group' AND length(name) % 3 = 0
  UNION ALL SELECT 'tree ' || resource_key, 'trees', 2, 'directory_tree', resource_key FROM resources WHERE depth = 1 AND length(resource_key) % 3 = 0),
held AS (SELECT i.campaign, i.target_kind, i.target_key, i.principal_key, a.id, a.assigned_at FROM items i JOIN asks a ON a.campaign = i.campaign AND scope_kind IS NULL
  UNION ALL SELECT i.campaign, i.target_kind, i.target_key, i.principal_key, a.id, a.assigned_at FROM items i JOIN asks a ON a.campaign = i.campaign AND scope_kind = 'principal' AND scope_key = i.principal_key
  UNION ALL SELECT i.campaign, i.target_kind, i.target_key, i.principal_key, a.id, a.assigned_at FROM items i JOIN places p ON p.target_kind = i.target_kind AND p.target_key = i.target_key JOIN asks a ON a.campaign = i.campaign AND scope_key = CASE scope_kind WHEN 'server' THEN p.server_key WHEN 'share' THEN p.share_key END
  UNION ALL SELECT i.campaign, i.target_kind, i.target_key, i.principal_key, a.id, a.assigned_at FROM items i JOIN asks a ON a.campaign = i.campaign AND scope_kind = 'directory_tree' AND i.target_kind = 'resource' JOIN places p ON p.target_kind = 'resource' AND p.target_key = i.target_key AND a.scope_key IN (p.target_key, p.parent_key)),
kept AS (SELECT campaign, target_kind, target_key, principal_key, id FROM held QUALIFY row_number() OVER (PARTITION BY campaign, target_kind, target_key, principal_key ORDER BY assigned_at DESC, id DESC) = 1),
assigned AS (SELECT i.*, k.id AS assignment_id FROM items i LEFT JOIN kept k ON k.campaign = i.campaign AND k.target_kind = i.target_kind AND k.target_key = i.target_key AND k.principal_key = i.principal_key)"""


def _assignments(e: Estate) -> DataFrame:
    null = F.lit(None).cast("string")
    number = F.substring("server_key", 6, 9).cast("int")

    def ask(rows: DataFrame, id_, campaign: str, at, kind, key) -> DataFrame:
        return rows.select(id_.alias("assignment_id"), F.lit(campaign).alias("campaign"), at.alias("assigned_at"), kind.alias("scope_kind"), key.alias("scope_key"))

    out = ask(e.servers.sparkSession.range(1), F.lit("all servers"), "servers", F.lit(1), null, null)
    out = out.unionByName(ask(e.servers.where(number % 3 == 0), F.concat(F.lit("server "), "server_key"), "servers", 2 + number % 4, F.lit("server"), F.col("server_key")))
    out = out.unionByName(ask(e.shares.where(F.length("share_key") % 3 == 0), F.concat(F.lit("share "), "share_key"), "servers", F.lit(3), F.lit("share"), F.col("share_key")))
    out = out.unionByName(ask(e.principals.where("kind = 'group'").where(F.length("name") % 3 == 0), F.concat(F.lit("about "), "principal_key"), "servers", F.lit(4), F.lit("principal"), F.col("principal_key")))
    out = out.unionByName(ask(e.resources.where("depth = 1").where(F.length("resource_key") % 3 == 0), F.concat(F.lit("tree "), "resource_key"), "trees", F.lit(2), F.lit("directory_tree"), F.col("resource_key")))
    size = F.length("assignment_id")
    return out.withColumns({"reviewer": F.concat(F.lit("r"), (size % 4).cast("string")), "due_at": F.date_add(F.lit("2024-01-01").cast("date"), size), "revoked": size % 5 == 0})


@on_estate(_ASSIGNED + " SELECT campaign, target_kind, target_key, principal_key, assignment_id FROM assigned")
def campaign_assignments(e: Estate) -> DataFrame:
    e = e.with_(ntfs_aces=cut(e.ntfs_aces), share_aces=cut(e.share_aces))
    return campaigns.assigned(e, cut(campaigns.items(_judged(e), e.principals)), _assignments(e)).select(*campaigns.ITEM, "assignment_id")


@on_estate(_ASSIGNED + " SELECT 'r' || length(assignment_id) % 4 AS reviewer, campaign, count(*) AS assigned, count_if(length(target_key) % 2 = 0)::bigint AS decided, min(DATE '2024-01-01' + length(assignment_id)::int) AS earliest_due FROM assigned WHERE assignment_id IS NOT NULL AND length(assignment_id) % 5 <> 0 GROUP BY 1, 2")
def reviewer_queue(e: Estate) -> DataFrame:
    """Both campaigns run; an item whose target's key has an even length is decided."""
    e = e.with_(ntfs_aces=cut(e.ntfs_aces), share_aces=cut(e.share_aces))
    asks = _assignments(e)
    rows = campaigns.assigned(e, cut(campaigns.items(_judged(e), e.principals)), asks).withColumn("decided", F.length("target_key") % 2 == 0)
    running = e.servers.sparkSession.createDataFrame([("servers", "active"), ("trees", "active"), ("people", "closed")], "campaign string, status string")
    return campaigns.queue(rows, asks, running)


_ASKED = _IMPACT[_IMPACT.index("asked AS (") : _IMPACT.index(",\npf AS")]
_OF_ITEMS = "asked AS (SELECT DISTINCT i.principal_key, r.resource_key, r.share_key, r.dacl_present, coalesce(r.owner_key = i.principal_key, false) AS owner FROM then_items i JOIN resources r ON r.resource_key = i.target_key WHERE i.principal_key IN (SELECT principal_key FROM principals WHERE kind IN ('user', 'managed_service_account')))"
_THEN = """then_items AS (SELECT resource_key AS target_key, trustee_key AS principal_key, string_agg(ace_key, '/' ORDER BY ace_key) AS entries FROM aces_1 WHERE ace_flags & 16 = 0 AND trustee_key LIKE 'S-1-5-21-%' AND ace_type = 'allow' GROUP BY 1, 2),
now_items AS (SELECT resource_key AS target_key, trustee_key AS principal_key, string_agg(ace_key, '/' ORDER BY ace_key) AS entries FROM aces_2 GROUP BY 1, 2), """
_CONTEXT = _IMPACT.replace(_ASKED.replace("asked AS", "asked2 AS"), _OF_ITEMS.replace("asked AS", "asked2 AS")).replace(_ASKED, _THEN + _OF_ITEMS)


@on_estate(_CONTEXT + f""", moved AS (SELECT resource_key, count(*) AS changes, max(valid_from) AS last_change FROM elog WHERE valid_from > DATE '{_T1}' AND valid_from <= DATE '{_T2}' GROUP BY 1), held AS (SELECT group_key, count(*) AS n FROM reach GROUP BY 1)
SELECT 'estate' AS campaign, 'resource' AS target_kind, i.target_key, i.principal_key, CASE WHEN r.depth = 2 AND length(r.resource_key) % 11 = 0 THEN 'target_removed' WHEN n.entries IS NULL THEN 'removed' WHEN n.entries = i.entries THEN 'unchanged' ELSE 'modified' END AS drift, r.resource_key,
  b.before AS baseline_rights, CASE WHEN NOT (r.depth = 2 AND length(r.resource_key) % 11 = 0) THEN b.after END AS current_rights, CASE WHEN before IS NOT NULL AND NOT (r.depth = 2 AND length(r.resource_key) % 11 = 0) THEN {_DIRECTION} END AS direction,
  CASE WHEN NOT r.dacl_present OR r.dacl_protected THEN 1 ELSE 0 END::bigint AS findings, CASE WHEN NOT r.dacl_present THEN 'critical' WHEN r.dacl_protected THEN 'high' END AS worst, coalesce(m.changes, 0)::bigint AS changes, m.last_change, coalesce(h.n, 0)::bigint AS n_members
FROM then_items i JOIN resources r ON r.resource_key = i.target_key LEFT JOIN now_items n ON n.target_key = i.target_key AND n.principal_key = i.principal_key LEFT JOIN both_ b ON b.resource_key = i.target_key AND b.principal_key = i.principal_key LEFT JOIN moved m ON m.resource_key = i.target_key LEFT JOIN held h ON h.group_key = i.principal_key""")
def review_context(e: Estate) -> DataFrame:
    """All lists reviewed as they were, beside what they became; some folders are gone by then."""
    e = e.with_(ntfs_aces=cut(e.ntfs_aces), resources=cut(e.resources))
    before, now = _at(e, _T1), _at(e, _T2)
    now = now.with_(resources=now.resources.where(~((F.col("depth") == 2) & (F.length("resource_key") % 11 == 0))))
    lists = campaigns.grants(before).where("target_kind = 'resource'").withColumn("campaign", F.lit("estate"))
    items = cut(campaigns.items(campaigns.with_reason(lists), before.principals))
    findings = e.resources.where("NOT dacl_present OR dacl_protected").select("resource_key", F.when(~F.col("dacl_present"), "critical").otherwise("high").alias("severity"))
    moved = _entry_log(e).where((F.col("valid_from") > F.lit(_T1).cast("date")) & (F.col("valid_from") <= F.lit(_T2).cast("date"))).select("resource_key", F.col("valid_from").alias("at"))
    reach = graph.closure(e.edges).groupBy(F.col("group_key").alias("principal_key")).agg(F.count("*").alias("n_members"))
    return campaigns.context(items, before, now, findings, moved, reach)


@on_estate(_IMPACT + f""", d AS (SELECT principal_key, resource_key, {_DIRECTION} AS direction FROM both_)
SELECT count(*) AS evaluated, count_if(direction = 'gain')::bigint AS gain, count_if(direction = 'expand')::bigint AS expand, count_if(direction = 'lose')::bigint AS lose, count_if(direction = 'reduce')::bigint AS reduce, count_if(direction = 'change')::bigint AS change, count_if(direction = 'same')::bigint AS same,
  count(DISTINCT CASE WHEN direction IN ('gain', 'expand') THEN principal_key END) AS principals_gaining, count(DISTINCT CASE WHEN direction IN ('lose', 'reduce') THEN principal_key END) AS principals_losing, count(DISTINCT CASE WHEN direction <> 'same' THEN resource_key END) AS resources_affected FROM d""")
def impact_summary(e: Estate) -> DataFrame:
    return campaigns.impact_summary(_impact(e))


@on_estate(_IMPACT + f""", d AS (SELECT principal_key, resource_key, {_DIRECTION} AS direction FROM both_) SELECT principal_key, resource_key, direction FROM d ORDER BY CASE direction WHEN 'gain' THEN 0 WHEN 'expand' THEN 1 WHEN 'lose' THEN 2 WHEN 'reduce' THEN 3 WHEN 'change' THEN 4 ELSE 5 END, resource_key, principal_key LIMIT 100""")
def gravest_deltas(e: Estate) -> DataFrame:
    """The first page."""
    rows = _impact(e).select("principal_key", "resource_key", "direction")
    return rows.orderBy(*campaigns.gravest_first(rows)).limit(100)


# What collectors hand in

_CLAIMED = f""", now_ AS (SELECT key, valid_from, last_seen_at, state FROM log WHERE valid_to IS NULL), k AS (SELECT key, key::int AS n, state FROM now_),
o AS (SELECT key, CASE WHEN n % 7 = 0 THEN 'unknown_object' WHEN n % 7 = 1 THEN 'no_stored_digest' WHEN n % 7 = 2 THEN 'digest_mismatch' WHEN n % 7 = 3 THEN 'untracked' WHEN state IS NULL THEN 'absent' ELSE 'applied' END AS outcome FROM k)"""


def _claims(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log with sessions as entries of their own object, outcomes): claims on all objects, twice, the later one counts."""
    n = F.col("key").cast("int")
    keys_ = v.select("key").distinct()
    at = past._at(past.T3) + F.expr("INTERVAL 30 DAYS")
    claims = keys_.select("key", F.when(n % 7 == 2, "other").otherwise(F.concat(F.lit("d"), "key")).alias("digest"), at.alias("observed_at"))
    early = keys_.select("key", F.lit("early").alias("digest"), past._at(past.T1).alias("observed_at"))
    stored = keys_.where(n % 7 != 0).select("key", F.when(n % 7 != 1, F.concat(F.lit("d"), "key")).alias("digest"))
    tracked = v.where(~((n % 7 == 3) & F.col("valid_to").isNull()))
    return tracked, intake.affirmations(claims.unionByName(early), stored, tracked, "session")


@on_log(_CLAIMED + " SELECT key, outcome FROM o")
def affirmation_outcomes(v: DataFrame) -> DataFrame:
    return _claims(v)[1].select("key", "outcome")


@on_log(_CLAIMED + f" SELECT key, valid_from, CASE WHEN valid_to IS NULL AND outcome = 'applied' THEN greatest(last_seen_at, TIMESTAMP '{past.T3}' + INTERVAL 30 DAY) ELSE last_seen_at END AS last_seen_at FROM log LEFT JOIN o USING (key) WHERE NOT (valid_to IS NULL AND key::int % 7 = 3)")
def confirmed_by_affirmation(v: DataFrame) -> DataFrame:
    tracked, outcomes = _claims(v)
    return intake.confirm(tracked, outcomes, "session", "part").select("key", "valid_from", "last_seen_at")


_RUN_SCOPES = """, done AS (SELECT run_id, collector AS scope_kind, target AS scope_key, status = 'succeeded' AS reconciled, CASE WHEN run_id % 3 = 0 THEN 'full' ELSE 'delta' END AS mode, started_at AS at FROM runs WHERE status <> 'failed')
SELECT d.run_id, d.scope_kind, d.scope_key, CASE WHEN d.run_id % 2 = 0 THEN d.run_id % 40 ELSE 0 END::bigint AS marked_absent, CASE WHEN d.run_id % 2 = 0 THEN d.run_id % 5 ELSE 0 END::bigint AS revived, count_if(x.mode = 'delta' AND (p.at IS NULL OR x.at > p.at))::bigint AS delta_runs_since
FROM done d LEFT JOIN (SELECT a.run_id, max(b.at) AS at FROM done a JOIN done b ON b.scope_kind = a.scope_kind AND b.scope_key = a.scope_key AND b.reconciled AND b.at < a.at GROUP BY 1) p ON p.run_id = d.run_id JOIN done x ON x.scope_kind = d.scope_kind AND x.scope_key = d.scope_key AND x.at <= d.at WHERE d.reconciled GROUP BY ALL"""


@on_runs(_RUN_SCOPES)
def scope_drift(r: DataFrame) -> DataFrame:
    place = ["run_id", F.col("collector").alias("scope_kind"), F.col("target").alias("scope_key")]
    n = F.col("run_id")
    runs = r.select("run_id", F.when(n % 3 == 0, "full").otherwise("delta").alias("mode"), F.when(F.col("status") != "failed", F.col("started_at")).alias("completed_at"))
    corrected = r.where("run_id % 2 = 0").select(*place, (n % 40).alias("marked_absent"), (n % 5).alias("revived"))
    return intake.drift(r.select(*place, (F.col("status") == "succeeded").alias("reconciled")), runs, corrected)


@on_runs("SELECT run_id, CASE WHEN run_id % 5 = 3 THEN 'conflict' WHEN run_id % 2 = 0 THEN CASE WHEN run_id % 3 = 0 THEN 'conflict' ELSE 'replayed' END ELSE 'created' END AS outcome FROM runs")
def run_starts(r: DataFrame) -> DataFrame:
    """Every second run is stored; scopes come in another order, of each third envelope with one more, and each fifth run is announced in two ways."""
    n = F.col("run_id")
    face = lambda scopes, mode="full": r.select("run_id", F.col("collector").alias("source"), F.lit(mode).alias("mode"), F.lit(None).cast("string").alias("job"), "started_at", scopes.alias("scopes"))
    target = F.col("target")
    sent = face(F.when(n % 3 == 0, F.array(F.lit("z"), target, F.lit("a"))).otherwise(F.array(target, F.lit("a"), target)))
    again = face(F.array(F.lit("a"), target), "delta").where(n % 5 == 3)
    return intake.started(face(F.array(F.lit("a"), target)).where(n % 2 == 0), sent.unionByName(again))


@on_estate("""SELECT share_key, sha256('{"name":"' || name || '","server_key":"' || server_key || '","share_key":"' || share_key || '"}') AS digest FROM shares""")
def state_digests(e: Estate) -> DataFrame:
    """Who saw a share, and when, is not part of its state."""
    rows = e.shares.withColumns({"run_id": F.length("name"), "observed_at": F.current_date()})
    return rows.select("share_key", intake.state_digest(rows).alias("digest"))


def provenance_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the entries and memberships asked for; their last runs are orders, one of nine unknown, and the sources are collectors."""
    e, runs = project(spark, sf_dir), past.runs(spark, sf_dir)
    day = F.lit("2024-01-01").cast("date")

    def seen(rows: DataFrame, key) -> DataFrame:
        n = F.length(key)
        run = F.when(n % 9 != 0, n * 32 + 1).otherwise(F.lit(-1)).cast("long")
        return rows.select(key.alias("key"), F.lit("row").alias("source_key"), day.alias("first_observed_at"), F.lit(1).cast("long").alias("first_observed_run_id"), F.date_add(day, n).alias("last_observed_at"), run.alias("last_observed_run_id"))

    edge = F.concat("group_key", F.lit("->"), "member_key")
    tables = {"ntfs_ace": (seen(e.ntfs_aces, F.col("ace_key")), "key"), "smb_share_ace": (seen(e.share_aces, F.col("ace_key")), "key"), "membership_edge": (seen(e.edges, edge), "key")}
    asked = [rows.select(F.lit(record).alias("record"), "key").where(F.length("key") % 2 == 0) for record, (rows, _) in tables.items()]
    asked.append(e.servers.select(F.lit("ntfs_ace").alias("record"), F.col("server_key").alias("key")))
    every = asked[0].unionByName(asked[1]).unionByName(asked[2]).unionByName(asked[3])
    sources = runs.select(F.col("collector").alias("source_id"), F.lower("collector").alias("collector"), F.lit("scan").alias("method")).distinct()
    return intake.provenance(every, tables, runs.select("run_id", F.col("collector").alias("source_id"), "status"), sources).select("record", "key", "last_observed_at", "last_observed_run_id", "collector", "method", "last_run_status")


QUERIES["provenance_of_rows"] = provenance_of_rows
ORACLE["provenance_of_rows"] = sql("""SELECT record, key, DATE '2024-01-01' + length(key)::int AS last_observed_at, CASE WHEN length(key) % 9 <> 0 THEN length(key) * 32 + 1 ELSE -1 END::bigint AS last_observed_run_id, lower(o_orderpriority) AS collector, CASE WHEN o_orderkey IS NOT NULL THEN 'scan' END AS method, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' WHEN 'P' THEN 'partial' END AS last_run_status
FROM (SELECT 'ntfs_ace' AS record, ace_key AS key FROM ntfs_aces UNION ALL SELECT 'smb_share_ace', ace_key FROM share_aces UNION ALL SELECT 'membership_edge', group_key || '->' || member_key FROM edges) x
LEFT JOIN orders ON o_orderkey = CASE WHEN length(key) % 9 <> 0 THEN length(key) * 32 + 1 ELSE -1 END WHERE length(key) % 2 = 0""")
