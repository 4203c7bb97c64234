"""Queries on pairs, the past, reports and paging, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.functions import keys, masks, tables
from reachbase.operators import access, acl, changes, graph, history, operations, risk, simulate
from reachbase.plans import access_queries as base
from reachbase.plans import history_queries as past
from reachbase.plans.access_queries import FOLD, REACH, TOKENS
from reachbase.plans.estate import Estate
from reachbase.plans.risk_queries import _BROAD

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _moved(name: str, home) -> None:
    QUERIES[name] = home.QUERIES.pop(name)
    if name in home.ORACLE:
        ORACLE[name] = home.ORACLE.pop(name)


def on_estate(body: str | None = None):
    def add(f):
        base.on_estate(body)(f)
        _moved(f.__name__, base)
        return f

    return add


def on_log(body: str | None = None):
    def add(f):
        past.on_log(body)(f)
        _moved(f.__name__, past)
        return f

    return add


def on_runs(body: str | None = None):
    def add(f):
        past.on_runs(body)(f)
        _moved(f.__name__, past)
        return f

    return add


# Owners against what they own, and a user against a leaf of the same number.

_PAIRS = TOKENS + """, asked AS (SELECT owner_key AS principal_key, resource_key, share_key, dacl_present, true AS owner FROM resources WHERE owner_key IS NOT NULL
  UNION ALL SELECT p.principal_key, resource_key, share_key, dacl_present, false FROM resources JOIN principals p ON p.principal_key = 'S-1-5-21-1-1-1-' || (regexp_extract(resource_key, '\\\\p(\\d+)$', 1)::bigint + 100000) WHERE depth = 2),
pf AS (SELECT principal_key, resource_key, {fold} AS f FROM (SELECT k.principal_key, a.* FROM asked k JOIN {aces} a USING (resource_key) JOIN tokens t ON t.principal_key = k.principal_key AND t.sid = a.trustee_key
  UNION ALL SELECT k.principal_key, a.* FROM asked k JOIN {aces} a USING (resource_key) WHERE k.owner AND a.trustee_key = 'S-1-3-4') WHERE ace_flags & 8 = 0 GROUP BY 1, 2),
ps AS (SELECT k.principal_key, k.share_key, bit_or(CASE permission WHEN 'read' THEN 1179817::bigint WHEN 'change' THEN 1245631 ELSE 2032127 END) AS s FROM (SELECT DISTINCT principal_key, share_key FROM asked) k JOIN share_aces a USING (share_key) JOIN tokens t ON t.principal_key = k.principal_key AND t.sid = a.trustee_key GROUP BY 1, 2),
pr AS (SELECT k.principal_key, k.resource_key, k.owner AND q.resource_key IS NULL AS owner, h.resource_key IS NOT NULL AS h, (CASE WHEN NOT dacl_present THEN 2032127 ELSE coalesce(f.g, 0) END | CASE WHEN k.owner AND q.resource_key IS NULL THEN 393216 ELSE 0 END)::bigint AS n, CASE WHEN o.share_key IS NULL THEN 2032127 ELSE coalesce(s, 0) END::bigint AS s, coalesce(f.d, 0) AS d
  FROM asked k LEFT JOIN pf USING (principal_key, resource_key) LEFT JOIN ps ON ps.principal_key = k.principal_key AND ps.share_key = k.share_key LEFT JOIN (SELECT DISTINCT share_key FROM share_aces) o ON o.share_key = k.share_key
  LEFT JOIN (SELECT DISTINCT resource_key FROM {aces} WHERE trustee_key = 'S-1-3-4' AND ace_flags & 8 = 0) q ON q.resource_key = k.resource_key
  LEFT JOIN (SELECT DISTINCT resource_key FROM {aces} WHERE trustee_key LIKE 'S-1-5-21-%' AND trustee_key NOT IN (SELECT principal_key FROM principals) AND trustee_key NOT IN (SELECT group_key FROM edges)) h ON h.resource_key = k.resource_key)"""


def _pairs_sql(aces: str) -> str:
    return _PAIRS.replace("{fold}", FOLD).replace("{aces}", aces)


def asked_pairs(e: Estate) -> DataFrame:
    number = F.regexp_extract("resource_key", r"\\p(\d+)$", 1).cast("long") + 100000
    users = e.resources.where("depth = 2").select(F.concat(F.lit("S-1-5-21-1-1-1-"), number.cast("string")).alias("principal_key"), "resource_key").join(e.principals.select("principal_key"), "principal_key", "left_semi")
    return e.resources.where("owner_key IS NOT NULL").select(F.col("owner_key").alias("principal_key"), "resource_key").unionByName(users)


@on_estate(_pairs_sql("ntfs_aces") + " SELECT principal_key, resource_key, n AS ntfs_rights, s AS share_rights, n & s AS remote, CASE WHEN n & s <> 0 THEN 'granted' WHEN h THEN 'indeterminate' WHEN d <> 0 THEN 'denied' ELSE 'no_grant' END AS verdict FROM pr")
def pair_access(e: Estate) -> DataFrame:
    e = e.settled()
    return access.pair_access(e, asked_pairs(e)).select("principal_key", "resource_key", "ntfs_rights", "share_rights", "remote", "verdict")


@on_estate(_pairs_sql("ntfs_aces") + " SELECT principal_key, resource_key, n AS local, owner FROM pr")
def local_access(e: Estate) -> DataFrame:
    e = e.settled()
    return access.pair_access(e, asked_pairs(e)).select("principal_key", "resource_key", "local", "owner")


_RESTATED = """, restated AS (SELECT resource_key, trustee_key, ace_type, access_mask, ace_flags, order_index, ace_key FROM ntfs_aces UNION ALL SELECT resource_key, 'S-1-3-4', CASE WHEN length(resource_key) % 2 = 0 THEN 'allow' ELSE 'deny' END, 1179785, 0, -1, resource_key || '|owner' FROM resources WHERE owner_key IS NOT NULL AND dacl_present AND length(resource_key) % 3 = 0)"""


@on_estate(_pairs_sql("restated").replace(TOKENS, TOKENS + _RESTATED) + " SELECT principal_key, resource_key, n AS local, owner, n & s AS remote FROM pr")
def owner_rights_access(e: Estate) -> DataFrame:
    """With an entry for OWNER RIGHTS, that allows or denies reading, on one of three owned lists."""
    e = e.settled()
    new = e.resources.where("owner_key IS NOT NULL AND dacl_present AND length(resource_key) % 3 = 0").select(
        "resource_key", F.lit(keys.OWNER_RIGHTS).alias("trustee_key"), F.when(F.length("resource_key") % 2 == 0, "allow").otherwise("deny").alias("ace_type"), F.lit(1179785).cast("long").alias("access_mask"),
        F.lit(0).alias("ace_flags"), F.lit(-1).alias("order_index"), F.concat("resource_key", F.lit("|owner")).alias("ace_key"),
    )
    return access.pair_access(e.with_(ntfs_aces=e.ntfs_aces.unionByName(new)), asked_pairs(e)).select("principal_key", "resource_key", "local", "owner", "remote")


@on_estate("SELECT principal_key, CASE WHEN enabled IS NULL THEN 'unverified' WHEN enabled THEN 'mapped' ELSE 'disabled_machine' END AS local, 'not_presented' AS remote FROM principals")
def system_mapping(e: Estate) -> DataFrame:
    known, on = F.col("principal_key"), F.col("enabled")
    return e.principals.select("principal_key", access.system_mapping(known, on, F.lit(False)).alias("local"), access.system_mapping(known, on, F.lit(True)).alias("remote"))


# The estate in the past: entries come and go by their place in their list.

_T1, _T2 = "2021-06-01", "2023-06-01"
_ENTRY_LOG = ", elog AS (SELECT *, DATE '2020-01-01' + order_index * 200 AS valid_from, CASE WHEN order_index % 3 = 1 THEN DATE '2020-01-01' + order_index * 200 + 900 END AS valid_to FROM ntfs_aces), aces_{n} AS (SELECT * FROM elog WHERE valid_from <= DATE '{t}' AND (valid_to IS NULL OR valid_to > DATE '{t}'))"


def _entry_log(e: Estate) -> DataFrame:
    start = F.date_add(F.lit("2020-01-01").cast("date"), F.col("order_index") * 200)
    return e.ntfs_aces.withColumns({"valid_from": start, "valid_to": F.when(F.col("order_index") % 3 == 1, F.date_add(start, 900))})


def _at(e: Estate, t: str) -> Estate:
    return history.estate_at(e, {"ntfs_aces": _entry_log(e)}, F.lit(t).cast("date"))


def _log_sql(n: int, t: str) -> str:
    return _ENTRY_LOG.replace("{n}", str(n)).replace("{t}", t)


@on_estate(_log_sql(1, _T1) + _pairs_sql("aces_1") + " SELECT principal_key, resource_key, n & s AS remote FROM pr")
def access_as_of(e: Estate) -> DataFrame:
    e = e.settled()
    return access.pair_access(_at(e, _T1), asked_pairs(e)).select("principal_key", "resource_key", "remote")


_IMPACT = _log_sql(1, _T1) + _log_sql(2, _T2).replace(", elog AS", ", elog2 AS").replace("FROM elog WHERE", "FROM elog2 WHERE") + _pairs_sql("aces_1") + _pairs_sql("aces_2")[len(TOKENS):].replace("asked AS", "asked2 AS").replace("asked k", "asked2 k").replace("FROM asked)", "FROM asked2)").replace("pf AS", "pf2 AS").replace("JOIN pf ", "JOIN pf2 ").replace("\nps AS", "\nps2 AS").replace("JOIN ps ON ps.principal_key = k.principal_key AND ps.share_key", "JOIN ps2 ON ps2.principal_key = k.principal_key AND ps2.share_key").replace("\npr AS", "\npr2 AS")
_IMPACT += ", both_ AS (SELECT pr.principal_key, pr.resource_key, pr.n & pr.s AS before, pr2.n & pr2.s AS after FROM pr JOIN pr2 ON pr.principal_key = pr2.principal_key AND pr.resource_key = pr2.resource_key)"


def _impact(e: Estate) -> DataFrame:
    e = e.settled()
    both = access.remote_under(e, {"before": _at(e, _T1).ntfs_aces, "after": _at(e, _T2).ntfs_aces}, asked_pairs(e))
    return both.withColumn("direction", simulate.direction(F.col("before"), F.col("after")))


_DIRECTION = "CASE WHEN before = 0 AND after <> 0 THEN 'gain' WHEN before <> 0 AND after = 0 THEN 'lose' WHEN after & (4294967295 - before) <> 0 AND before & (4294967295 - after) <> 0 THEN 'change' WHEN after & (4294967295 - before) <> 0 THEN 'expand' WHEN before & (4294967295 - after) <> 0 THEN 'reduce' ELSE 'same' END"


@on_estate(_IMPACT + f" SELECT principal_key, resource_key, before, after, {_DIRECTION} AS direction FROM both_")
def change_impact(e: Estate) -> DataFrame:
    return _impact(e)


@on_estate(_IMPACT + " SELECT principal_key, resource_key, after & (4294967295 - before) AS gained, 'access_expanded' AS \"trigger\" FROM both_ WHERE after & (4294967295 - before) <> 0")
def access_expansion_events(e: Estate) -> DataFrame:
    gained = masks.minus(F.col("after"), F.col("before"))
    return _impact(e).where(gained != 0).select("principal_key", "resource_key", gained.alias("gained"), F.lit("access_expanded").alias("trigger"))


# Changes


_SWAPPED = ", turned AS (SELECT resource_key, trustee_key, ace_type, access_mask, ace_flags, ace_key, CASE length(resource_key) % 3 WHEN 0 THEN -order_index WHEN 1 THEN 2 * order_index + 5 ELSE order_index END AS order_index FROM ntfs_aces)"


@on_estate(_SWAPPED + ", a AS (SELECT resource_key, string_agg(ace_key, '/' ORDER BY order_index, ace_key) AS seats, string_agg(order_index, '/' ORDER BY order_index, ace_key) AS places FROM ntfs_aces GROUP BY 1), b AS (SELECT resource_key, string_agg(ace_key, '/' ORDER BY order_index, ace_key) AS seats, string_agg(order_index, '/' ORDER BY order_index, ace_key) AS places FROM turned GROUP BY 1) SELECT a.resource_key, a.seats <> b.seats AS material FROM a JOIN b ON a.resource_key = b.resource_key WHERE a.seats <> b.seats OR a.places <> b.places")
def order_changes(e: Estate) -> DataFrame:
    e = e.with_(ntfs_aces=tables.cut(e.ntfs_aces))
    way = F.length("resource_key") % 3
    turned = e.ntfs_aces.withColumn("order_index", F.when(way == 0, -F.col("order_index")).when(way == 1, 2 * F.col("order_index") + 5).otherwise(F.col("order_index")))
    return changes.order_changes(e.resources, e.ntfs_aces, turned)


@on_estate(", x AS (SELECT ace_key, access_mask::varchar AS m1, (CASE WHEN order_index % 4 = 0 THEN access_mask & 1179785 ELSE access_mask END)::varchar AS m2, order_index::varchar AS o1, (CASE WHEN order_index % 5 = 0 THEN order_index + 1 ELSE order_index END)::varchar AS o2, order_index % 7 = 3 AS gone FROM ntfs_aces), y AS (SELECT ace_key, 'access_mask' AS field, m1 AS old, CASE WHEN NOT gone THEN m2 END AS new FROM x UNION ALL SELECT ace_key, 'order_index', o1, CASE WHEN NOT gone THEN o2 END FROM x) SELECT ace_key, field, old, new, field = 'access_mask' AS significant FROM y WHERE old IS DISTINCT FROM new")
def field_deltas(e: Estate) -> DataFrame:
    n = F.col("order_index")
    after = e.ntfs_aces.where(n % 7 != 3).withColumns({"access_mask": F.when(n % 4 == 0, F.col("access_mask").bitwiseAND(F.lit(1179785).cast("long"))).otherwise(F.col("access_mask")), "order_index": F.when(n % 5 == 0, n + 1).otherwise(n)})
    return changes.field_deltas(e.ntfs_aces, after, "ace_key", ["access_mask", "order_index"], "ntfs_ace")


@on_estate("SELECT ace_key, count(*) OVER (PARTITION BY resource_key) - 1 AS siblings FROM ntfs_aces WHERE order_index % 2 = 0")
def sibling_changes(e: Estate) -> DataFrame:
    return changes.siblings(e.ntfs_aces.where("order_index % 2 = 0"), "resource_key").select("ace_key", "siblings")


# Lists


@on_estate(base._DIGEST.format(aces="ntfs_aces", present="dacl_present::varchar", protected="dacl_protected::varchar") + " SELECT resource_key, CASE WHEN depth > 0 THEN depth < 2 END AS digest_agrees, CASE WHEN depth > 0 THEN entries % 2 = 0 END AS count_agrees FROM dg JOIN resources USING (resource_key)")
def digest_checks(e: Estate) -> DataFrame:
    own = acl.digests(e.resources, e.ntfs_aces).join(e.resources.select("resource_key", "depth"), "resource_key").where("depth > 0")
    reported = own.select("resource_key", F.when(F.col("depth") < 2, F.col("acl_hash")).otherwise("other").alias("acl_hash"), (F.col("entries") + F.col("entries") % 2).alias("ace_count"))
    return acl.digest_checks(e.resources, e.ntfs_aces, reported)


@on_estate("SELECT resource_key, ace_flags - CASE WHEN ace_flags & 16 <> 0 THEN 16 ELSE 0 END AS ace_flags, count(*) AS entries FROM ntfs_aces GROUP BY 1, 2")
def protect_keeping(e: Estate) -> DataFrame:
    return acl.reprotected(e.ntfs_aces, e.resources, keep=True).groupBy("resource_key", "ace_flags").agg(F.count("*").alias("entries"))


@on_estate("SELECT resource_key, count(*) AS entries FROM ntfs_aces WHERE ace_flags & 16 = 0 GROUP BY 1")
def protect_dropping(e: Estate) -> DataFrame:
    return acl.reprotected(e.ntfs_aces, e.resources, keep=False).groupBy("resource_key").agg(F.count("*").alias("entries"))


# Principals and references


@on_estate("SELECT e.group_key, e.member_key, p.name, p.kind, p.kind IN ('group') OR p.kind IS NULL AS may_hold_members FROM edges e LEFT JOIN principals p ON p.principal_key = e.member_key")
def labelled_members(e: Estate) -> DataFrame:
    about = e.principals.select(F.col("principal_key").alias("member_key"), "name", "kind")
    return e.edges.join(about, "member_key", "left").select("group_key", "member_key", "name", "kind", (F.col("kind").isin("group") | F.col("kind").isNull()).alias("may_hold_members"))


@on_estate("SELECT trustee_key, count(DISTINCT share_key) AS shares FROM share_aces GROUP BY 1")
def shares_of_trustees(e: Estate) -> DataFrame:
    return e.share_aces.groupBy("trustee_key").agg(F.count_distinct("share_key").alias("shares"))


@on_estate("SELECT DISTINCT resource_key, trustee_key FROM ntfs_aces a WHERE EXISTS (SELECT 1 FROM ntfs_aces b WHERE b.resource_key = a.resource_key AND b.trustee_key = a.trustee_key AND b.ace_flags & 8 = 0)")
def backed_references(e: Estate) -> DataFrame:
    named = e.ntfs_aces.select("resource_key", "trustee_key").distinct()
    return named.join(e.ntfs_aces.where(F.col("ace_flags").bitwiseAND(8) == 0), ["resource_key", "trustee_key"], "left_semi")


@on_estate(REACH + ", t AS (SELECT DISTINCT member_key FROM reach WHERE depth > 2) SELECT member_key, true AS cut_short FROM t")
def depth_limited_tokens(e: Estate) -> DataFrame:
    return graph.truncated(e.edges, 2).withColumn("cut_short", F.lit(True))


@on_estate("SELECT resource_key, ace_key FROM (SELECT *, row_number() OVER (PARTITION BY resource_key ORDER BY order_index, ace_key) AS k FROM ntfs_aces) WHERE k <= 3")
def first_entries_of_lists(e: Estate) -> DataFrame:
    return tables.first_by(e.ntfs_aces, ["resource_key"], [F.col("order_index").asc(), F.col("ace_key").asc()], 3).select("resource_key", "ace_key")


# Reports


_FOUND = _BROAD + ", qualified AS (SELECT rule, resource_key, severity, band, CASE WHEN band = 'null_dacl' THEN 'high' WHEN resource_key IN (SELECT resource_key FROM ntfs_aces WHERE access_mask & 4026531840 <> 0) THEN 'medium' ELSE 'high' END AS confidence, sha256('rule=' || rule || chr(10) || 'resource_key=' || resource_key) AS finding_key, sha256('band=' || band || chr(10) || 'rights=' || rights) AS evidence_digest FROM found)"


def _findings(e: Estate) -> DataFrame:
    found = risk.broad_access(e)
    generic = e.ntfs_aces.where(F.col("access_mask").bitwiseAND(F.lit(masks.GENERIC)) != 0).select("resource_key", F.lit("generic_rights_expanded").alias("qualifier")).distinct()
    plain = found.select("rule", "resource_key", F.when(F.col("band") == "null_dacl", "null_dacl").otherwise("none").alias("qualifier"))
    qualifiers = plain.unionByName(found.where("band <> 'null_dacl'").select("rule", "resource_key").join(generic, "resource_key"))
    sure = risk.confidence(qualifiers, ["rule", "resource_key"])
    return risk.keyed(found.join(sure, ["rule", "resource_key"]), ["resource_key"], ["band", "rights"])


@on_estate(_FOUND + " SELECT rule, resource_key, severity, confidence, finding_key, evidence_digest FROM qualified")
def risk_findings(e: Estate) -> DataFrame:
    return _findings(e).select("rule", "resource_key", "severity", "confidence", "finding_key", "evidence_digest")


@on_estate(_FOUND + ", ranked AS (SELECT *, (length(resource_key) % 9)::int AS first_detected, (SELECT count(*) FROM qualified) AS total FROM qualified) SELECT finding_key, severity, confidence, first_detected, total FROM ranked ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, first_detected, finding_key LIMIT 50 OFFSET 20")
def risk_report(e: Estate) -> DataFrame:
    rows = _findings(e).withColumn("first_detected", F.length("resource_key") % 9)
    return risk.report(rows, 50, 20).select("finding_key", "severity", "confidence", "first_detected", "total")


@on_estate(_BROAD + " SELECT split_part(resource_key, chr(92), 3) AS server_key, count(*) AS findings, count_if(severity = 'critical')::bigint AS critical, count_if(severity = 'high')::bigint AS high FROM found GROUP BY 1")
def findings_of_servers(e: Estate) -> DataFrame:
    rows = risk.broad_access(e).withColumn("server_key", keys.parts(F.col("resource_key"))[0])
    return rows.groupBy("server_key").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))


@on_estate(_BROAD + ", tg AS (SELECT r.resource_key FROM resources r JOIN (SELECT resource_key AS path FROM resources WHERE depth = 1 AND resource_key LIKE '%\\1%') ON r.resource_key = path OR starts_with(r.resource_key, path || '\\')) SELECT rule, resource_key, severity, 'secret' AS tag FROM found WHERE resource_key IN (SELECT resource_key FROM tg)")
def risk_on_sensitive(e: Estate) -> DataFrame:
    secret = e.resources.where((F.col("depth") == 1) & F.col("resource_key").contains("\\1")).select(F.col("resource_key").alias("path"), F.lit("secret").alias("tag"))
    return risk.broad_access(e).join(risk.tagged(e.resources, secret), "resource_key").select("rule", "resource_key", "severity", "tag")


# Versions and runs


@on_log(", d AS (SELECT *, lag(state) OVER w AS b, lag(valid_from) OVER w IS NOT NULL AS had, row_number() OVER (PARTITION BY key ORDER BY valid_from DESC) AS seat, count(*) OVER (PARTITION BY key) AS n FROM log WINDOW w AS (PARTITION BY key ORDER BY valid_from)) SELECT key, valid_from, state, CASE WHEN state IS NULL THEN 'removed' WHEN NOT had THEN 'first_observed' WHEN b IS NULL THEN 'returned' ELSE 'changed' END AS transition, n > 5 AS truncated FROM d WHERE seat <= 5")
def object_timelines(v: DataFrame) -> DataFrame:
    return history.timeline(v, 5).select("key", "valid_from", "state", "transition", "truncated")


@on_log(f", sn AS (SELECT key, TIMESTAMP '{past.T3}' + INTERVAL 30 DAY AS at_ FROM log GROUP BY 1 HAVING key::int % 3 = 0) SELECT key, valid_from, CASE WHEN valid_to IS NULL THEN greatest(last_seen_at, at_) ELSE last_seen_at END AS last_seen_at FROM log LEFT JOIN sn USING (key)")
def affirmed_versions(v: DataFrame) -> DataFrame:
    seen = v.select("kind", "key").distinct().where(F.col("key").cast("int") % 3 == 0).withColumn("at", past._at(past.T3) + F.expr("INTERVAL 30 DAYS"))
    return history.affirmed(v, seen).select("key", "valid_from", "last_seen_at")


@on_log(f" SELECT key, valid_from, CASE WHEN valid_to IS NULL AND state IS NOT NULL AND container IN ('c1', 'c4') THEN greatest(last_seen_at, TIMESTAMP '{past.T3}' + INTERVAL 30 DAY) ELSE last_seen_at END AS last_seen_at FROM log")
def affirmed_containers(v: DataFrame) -> DataFrame:
    seen = v.select("kind", "container").distinct().where("container IN ('c1', 'c4')").withColumn("at", past._at(past.T3) + F.expr("INTERVAL 30 DAYS"))
    return history.affirmed_contained(v, seen).select("key", "valid_from", "last_seen_at")


@on_log(" SELECT DISTINCT key, container FROM log WHERE key NOT IN (SELECT key FROM log WHERE state IS NULL AND valid_to IS NULL)")
def present_objects(v: DataFrame) -> DataFrame:
    return history.currently_present(v.select("key", "container").distinct(), v, "session", "key")


@on_runs("SELECT (run_id % 500)::bigint AS run_id, count(*) AS scopes, count_if(errors = 0)::bigint AS reconciled, coalesce(string_agg(DISTINCT CASE WHEN status <> 'succeeded' THEN 'code_' || (run_id % 7) END, ',' ORDER BY CASE WHEN status <> 'succeeded' THEN 'code_' || (run_id % 7) END), '') AS codes FROM runs GROUP BY 1")
def run_scope_counts(r: DataFrame) -> DataFrame:
    code = F.when(F.col("status") != "succeeded", F.concat(F.lit("code_"), (F.col("run_id") % 7).cast("string")))
    return operations.scope_counts(r.select((F.col("run_id") % 500).alias("run_id"), (F.col("errors") == 0).alias("reconciled"), code.alias("code")))


@on_runs("SELECT bool_or(good.started_at IS NOT NULL) AS any_success, bool_or(l.status = 'failed') AS any_failed, bool_and(l.status = 'succeeded') AS all_good, CASE WHEN NOT bool_or(good.started_at IS NOT NULL) THEN 'never_collected' WHEN bool_and(l.status = 'succeeded') THEN 'healthy' WHEN bool_or(l.status = 'failed') THEN 'failing' ELSE 'degraded' END AS health FROM latest l LEFT JOIN good USING (collector, target)")
def collection_health(r: DataFrame) -> DataFrame:
    return operations.health(r)


@on_runs("SELECT run_id, status, (SELECT count(*) FROM runs) AS total FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 25 OFFSET 100")
def run_page(r: DataFrame) -> DataFrame:
    return tables.numbered_page(r, [F.col("started_at").desc(), F.col("run_id").desc()], 100, 25).select("run_id", "status", "total")


@on_runs(""", sc AS (SELECT collector, count(*) AS scopes, count_if(l.status = 'succeeded') AS ok, count_if(coalesce(l.started_at > good.started_at, false)) AS stale FROM latest l LEFT JOIN good USING (collector, target) GROUP BY 1) SELECT collector, CASE WHEN ok = 0 THEN 'incomplete' WHEN stale > 0 THEN 'stale' WHEN ok < scopes THEN 'partial' ELSE 'complete' END AS reading FROM sc""")
def totals_reading(r: DataFrame) -> DataFrame:
    rows = operations.coverage(r)
    return rows.select("collector", risk.reading(F.lit(True), F.col("scopes"), F.col("collected"), F.col("stale")).alias("reading"))


@on_runs("""SELECT run_id, base64(encode('{"run_id":' || run_id || ',"status":"' || status || '"}')) AS "cursor", run_id AS back, '{"collector":"' || collector || '","errors":' || errors || ',"run_id":' || run_id || '}' AS document FROM runs""")
def cursors(r: DataFrame) -> DataFrame:
    c = tables.cursor("run_id", "status")
    return r.select("run_id", c.alias("cursor"), tables.cursor_fields(c, "run_id bigint, status string")["run_id"].alias("back"), tables.canonical_json("run_id", "errors", "collector").alias("document"))


@on_log(" SELECT key, strftime(valid_from, '%Y-%m-%dT%H:%M:%S.%fZ') AS at_utc FROM log")
def iso_instants(v: DataFrame) -> DataFrame:
    return v.select("key", tables.iso_instant(F.col("valid_from")).alias("at_utc"))
