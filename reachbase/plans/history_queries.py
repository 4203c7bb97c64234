"""Queries on versions, changes, alerts and collection runs, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachbase.operators import alerts, changes, governance, history, operations
from reachbase.plans.estate import table
from reachbase.sources import contract

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
T1, T2, T3 = "2024-01-10", "2024-01-20", "2024-01-30"

LOG = """WITH RECURSIVE obs AS (SELECT user_id, ts, CASE WHEN event_type <> 'error' THEN event_type END AS state FROM events),
m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR state IS DISTINCT FROM lag(state) OVER w THEN 1 ELSE 0 END AS new FROM obs WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM m),
v AS (SELECT user_id, g, min(state) AS state, min(ts) AS valid_from, max(ts) AS last_seen_at FROM s GROUP BY 1, 2),
log AS (SELECT 'session' AS kind, user_id::varchar AS key, 'c' || (user_id % 10) AS container, state, valid_from, last_seen_at, lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from) AS valid_to FROM v)
"""
RUNS = """WITH runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS collector, (o_custkey % 50)::varchar AS target, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'partial' END AS status, o_orderdate AS started_at,
  (o_orderkey % 40)::bigint AS reported, least(o_orderkey % 40, 35)::bigint AS received, (o_custkey % 3)::bigint AS errors FROM orders),
latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY collector, target ORDER BY started_at DESC, run_id DESC) = 1),
good AS (SELECT * FROM runs WHERE status = 'succeeded' QUALIFY row_number() OVER (PARTITION BY collector, target ORDER BY started_at DESC, run_id DESC) = 1),
bad AS (SELECT * FROM runs WHERE status = 'failed' QUALIFY row_number() OVER (PARTITION BY collector, target ORDER BY started_at DESC, run_id DESC) = 1)
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users as versions: an error is a reading that found nothing."""
    e = table(spark, sf_dir, "events")
    seen = e.select(F.lit("session").alias("kind"), F.col("user_id").cast("string").alias("key"), F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("container"), F.col("ts").alias("observed_at"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("state"))
    return history.versions(seen)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "succeeded").otherwise("partial")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("collector"), (F.col("o_custkey") % 50).cast("string").alias("target"), status.alias("status"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderkey") % 40).alias("reported"), F.least(F.col("o_orderkey") % 40, F.lit(35).cast("long")).alias("received"), (F.col("o_custkey") % 3).alias("errors"))


def _at(t: str):
    return F.lit(t).cast("timestamp_ntz")


def on_log(body: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(log(spark, sf_dir))
        if body is not None:
            ORACLE[f.__name__] = LOG + body
        return f

    return add


def on_runs(body: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(runs(spark, sf_dir))
        if body is not None:
            ORACLE[f.__name__] = RUNS + body
        return f

    return add


@on_log("SELECT key, container, state, valid_from, last_seen_at, valid_to FROM log")
def version_log(v: DataFrame) -> DataFrame:
    return v.select("key", "container", "state", "valid_from", "last_seen_at", "valid_to")


@on_log(f"SELECT key, state, CASE WHEN last_seen_at >= TIMESTAMP '{T1}' THEN 'observed' ELSE 'inferred' END AS certainty FROM log WHERE valid_from <= TIMESTAMP '{T1}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{T1}')")
def versions_as_of(v: DataFrame) -> DataFrame:
    return history.as_of(v, _at(T1)).select("key", "state", history.certainty_at(_at(T1)).alias("certainty"))


@on_log("SELECT DISTINCT l.key, p.present FROM log l LEFT JOIN (SELECT key, state IS NOT NULL AS present FROM log WHERE valid_from <= TIMESTAMP '2024-01-01 02:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-01 02:00:00')) p USING (key)")
def presence_at(v: DataFrame) -> DataFrame:
    return history.presence(v.select("kind", "key").distinct(), v, _at("2024-01-01 02:00:00")).select("key", "present")


@on_log("SELECT key, valid_from FROM log WHERE state IS NULL AND valid_to IS NULL")
def absent_now(v: DataFrame) -> DataFrame:
    return history.absent_now(v).select("key", "valid_from")


@on_log(f"SELECT container, count(*) AS versions, sum((state IS NULL)::int)::bigint AS absent FROM log WHERE valid_from <= TIMESTAMP '{T2}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{T2}') GROUP BY 1")
def version_counts_at(v: DataFrame) -> DataFrame:
    return history.as_of(v, _at(T2)).groupBy("container").agg(F.count("*").alias("versions"), F.count_if(F.col("state").isNull()).alias("absent"))


@on_log("SELECT key, valid_from, lag(state) OVER w AS before_state, lag(last_seen_at) OVER w AS before_seen_at FROM log WINDOW w AS (PARTITION BY key ORDER BY valid_from)")
def predecessors(v: DataFrame) -> DataFrame:
    return history.with_predecessor(v).select("key", "valid_from", "before_state", "before_seen_at")


@on_log("SELECT container, min(valid_from) AS first_at FROM log WHERE state IS NOT NULL GROUP BY 1")
def containers_first_present(v: DataFrame) -> DataFrame:
    return history.first_present(v).select("container", "first_at")


@on_log('SELECT a.container, a."at", l.seen AS confirmed_at FROM (SELECT DISTINCT container, valid_from AS "at" FROM log) a ASOF LEFT JOIN (SELECT container, max(last_seen_at) AS seen FROM log GROUP BY container, last_seen_at) l ON l.container = a.container AND a."at" > l.seen')
def confirmed_before(v: DataFrame) -> DataFrame:
    asked = v.select("kind", "container", F.col("valid_from").alias("at")).distinct()
    return history.confirmed_before(v, asked).select("container", "at", "confirmed_at")


@on_log("SELECT key, valid_from FROM (SELECT *, max(CASE WHEN valid_to IS NOT NULL THEN valid_from END) OVER (PARTITION BY key) AS newest FROM log) WHERE valid_to IS NOT NULL AND valid_to < TIMESTAMP '2024-01-20' AND valid_from <> newest")
def retention_plan(v: DataFrame) -> DataFrame:
    return history.removable(v, _at(T2)).select("key", "valid_from")


@on_log(""", w AS (SELECT key, valid_from, CASE WHEN key::int % 7 = 0 THEN valid_from WHEN key::int % 7 = 2 THEN valid_to + INTERVAL 400 DAY WHEN key::int % 7 = 3 THEN NULL ELSE valid_to END AS valid_to, CASE WHEN key::int % 7 = 1 THEN valid_from - INTERVAL 1 HOUR ELSE last_seen_at END AS last_seen_at FROM log),
n AS (SELECT *, lead(valid_from) OVER (PARTITION BY key ORDER BY valid_from) AS next FROM w)
SELECT key, 'empty_interval' AS violation, count(*) AS n FROM n WHERE valid_to <= valid_from GROUP BY 1 UNION ALL SELECT key, 'seen_before_start', count(*) FROM n WHERE last_seen_at < valid_from GROUP BY 1 UNION ALL SELECT key, 'overlap', count(*) FROM n WHERE next < valid_to GROUP BY 1 UNION ALL SELECT key, 'open_before_later', count(*) FROM n WHERE valid_to IS NULL AND next IS NOT NULL GROUP BY 1""")
def log_violations(v: DataFrame) -> DataFrame:
    """With a fault of each kind planted in the log."""
    k = F.col("key").cast("int") % 7
    bent = v.withColumns({
        "valid_to": F.when(k == 0, F.col("valid_from")).when(k == 2, F.col("valid_to") + F.expr("INTERVAL 400 DAYS")).when(k != 3, F.col("valid_to")), "last_seen_at": F.when(k == 1, F.col("valid_from") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("last_seen_at")),
    })
    return history.violations(bent).groupBy("key", "violation").agg(F.count("*").alias("n"))


@on_log(f"SELECT key, valid_from FROM log WHERE valid_to IS NULL AND state IS NOT NULL AND container = 'c3' AND last_seen_at <= TIMESTAMP '2024-02-15' AND key NOT IN (SELECT user_id::varchar FROM events WHERE ts >= TIMESTAMP '{T3}')")
def closed_as_absent(v: DataFrame) -> DataFrame:
    seen = v.where(F.col("last_seen_at") >= _at(T3))
    return history.close_absent(v, F.col("container") == "c3", seen, _at("2024-02-15")).select("key", "valid_from")


_FEED = f""", f AS (SELECT l.*, lag(state) OVER w AS before_state, lag(last_seen_at) OVER w AS before_seen, lag(valid_from) OVER w IS NOT NULL AS had FROM log l WINDOW w AS (PARTITION BY key ORDER BY valid_from)),
c AS (SELECT container, min(valid_from) AS first_at FROM log WHERE state IS NOT NULL GROUP BY 1),
feed AS (SELECT key, f.container, before_state, state, valid_from, CASE WHEN state IS NULL THEN 'removed' WHEN NOT had THEN CASE WHEN first_at < valid_from THEN 'added' ELSE 'first_observed' END WHEN before_state IS NULL THEN 'added' ELSE 'modified' END AS action,
  CASE WHEN had THEN before_seen ELSE (SELECT max(last_seen_at) FROM log l WHERE l.container = f.container AND l.last_seen_at < f.valid_from) END AS lower
  FROM f LEFT JOIN c ON c.container = f.container WHERE valid_from >= TIMESTAMP '2024-01-01' AND valid_from < TIMESTAMP '{T1}')"""


@on_log(_FEED + " SELECT key, before_state, state, action, CASE WHEN action <> 'first_observed' THEN lower END AS changed_after, greatest(valid_from, coalesce(lower, valid_from)) AS changed_by FROM feed")
def change_feed(v: DataFrame) -> DataFrame:
    return changes.feed(v, _at("2024-01-01"), _at(T1)).select("key", "before_state", "state", "action", "changed_after", "changed_by")


@on_log(_FEED + " SELECT 'action' AS facet, action AS value, count(*) AS n FROM feed GROUP BY 2 UNION ALL SELECT 'container', container, count(*) FROM feed GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM feed")
def change_summary(v: DataFrame) -> DataFrame:
    return changes.summary(changes.feed(v, _at("2024-01-01"), _at(T1)), ["action", "container"])


@on_log(f""", a AS (SELECT * FROM log WHERE valid_from <= TIMESTAMP '{T1}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{T1}')), b AS (SELECT * FROM log WHERE valid_from <= TIMESTAMP '{T2}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{T2}'))
SELECT coalesce(a.key, b.key) AS key, a.state AS state_1, b.state AS state_2, CASE WHEN a.key IS NULL THEN CASE WHEN b.state IS NULL THEN 'absent' ELSE 'first_observed' END WHEN b.key IS NULL THEN 'unobserved'
  WHEN a.state IS NULL AND b.state IS NOT NULL THEN 'added' WHEN a.state IS NOT NULL AND b.state IS NULL THEN 'removed' WHEN a.state IS NOT DISTINCT FROM b.state THEN 'same' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.key = b.key""")
def compare_instants(v: DataFrame) -> DataFrame:
    return changes.compare(v, _at(T1), _at(T2)).select("key", "state_1", "state_2", "change")


@on_log("SELECT key, valid_from FROM log WHERE (valid_from, key) < (TIMESTAMP '2024-01-20', '50') ORDER BY valid_from DESC, key DESC LIMIT 26")
def change_page(v: DataFrame) -> DataFrame:
    return v.where(F.struct("valid_from", "key") < F.struct(_at(T2), F.lit("50"))).select("key", "valid_from").orderBy(F.col("valid_from").desc(), F.col("key").desc()).limit(26)


def upsert_newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("ts").alias("observed_at"), F.col("event_id").alias("arrival"))
    return history.newest_wins(e, ["user_id"], ["event_type", "value"])


QUERIES["upsert_newest_wins"] = upsert_newest_wins
ORACLE["upsert_newest_wins"] = "SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value, min(ts) AS first_observed_at, max(ts) AS last_observed_at FROM events GROUP BY 1"


def alias_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.aliases(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.upper("event_type").alias("name"), F.col("ts").alias("observed_at")))


QUERIES["alias_history"] = alias_history
ORACLE["alias_history"] = "SELECT user_id AS key, event_type AS alias, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2"


def alert_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    events = e.select(F.col("user_id").alias("alert"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("digest"), (F.col("event_type") == "error").alias("ends"), (F.col("event_id") % 11 != 0).alias("enabled"))
    return alerts.decide(events, 2 * 86_400)


QUERIES["alert_transitions"] = alert_transitions
ORACLE["alert_transitions"] = """WITH RECURSIVE e AS (SELECT user_id AS alert, event_id AS seq, ts, event_type AS digest, event_type = 'error' AS ends, event_id % 11 <> 0 AS enabled, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
w(alert, k, seq, status, told, told_at, folds, transition, shown) AS (
  SELECT alert, 0::bigint, 0::bigint, NULL::varchar, NULL::varchar, NULL::timestamp, 0, '', 0 FROM (SELECT DISTINCT alert FROM e)
  UNION ALL SELECT alert, k, seq, CASE WHEN t IN ('raised', 'reopened', 'repeated') THEN 'open' WHEN t = 'resolved' THEN 'resolved' ELSE status END, CASE WHEN t IN ('raised', 'reopened', 'repeated') THEN digest ELSE told END,
    CASE WHEN t IN ('raised', 'reopened', 'repeated') THEN ts ELSE told_at END, CASE WHEN t IN ('raised', 'reopened', 'repeated') THEN 0 WHEN t LIKE 'suppressed%' THEN folds + 1 ELSE folds END, t, CASE WHEN t LIKE 'suppressed%' OR t = 'repeated' THEN folds + 1 ELSE 0 END
  FROM (SELECT e.*, w.status, w.told, w.told_at, w.folds, CASE WHEN ends THEN CASE WHEN status = 'open' THEN 'resolved' ELSE 'ignored' END WHEN NOT enabled THEN 'suppressed_disabled' WHEN status IS NULL THEN 'raised' WHEN status = 'resolved' THEN 'reopened'
    WHEN told = digest THEN 'suppressed_identical' WHEN ts < told_at + INTERVAL 2 DAY THEN 'suppressed_cooldown' ELSE 'repeated' END AS t FROM w JOIN e ON e.alert = w.alert AND e.k = w.k + 1))
SELECT alert, seq, transition, shown AS folds FROM w WHERE k > 0"""


def watched_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = changes.feed(log(spark, sf_dir), _at("2024-01-01"), _at(T1))
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    watches = users.select((F.col("user_id") + 7).alias("watch_id"), F.lit("session").alias("kind"), F.col("user_id").cast("string").alias("key"), F.lit("removed").alias("trigger"), F.lit(True).alias("enabled"))
    return alerts.matched(watches, feed).select("watch_id", "key", "trigger", "changed_by")


QUERIES["watched_changes"] = watched_changes
ORACLE["watched_changes"] = LOG + _FEED + " SELECT key::bigint + 7 AS watch_id, key, action AS \"trigger\", greatest(valid_from, lower) AS changed_by FROM feed WHERE action = 'removed'"


@on_runs("SELECT collector, target, run_id, status, started_at FROM latest")
def latest_runs(r: DataFrame) -> DataFrame:
    return operations.latest(r).select("collector", "target", "run_id", "status", "started_at")


@on_runs("SELECT collector, l.target, l.status AS state, l.started_at AS latest_at, good.started_at AS last_success, bad.started_at AS last_failure, good.started_at IS NOT NULL AND l.started_at > good.started_at AS stale FROM latest l LEFT JOIN good USING (collector, target) LEFT JOIN bad USING (collector, target)".replace("l.target", "target"))
def scope_operations(r: DataFrame) -> DataFrame:
    return operations.scopes(r)


@on_runs(""", sc AS (SELECT collector, l.status AS state, good.started_at AS g, coalesce(l.started_at > good.started_at, false) AS stale FROM latest l LEFT JOIN good USING (collector, target))
SELECT collector, count(*) AS scopes, count_if(state = 'succeeded')::bigint AS collected, count_if(state = 'failed')::bigint AS failed, count_if(stale)::bigint AS stale, count_if(g IS NULL)::bigint AS never,
  CASE WHEN count_if(state = 'failed') > 0 THEN 'incomplete' WHEN count_if(state = 'succeeded') = count(*) THEN 'complete' ELSE 'partial' END AS verdict FROM sc GROUP BY 1""")
def collection_coverage(r: DataFrame) -> DataFrame:
    return operations.coverage(r)


@on_runs("SELECT run_id, greatest(0, reported - received) AS missing, CASE WHEN status = 'failed' THEN 'none' WHEN status = 'succeeded' AND errors = 0 AND reported <= received THEN 'complete' ELSE 'partial' END AS completeness FROM runs")
def run_completeness(r: DataFrame) -> DataFrame:
    return operations.completeness(r).select("run_id", "missing", "completeness")


@on_runs("SELECT collector, r.target, count_if(good.started_at IS NULL OR r.started_at > good.started_at)::bigint AS since FROM runs r LEFT JOIN good USING (collector, target) GROUP BY ALL".replace("r.target", "target"))
def runs_since_success(r: DataFrame) -> DataFrame:
    return operations.runs_since(r)


@on_runs("SELECT s AS status, coalesce(n, 0) AS n FROM (VALUES ('succeeded'), ('partial'), ('failed'), ('canceled')) v(s) LEFT JOIN (SELECT status, count(*) AS n FROM runs GROUP BY 1) ON status = s")
def status_facets(r: DataFrame) -> DataFrame:
    return operations.facets(r, "status", ["succeeded", "partial", "failed", "canceled"])


@on_runs("SELECT count(*) AS n, max(started_at) AS latest, arg_max(run_id, (started_at, run_id)) AS latest_run, substr(sha256(count(*)::varchar || '|' || strftime(max(started_at), '%Y-%m-%d %H:%M:%S') || '|' || arg_max(run_id, (started_at, run_id))::varchar), 1, 32) AS token FROM runs")
def collection_basis(r: DataFrame) -> DataFrame:
    return operations.basis(r)


@on_runs("SELECT 'code_' || (run_id % 7) AS code, count(*) AS errors, count(DISTINCT collector) AS collectors, max(started_at) AS latest, array_to_string(list_slice(list_sort(list(DISTINCT target)), 1, 3), ',') AS examples FROM runs WHERE status <> 'succeeded' GROUP BY 1")
def error_summary(r: DataFrame) -> DataFrame:
    return operations.errors_by_code(r.where("status <> 'succeeded'").withColumns({"code": F.concat(F.lit("code_"), (F.col("run_id") % 7).cast("string")), "occurred_at": F.col("started_at")}))


@on_runs(""", i AS (SELECT target AS item, 'a' || (target::bigint % 4) AS assignment, max(started_at) AS due_at FROM runs GROUP BY 1), d AS (SELECT target AS item, run_id AS decision_id, started_at AS decided_at FROM runs WHERE run_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY target ORDER BY started_at DESC, run_id DESC) = 1)
SELECT assignment, count(*) AS items, count(decided_at) AS decided, count_if(decided_at > due_at - INTERVAL 30 DAY)::bigint AS late FROM i LEFT JOIN d USING (item) GROUP BY 1""")
def review_progress(r: DataFrame) -> DataFrame:
    items = r.groupBy(F.col("target").alias("item")).agg((F.max("started_at") - F.expr("INTERVAL 30 DAYS")).alias("due_at")).withColumn("assignment", F.concat(F.lit("a"), (F.col("item").cast("long") % 4).cast("string")))
    decisions = r.where("run_id % 5 = 0").select(F.col("target").alias("item"), F.col("run_id").alias("decision_id"), F.col("started_at").alias("decided_at"))
    return governance.progress(items, decisions)


_CHAIN = """, e AS (SELECT collector AS chain, run_id, row_number() OVER (PARTITION BY collector ORDER BY run_id) AS k FROM runs),
w(chain, k, payload, previous, digest) AS (SELECT chain, 0::bigint, '', '', '' FROM (SELECT DISTINCT chain FROM e) UNION ALL SELECT w.chain, e.k, e.run_id::varchar, w.digest, sha256(w.digest || chr(10) || e.run_id::varchar) FROM w JOIN e ON e.chain = w.chain AND e.k = w.k + 1)"""


@on_runs(_CHAIN.replace(", e AS", ", e AS", 1) + ' SELECT chain, k AS "index", payload, previous, digest FROM w WHERE k > 0')
def audit_chain(r: DataFrame) -> DataFrame:
    return governance.chained(_audited(r))


ORACLE["audit_chain"] = ORACLE["audit_chain"].replace("WITH runs", "WITH RECURSIVE runs")


def _audited(r: DataFrame) -> DataFrame:
    seat = F.row_number().over(Window.partitionBy("collector").orderBy("run_id"))
    return r.select(F.col("collector").alias("chain"), seat.alias("index"), F.col("run_id").cast("string").alias("payload"))


@on_runs('SELECT chain, min(k) AS first_broken FROM (SELECT collector AS chain, run_id, row_number() OVER (PARTITION BY collector ORDER BY run_id) AS k FROM runs) WHERE run_id % 1009 = 0 GROUP BY 1')
def audit_breaks(r: DataFrame) -> DataFrame:
    """Payloads altered after they were chained, here and there: the first of each chain is found."""
    altered = F.when(F.col("payload").cast("long") % 1009 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))
    return governance.broken_links(governance.chained(_audited(r)).withColumn("payload", altered))


def contract_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users sent as JSON batches, every third batch twice, and read back."""
    c = table(spark, sf_dir, "customer")
    one = F.struct(F.lit("principal").alias("kind"), F.lit("2024-01-01T00:00:00Z").alias("observed_at"), F.concat(F.lit("S-1-5-21-1-1-1-"), (F.col("c_custkey") + 100000).cast("string")).alias("sid"), F.lit("user").alias("principal_kind"), F.col("c_name").alias("display_name"))
    sent = c.groupBy((F.col("c_custkey") % 20).alias("b")).agg(F.collect_list(one).alias("observations"))
    envelope = F.to_json(F.struct(F.lit("run").alias("run_id"), F.col("b").cast("string").alias("batch_id"), F.col("b").cast("int").alias("sequence"), "observations"))
    lines = sent.select(F.explode(F.array_repeat(envelope, F.when(F.col("b") % 3 == 0, 2).otherwise(1))).alias("value"))
    return contract.principals(contract.observations(contract.claimed(contract.parse_batches(lines)))).select("principal_key", "kind", "name")


QUERIES["contract_principals"] = contract_principals
ORACLE["contract_principals"] = "SELECT 'S-1-5-21-1-1-1-' || (c_custkey + 100000) AS principal_key, 'user' AS kind, c_name AS name FROM customer"
