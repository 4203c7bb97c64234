"""Queries on what causes access, what would remove it, and ways through memberships, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.functions import keys, tables
from reachbase.operators import access, causality, changes, classify, closing, graph, risk, simulate
from reachbase.plans import access_queries as base
from reachbase.plans import history_queries as past
from reachbase.plans.access_queries import TOKENS
from reachbase.plans.estate import DOMAIN_USERS, Estate
from reachbase.plans.oracle import expand
from reachbase.plans.report_queries import asked_pairs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def on_estate(body: str | None = None):
    def add(f):
        base.on_estate(body)(f)
        QUERIES[f.__name__] = base.QUERIES.pop(f.__name__)
        if f.__name__ in base.ORACLE:
            ORACLE[f.__name__] = base.ORACLE.pop(f.__name__)
        return f

    return add


def on_log(body: str | None = None):
    def add(f):
        past.on_log(body)(f)
        QUERIES[f.__name__] = past.QUERIES.pop(f.__name__)
        if f.__name__ in past.ORACLE:
            ORACLE[f.__name__] = past.ORACLE.pop(f.__name__)
        return f

    return add


#: Of each pair: the entries that speak to it on both layers, and its rights, by folding the whole list.
_EVIDENCE = TOKENS + """, asked AS (SELECT owner_key AS principal_key, resource_key, share_key, dacl_present, owner_key FROM resources WHERE owner_key IS NOT NULL
  UNION ALL SELECT p.principal_key, resource_key, share_key, dacl_present, owner_key FROM resources JOIN principals p ON p.principal_key = 'S-1-5-21-1-1-1-' || (regexp_extract(resource_key, '\\\\p(\\d+)$', 1)::bigint + 100000) WHERE depth = 2),
ents AS MATERIALIZED (SELECT k.principal_key, k.resource_key, 'ntfs' AS layer, ace_key, trustee_key, origin, order_index, ace_type = 'allow' AS allow, """ + expand("access_mask") + """ AS mask FROM asked k JOIN ntfs_aces a USING (resource_key) JOIN tokens t ON t.principal_key = k.principal_key AND t.sid = a.trustee_key WHERE dacl_present AND ace_flags & 8 = 0
  UNION ALL SELECT k.principal_key, k.resource_key, 'share', ace_key, trustee_key, origin, 1, true, CASE permission WHEN 'read' THEN 1179817::bigint WHEN 'change' THEN 1245631 ELSE 2032127 END FROM asked k JOIN share_aces a USING (share_key) JOIN tokens t ON t.principal_key = k.principal_key AND t.sid = a.trustee_key),
packed AS MATERIALIZED (SELECT principal_key, resource_key, list({'k': ace_key, 't': trustee_key, 'a': allow, 'm': mask, 'n': layer = 'ntfs', 'g': 0::bigint, 'd': 0::bigint} ORDER BY order_index, ace_key) AS es FROM ents GROUP BY 1, 2),
rights AS MATERIALIZED (SELECT k.principal_key, k.resource_key, CASE WHEN owner_key = k.principal_key THEN 393216 ELSE 0 END::bigint AS own, o.share_key IS NOT NULL AS seen, dacl_present AS listed, coalesce(es, []) AS es
  FROM asked k LEFT JOIN packed p ON p.principal_key = k.principal_key AND p.resource_key = k.resource_key LEFT JOIN (SELECT DISTINCT share_key FROM share_aces) o ON o.share_key = k.share_key)"""
_GRANTED = "list_reduce(list_prepend({{'k': '', 't': '', 'a': true, 'm': 0::bigint, 'n': true, 'g': 0::bigint, 'd': 0::bigint}}, list_filter({es}, lambda e: e.n = {ntfs})), lambda s, e: {{'k': '', 't': '', 'a': true, 'm': 0::bigint, 'n': true, 'g': CASE WHEN e.a THEN s.g | (e.m & (4294967295 - s.d)) ELSE s.g END, 'd': CASE WHEN e.a THEN s.d ELSE s.d | (e.m & (4294967295 - s.g)) END}}).g"


def _final(es: str) -> str:
    """SQL of the rights that the entries ``es`` of a row of ``rights`` give."""
    return f"((CASE WHEN listed THEN {_GRANTED.format(es=es, ntfs='true')} ELSE 2032127 END | own) & CASE WHEN seen THEN {_GRANTED.format(es=es, ntfs='false')} ELSE 4294967295 END)"


#: Every removal evaluated anew: one entry gone, or all entries of the trustees that a membership alone leads to.
_REMOVALS = _EVIDENCE + f""", own_edges AS (SELECT DISTINCT k.principal_key, e.group_key, e.member_key FROM (SELECT DISTINCT principal_key FROM asked) k JOIN tokens t ON t.principal_key = k.principal_key AND t.origin <> 'assumed' JOIN edges e ON e.member_key = t.sid),
still(principal_key, group_key, member_key, node) AS (SELECT principal_key, group_key, member_key, principal_key FROM own_edges
  UNION SELECT s.principal_key, s.group_key, s.member_key, e.group_key FROM still s JOIN edges e ON e.member_key = s.node WHERE NOT (e.group_key = s.group_key AND e.member_key = s.member_key)),
gone AS MATERIALIZED (SELECT o.principal_key, o.group_key, o.member_key, list(t.sid) AS lost FROM own_edges o JOIN tokens t ON t.principal_key = o.principal_key AND t.origin = 'membership' ANTI JOIN still s ON s.principal_key = o.principal_key AND s.group_key = o.group_key AND s.member_key = o.member_key AND s.node = t.sid GROUP BY 1, 2, 3),
leads AS (SELECT DISTINCT n.principal_key, n.resource_key, o.group_key, o.member_key FROM ents n JOIN own_edges o ON o.principal_key = n.principal_key LEFT JOIN reach r ON r.member_key = o.group_key AND r.group_key = n.trustee_key WHERE n.origin = 'membership' AND (n.trustee_key = o.group_key OR r.group_key IS NOT NULL)),
removals AS MATERIALIZED (SELECT principal_key, resource_key, CASE WHEN x.n THEN 'ntfs_ace' ELSE 'share_ace' END AS kind, x.k AS edge_key, {_final('es')} AS before, {_final('list_filter(es, lambda e: e.k <> x.k OR e.n <> x.n)')} AS after FROM (SELECT *, unnest(es) AS x FROM rights)
  UNION ALL SELECT r.principal_key, r.resource_key, 'membership', l.group_key || '->' || l.member_key || '|*', {_final('es')}, {_final('list_filter(es, lambda e: NOT list_contains(coalesce(lost, []), e.t))')}
  FROM rights r JOIN leads l ON l.principal_key = r.principal_key AND l.resource_key = r.resource_key LEFT JOIN gone g ON g.principal_key = l.principal_key AND g.group_key = l.group_key AND g.member_key = l.member_key)"""


@on_estate(_REMOVALS + " SELECT principal_key, resource_key, kind, edge_key, before & (4294967295 - after) AS rights_removed, after & (4294967295 - before) AS rights_added, after AS rights_after, before <> 0 AND after = 0 AS revokes_all FROM removals")
def measured_removals(e: Estate) -> DataFrame:
    e = e.settled()
    return causality.measured_removals(e, asked_pairs(e))


#: What each entry settles: the mask without all masks before it.
_NOVEL = _EVIDENCE + f""", finals AS (SELECT principal_key, resource_key, own, seen, CASE WHEN listed THEN {_GRANTED.format(es='es', ntfs='true')} ELSE 2032127 END | own AS n, {_GRANTED.format(es='es', ntfs='false')} AS s FROM rights),
novel AS MATERIALIZED (SELECT e.principal_key, e.resource_key, layer, ace_key, trustee_key, origin, order_index, CASE WHEN allow THEN 'grant' ELSE 'deny' END AS relation,
    mask & (4294967295 - coalesce(bit_or(mask) OVER (PARTITION BY e.principal_key, e.resource_key, layer ORDER BY order_index, ace_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS novel FROM ents e
  UNION ALL SELECT principal_key, resource_key, 'ntfs', NULL, principal_key, 'subject', -1, 'grant', own FROM finals WHERE own <> 0)"""


@on_estate(_NOVEL + """, c AS (SELECT v.*, novel & o AS delivered, novel & (4294967295 - o) AS constrained FROM (SELECT v.*, CASE WHEN NOT seen THEN 4294967295 WHEN layer = 'ntfs' THEN f.s ELSE f.n END AS o FROM novel v JOIN finals f USING (principal_key, resource_key)) v)
SELECT principal_key, resource_key, layer, ace_key, trustee_key, relation, novel, delivered, constrained, CASE WHEN novel = 0 THEN 'redundant' WHEN delivered = 0 AND constrained <> 0 THEN 'constrained' ELSE 'contributes' END AS effect FROM c""")
def path_effects(e: Estate) -> DataFrame:
    e = e.settled()
    return causality.path_effects(*causality.evidence(e, asked_pairs(e)))


@on_estate(_NOVEL + """, r AS (SELECT v.*, CASE WHEN seen THEN f.n & f.s ELSE f.n END AS final FROM novel v JOIN finals f USING (principal_key, resource_key) WHERE relation = 'grant'),
k AS (SELECT *, row_number() OVER (PARTITION BY principal_key, resource_key, layer ORDER BY bit_count(novel & final) DESC, origin = 'assumed', order_index, ace_key) AS seat FROM r WHERE novel & final <> 0)
SELECT principal_key, resource_key, layer, ace_key, trustee_key, novel & final AS coverage, bit_count(novel & final)::double / bit_count(final)::double AS share_of_rights FROM k WHERE seat = 1""")
def primary_routes(e: Estate) -> DataFrame:
    e = e.settled()
    return causality.primary_routes(*causality.evidence(e, asked_pairs(e)))


@on_estate(_EVIDENCE + """, sw(start, node, path) AS (SELECT DISTINCT principal_key, principal_key, [principal_key] FROM asked UNION ALL SELECT start, e.group_key, list_append(path, e.group_key) FROM sw JOIN edges e ON e.member_key = node WHERE NOT list_contains(path, e.group_key)),
short AS (SELECT start, node, first(path ORDER BY len(path), path) AS path FROM sw GROUP BY 1, 2),
hops AS (SELECT DISTINCT u.principal_key, u.resource_key, path[i] AS m, path[i + 1] AS g FROM (SELECT u.*, path, unnest(range(1, len(path))) AS i FROM (SELECT DISTINCT principal_key, resource_key, trustee_key FROM ents WHERE origin = 'membership') u JOIN short ON start = u.principal_key AND node = u.trustee_key) u)
SELECT kind, count(*) AS n, count(DISTINCT principal_key || resource_key) AS pairs FROM (
  SELECT 'membership' AS kind, principal_key, resource_key FROM hops UNION ALL SELECT DISTINCT 'assumed', principal_key, resource_key FROM (SELECT DISTINCT principal_key, resource_key, trustee_key FROM ents WHERE origin = 'assumed') UNION ALL
  SELECT 'trustee', principal_key, resource_key FROM ents UNION ALL SELECT CASE WHEN allow THEN 'grant' ELSE 'deny' END, principal_key, resource_key FROM ents UNION ALL
  SELECT 'ownership', principal_key, resource_key FROM rights WHERE own <> 0 UNION ALL SELECT DISTINCT 'bounds', principal_key, resource_key FROM ents WHERE layer = 'share') GROUP BY 1""".replace("SELECT DISTINCT 'assumed', principal_key, resource_key FROM (", "SELECT 'assumed', principal_key, resource_key FROM ("))
def explanation_edges(e: Estate) -> DataFrame:
    e = e.settled()
    _, edges = causality.explanation(e, asked_pairs(e))
    return edges.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct(F.concat("principal_key", "resource_key")).alias("pairs"))


_WALKS = """, up(root, node, path) AS (SELECT principal_key, principal_key, [principal_key] FROM principals WHERE kind = 'managed_service_account' UNION ALL SELECT root, e.group_key, list_append(path, e.group_key) FROM up JOIN edges e ON e.member_key = node WHERE NOT list_contains(path, e.group_key))"""


@on_estate(_WALKS + " SELECT root, node AS key, (min(len(path)) - 1)::int AS depth, array_to_string(first(path ORDER BY len(path), path), '>') AS path FROM up WHERE node <> root GROUP BY 1, 2")
def expansions(e: Estate) -> DataFrame:
    roots = e.principals.where("kind = 'managed_service_account'").select(F.col("principal_key").alias("key"))
    return graph.expand(e.edges, roots, down=False)[0].select("root", "key", "depth", F.array_join("path", ">").alias("path"))


@on_estate(_WALKS + f", p AS (SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY len(path), path) AS seat, count(*) OVER (PARTITION BY root) AS n FROM up WHERE node = '{DOMAIN_USERS}') SELECT root, array_to_string(path, '>') AS path, n > 1 AS truncated FROM p WHERE seat <= 1")
def find_paths(e: Estate) -> DataFrame:
    """One way to the domain's users for each service, and whether there are others."""
    pairs = e.principals.where("kind = 'managed_service_account'").select(F.col("principal_key").alias("root"), F.lit(DOMAIN_USERS).alias("target"))
    paths, summary = graph.find_paths(e.edges, pairs, max_paths=1)
    return paths.join(summary, ["root", "target"]).select("root", F.array_join("path", ">").alias("path"), F.array_contains("truncation", "max_paths").alias("truncated"))


# Plans of changes

#: A plan with changes of every kind and outcome, dealt over lists and memberships by their numbers.
_PLAN = """, ek AS (SELECT ace_key, resource_key, access_mask, order_index, length(ace_key) AS n FROM ntfs_aces WHERE resource_key LIKE '%\\p%'),
plan AS MATERIALIZED (
  SELECT 'r' || ace_key AS change_no, 'remove_entry' AS action, ace_key AS target, NULL AS member, NULL::bigint AS value FROM ek WHERE order_index % 5 = 0
  UNION ALL SELECT 's' || ace_key, 'remove_entry', ace_key, NULL, NULL FROM ek WHERE order_index % 15 = 0
  UNION ALL SELECT 'q' || ace_key, 'remove_entry', ace_key || 'x', NULL, NULL FROM ek WHERE order_index % 7 = 0
  UNION ALL SELECT 'm' || ace_key, 'modify_entry', CASE WHEN n % 3 = 0 THEN ace_key || 'x' ELSE ace_key END, NULL, CASE WHEN n % 3 = 1 THEN access_mask ELSE access_mask & 1179785 END FROM ek WHERE order_index % 5 = 1
  UNION ALL SELECT 'a' || ace_key, 'add_entry', CASE WHEN n % 3 = 0 THEN ace_key ELSE ace_key || 'y' END, CASE WHEN n % 3 = 1 THEN resource_key || 'y' ELSE resource_key END, 1179785 FROM ek WHERE order_index % 5 = 2
  UNION ALL SELECT 'g' || group_key || member_key, CASE WHEN length(member_key) % 2 = 0 THEN 'add_member' ELSE 'remove_member' END, group_key, member_key, NULL FROM edges
  UNION ALL SELECT 'h' || group_key || member_key, CASE WHEN length(group_key) % 2 = 0 THEN 'add_member' ELSE 'remove_member' END, group_key, member_key || CASE WHEN member_key LIKE '%7' THEN '' ELSE 'z' END, NULL FROM edges WHERE member_key NOT LIKE '%3')"""
_PLAN = _PLAN.replace("member_key || CASE WHEN member_key LIKE '%7' THEN '' ELSE 'z' END", "CASE WHEN member_key LIKE '%7' THEN replace(member_key, '-1-1-1-', '-1-1-4-') ELSE '" + DOMAIN_USERS + "' END")


def _plan(e: Estate) -> DataFrame:
    n, at = F.length("ace_key"), F.col("order_index")
    key, mask, none, nothing = F.col("ace_key"), F.col("access_mask"), F.lit(None).cast("string"), F.lit(None).cast("long")
    on = e.ntfs_aces.where(F.col("resource_key").contains("\\p"))
    change = lambda rows, letter, action, target, member, value: rows.select(F.concat(F.lit(letter), key).alias("change_no"), F.lit(action).alias("action"), target.alias("target"), member.alias("member"), value.alias("value"))
    few = mask.bitwiseAND(F.lit(1179785).cast("long"))
    plan = change(on.where(at % 5 == 0), "r", "remove_entry", key, none, nothing)
    plan = plan.unionByName(change(on.where(at % 15 == 0), "s", "remove_entry", key, none, nothing)).unionByName(change(on.where(at % 7 == 0), "q", "remove_entry", F.concat(key, F.lit("x")), none, nothing))
    plan = plan.unionByName(change(on.where(at % 5 == 1), "m", "modify_entry", F.when(n % 3 == 0, F.concat(key, F.lit("x"))).otherwise(key), none, F.when(n % 3 == 1, mask).otherwise(few)))
    plan = plan.unionByName(change(on.where(at % 5 == 2), "a", "add_entry", F.when(n % 3 == 0, key).otherwise(F.concat(key, F.lit("y"))), F.when(n % 3 == 1, F.concat("resource_key", F.lit("y"))).otherwise(F.col("resource_key")), F.lit(1179785).cast("long")))
    g, m = F.col("group_key"), F.col("member_key")
    side = lambda rows, letter, odd, member: rows.select(F.concat(F.lit(letter), g, m).alias("change_no"), F.when(F.length(odd) % 2 == 0, "add_member").otherwise("remove_member").alias("action"), g.alias("target"), member.alias("member"), nothing.alias("value"))
    other = F.when(m.endswith("7"), F.replace(m, F.lit("-1-1-1-"), F.lit("-1-1-4-"))).otherwise(F.lit(DOMAIN_USERS))
    return plan.unionByName(side(e.edges, "g", m, m)).unionByName(side(e.edges.where(~m.endswith("3")), "h", g, other))


@on_estate(_PLAN + """, seated AS (SELECT *, row_number() OVER (PARTITION BY action, target, member ORDER BY change_no) AS seat FROM plan)
SELECT change_no, CASE WHEN seat > 1 THEN 'repeated' WHEN action IN ('add_member', 'remove_member') THEN CASE WHEN p.principal_key IS NULL OR w.principal_key IS NULL THEN 'target_unknown' WHEN action = 'add_member' THEN CASE WHEN d.group_key IS NULL THEN 'applied' ELSE 'already_present' END WHEN d.group_key IS NULL THEN 'already_absent' ELSE 'applied' END
  WHEN action = 'remove_entry' THEN CASE WHEN a.ace_key IS NULL THEN 'already_absent' ELSE 'applied' END WHEN action = 'modify_entry' THEN CASE WHEN a.ace_key IS NULL THEN 'target_unknown' WHEN a.access_mask = value THEN 'mask_unchanged' ELSE 'applied' END
  WHEN r.resource_key IS NULL THEN 'target_unknown' WHEN a.ace_key IS NULL THEN 'applied' ELSE 'already_present' END AS outcome
FROM seated s LEFT JOIN ntfs_aces a ON a.ace_key = target LEFT JOIN principals p ON p.principal_key = target LEFT JOIN principals w ON w.principal_key = member LEFT JOIN resources r ON r.resource_key = member LEFT JOIN (SELECT DISTINCT group_key, member_key FROM edges) d ON d.group_key = target AND d.member_key = member""")
def plan_applicability(e: Estate) -> DataFrame:
    e = e.with_(ntfs_aces=tables.cut(e.ntfs_aces))
    return simulate.applicability(e, _plan(e))


@on_estate(""", hit AS (SELECT resource_key FROM resources WHERE depth = 0 AND length(resource_key) % 2 = 0 UNION SELECT resource_key FROM resources WHERE depth = 1 AND length(resource_key) % 3 = 0 UNION SELECT resource_key FROM resources WHERE depth = 2 AND dacl_protected)
SELECT resource_key, min(distance)::int AS distance FROM (SELECT resource_key, 0 AS distance FROM hit UNION ALL SELECT r.resource_key, 1 FROM resources r JOIN hit ON hit.resource_key = r.parent_key WHERE NOT r.dacl_protected AND r.dacl_present
  UNION ALL SELECT r.resource_key, 2 FROM resources r JOIN resources p ON p.resource_key = r.parent_key JOIN hit ON hit.resource_key = p.parent_key WHERE NOT r.dacl_protected AND r.dacl_present AND NOT p.dacl_protected AND p.dacl_present) GROUP BY 1""")
def affected_resources(e: Estate) -> DataFrame:
    n = F.length("resource_key")
    lists = e.resources.where(((F.col("depth") == 0) & (n % 2 == 0)) | ((F.col("depth") == 1) & (n % 3 == 0)) | ((F.col("depth") == 2) & F.col("dacl_protected")))
    return simulate.affected_resources(e, lists.select("resource_key"))


#: The masks of a resource's list once it is protected (entries kept or dropped) or hands are open to its parent again.
@on_estate(""", ch AS (SELECT resource_key, length(resource_key) % 2 = 0 AS protected, length(resource_key) % 4 = 0 AS keep FROM resources WHERE depth = 2 AND length(resource_key) % 5 <> 0),
own AS (SELECT a.resource_key, trustee_key, ace_type, access_mask, CASE WHEN protected AND ace_flags & 16 <> 0 THEN ace_flags - 16 ELSE ace_flags END AS ace_flags FROM ntfs_aces a JOIN ch USING (resource_key) WHERE ace_flags & 16 = 0 OR (protected AND keep)),
handed AS (SELECT c.resource_key, a.trustee_key, a.ace_type, a.access_mask, CASE WHEN a.ace_flags & 4 <> 0 THEN 16 ELSE 16 | (a.ace_flags & 3) END AS ace_flags FROM ch c JOIN resources r ON r.resource_key = c.resource_key JOIN ntfs_aces a ON a.resource_key = r.parent_key WHERE NOT protected AND a.ace_flags & 2 <> 0),
both_ AS (SELECT DISTINCT * FROM (SELECT * FROM own UNION ALL SELECT * FROM handed) UNION ALL SELECT resource_key, trustee_key, ace_type, access_mask, ace_flags FROM ntfs_aces WHERE resource_key NOT IN (SELECT resource_key FROM ch))
SELECT r.resource_key, r.dacl_protected IS NOT NULL AND coalesce(c.protected, r.dacl_protected) AS dacl_protected, count(b.trustee_key) AS entries, coalesce(sum((b.ace_flags & 16 <> 0)::int), 0)::bigint AS inherited FROM resources r LEFT JOIN ch c ON c.resource_key = r.resource_key LEFT JOIN both_ b ON b.resource_key = r.resource_key GROUP BY 1, 2""")
def protection_overlay(e: Estate) -> DataFrame:
    n = F.length("resource_key")
    changes = e.resources.where((F.col("depth") == 2) & (n % 5 != 0)).select("resource_key", (n % 2 == 0).alias("protected"), (n % 4 == 0).alias("keep"))
    planned = simulate.with_protection(e, changes)
    held = planned.ntfs_aces.groupBy("resource_key").agg(F.count("*").alias("entries"), F.count_if(F.col("ace_flags").bitwiseAND(16) != 0).alias("inherited"))
    return planned.resources.join(held, "resource_key", "left").select("resource_key", "dacl_protected", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("inherited", F.lit(0)).alias("inherited"))


@on_estate(_EVIDENCE + f""", es2 AS (SELECT *, list_filter(list_transform(es, lambda x: CASE WHEN NOT x.n AND x.m = 1245631 THEN {{'k': x.k, 't': x.t, 'a': x.a, 'm': 1179817::bigint, 'n': x.n, 'g': x.g, 'd': x.d}} ELSE x END), lambda x: x.n OR x.m <> 2032127) AS es2 FROM rights)
SELECT principal_key, resource_key, {_final('es')} AS before, ((CASE WHEN listed THEN {_GRANTED.format(es='es2', ntfs='true')} ELSE 2032127 END | own) & CASE WHEN seen THEN {_GRANTED.format(es='es2', ntfs='false')} ELSE 4294967295 END) AS after FROM es2""")
def share_overlay(e: Estate) -> DataFrame:
    """Every change permission of a share lowered to read, and full ones taken away."""
    e = e.settled()
    s = e.share_aces
    planned = simulate.with_shares(e, removed=s.where("permission = 'full'").select("ace_key"), modified=s.where("permission = 'change'").select("ace_key", F.lit("read").alias("new_permission")))
    side = lambda x, name: causality.evidence(x, asked_pairs(e))[1].select("principal_key", "resource_key", F.col("rights").alias(name))
    return side(e, "before").join(side(planned, "after"), ["principal_key", "resource_key"])


# Comparison with a cut, what a run's changes concern, and what a run may close

#: Objects of one side that are read at most.
CEILING = 10
_T1, _T2 = "2024-01-10", "2024-01-20"
_CUT = f""", a AS (SELECT key, container, state, true AS seen FROM log WHERE valid_from <= TIMESTAMP '{_T1}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_T1}')),
b AS (SELECT key, container, state, true AS seen FROM log WHERE valid_from <= TIMESTAMP '{_T2}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_T2}')),
ends AS (SELECT min(key) AS last FROM (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY key) AS seat, count(*) OVER () AS n FROM a WHERE state IS NOT NULL) WHERE seat = {CEILING} AND n > {CEILING} UNION ALL SELECT key FROM (SELECT key, row_number() OVER (ORDER BY key) AS seat, count(*) OVER () AS n FROM b WHERE state IS NOT NULL) WHERE seat = {CEILING} AND n > {CEILING})),
fits AS (SELECT container, coalesce(x.n, 0) + coalesce(y.n, 0) AS n FROM (SELECT container, count(*) AS n FROM a WHERE state IS NOT NULL GROUP BY 1) x FULL JOIN (SELECT container, count(*) AS n FROM b WHERE state IS NOT NULL GROUP BY 1) y USING (container) WHERE coalesce(x.n, 0) <= {CEILING} AND coalesce(y.n, 0) <= {CEILING}),
cmp AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.seen IS NULL THEN CASE WHEN b.state IS NOT NULL THEN 'first_observed' ELSE 'absent' END WHEN b.seen IS NULL THEN 'unobserved' WHEN a.state IS NULL AND b.state IS NOT NULL THEN 'added' WHEN a.state IS NOT NULL AND b.state IS NULL THEN 'removed' WHEN a.state IS NOT DISTINCT FROM b.state THEN 'same' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.key = b.key)"""


@on_log(_CUT + " SELECT key, change, CASE WHEN last IS NULL THEN 'complete' ELSE 'partial' END AS outcome, 'session|' || last AS boundary, CASE WHEN last IS NOT NULL THEN (SELECT container FROM fits ORDER BY n DESC, container LIMIT 1) END AS scope FROM cmp, ends WHERE last IS NULL OR key <= last")
def compare_cut(v: DataFrame) -> DataFrame:
    v = tables.cut(v)
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    rows, outcome = changes.compare_cut(v, at(_T1), at(_T2), CEILING)
    one = F.lit(1)
    return rows.select("key", "change", one.alias("_")).join(outcome.withColumn("_", one), "_").drop("_")


_RUNS = """, changed AS (SELECT 'run' || (order_index % 4) AS run_id, 'ntfs_ace' AS kind, ace_key AS key FROM ntfs_aces WHERE order_index % 4 < 2 UNION ALL SELECT 'run' || (length(member_key) % 4), 'membership_edge', group_key FROM edges WHERE group_key LIKE 'S-1-5-21-1-1-4-%' UNION ALL SELECT 'run9', 'ntfs_resource', resource_key FROM resources WHERE depth = 1)"""


def _changed(e: Estate) -> DataFrame:
    row = lambda rows, run, kind, key: rows.select(run.alias("run_id"), F.lit(kind).alias("kind"), key.alias("key"))
    run = lambda n: F.concat(F.lit("run"), (n % 4).cast("string"))
    out = row(e.ntfs_aces.where(F.col("order_index") % 4 < 2), run(F.col("order_index")), "ntfs_ace", F.col("ace_key"))
    out = out.unionByName(row(e.edges.where(F.col("group_key").startswith("S-1-5-21-1-1-4-")), run(F.length("member_key")), "membership_edge", F.col("group_key")))
    return out.unionByName(row(e.resources.where("depth = 1"), F.lit("run9"), "ntfs_resource", F.col("resource_key")))


@on_estate(_RUNS + ", reads(kind, rule) AS (VALUES " + ", ".join(f"('{k}', '{rule}')" for rule, kinds in risk.DEPENDS_ON.items() for k in kinds) + ") SELECT DISTINCT run_id, rule FROM changed JOIN reads USING (kind)")
def rules_affected(e: Estate) -> DataFrame:
    return risk.rules_affected(_changed(e))


@on_estate(base.REACH + """, who AS (SELECT group_key AS k FROM edges WHERE group_key = 'S-1-5-21-1-1-4-1002'), up AS (SELECT k FROM who UNION SELECT r.group_key FROM reach r JOIN who ON r.member_key = k), own AS (SELECT resource_key FROM ntfs_aces WHERE order_index = 7)
SELECT resource_key FROM ntfs_aces WHERE trustee_key IN (SELECT k FROM up) UNION SELECT resource_key FROM own UNION SELECT r.resource_key FROM resources r JOIN own ON own.resource_key = r.parent_key""")
def resources_affected(e: Estate) -> DataFrame:
    group = e.edges.where("group_key = 'S-1-5-21-1-1-4-1002'").select(F.lit("membership_edge").alias("kind"), F.col("group_key").alias("key"))
    entries = e.ntfs_aces.where("order_index = 7").select(F.lit("ntfs_ace").alias("kind"), F.col("ace_key").alias("key"))
    return risk.resources_affected(e, group.unionByName(entries))


_SCOPES = """, objects AS MATERIALIZED (SELECT 'principal' AS kind, principal_key AS key, NULL AS server_key, NULL AS share_key, NULL AS resource_key, NULL AS host_key, NULL AS group_key, regexp_replace(principal_key, '-[0-9]+$', '') AS domain_sid FROM principals
  UNION ALL SELECT 'principal', server_key || '|S-1-5-32-544', NULL, NULL, NULL, server_key, NULL, NULL FROM servers UNION ALL SELECT 'membership_edge', group_key || '->' || member_key, NULL, NULL, NULL, NULL, group_key, NULL FROM edges
  UNION ALL SELECT 'membership_edge', server_key || '|S-1-5-32-544->x', NULL, NULL, NULL, server_key, server_key || '|S-1-5-32-544', NULL FROM servers UNION ALL SELECT 'server', server_key, server_key, NULL, NULL, NULL, NULL, NULL FROM servers
  UNION ALL SELECT 'smb_share', share_key, server_key, share_key, NULL, NULL, NULL, NULL FROM shares UNION ALL SELECT 'smb_ace', ace_key, NULL, share_key, NULL, NULL, NULL, NULL FROM share_aces
  UNION ALL SELECT 'ntfs_resource', resource_key, server_key, share_key, resource_key, NULL, NULL, NULL FROM resources UNION ALL SELECT 'ntfs_ace', ace_key, NULL, NULL, resource_key, NULL, NULL, NULL FROM ntfs_aces),
picked(scope_no, kind, key) AS (
  SELECT 'ad', kind, key FROM objects WHERE kind = 'principal' AND host_key IS NULL AND domain_sid IN ('S-1-5-21-1-1-1', 'S-1-5-21-1-1-3')
  UNION ALL SELECT 'ad', kind, key FROM objects o WHERE kind = 'membership_edge' AND host_key IS NULL AND group_key IN (SELECT principal_key FROM principals WHERE regexp_replace(principal_key, '-[0-9]+$', '') IN ('S-1-5-21-1-1-1', 'S-1-5-21-1-1-3'))
  UNION ALL SELECT 'local ' || host_key, kind, key FROM objects WHERE host_key IS NOT NULL
  UNION ALL SELECT 'smb ' || server_key, kind, key FROM objects WHERE kind IN ('server', 'smb_share') UNION ALL SELECT 'smb ' || s.server_key, kind, key FROM objects JOIN shares s ON s.share_key = objects.share_key WHERE kind = 'smb_ace'
  UNION ALL SELECT 'share ' || share_key, kind, key FROM objects WHERE kind = 'ntfs_resource' AND length(share_key) % 2 = 0 UNION ALL SELECT 'share ' || r.share_key, kind, key FROM objects JOIN resources r ON r.resource_key = objects.resource_key WHERE kind = 'ntfs_ace' AND length(r.share_key) % 2 = 0
  UNION ALL SELECT 'tree ' || t.resource_key, kind, key FROM objects JOIN resources t ON t.depth = 1 AND (objects.resource_key = t.resource_key OR starts_with(objects.resource_key, t.resource_key || '\\')) WHERE kind IN ('ntfs_resource', 'ntfs_ace'))"""


def _objects(e: Estate) -> DataFrame:
    none = F.lit(None).cast("string")

    def rows(table: DataFrame, kind: str, key, **columns) -> DataFrame:
        return table.select(F.lit(kind).alias("kind"), key.alias("key"), *[columns.get(c, none).alias(c) for c in closing.COLUMNS])

    c, local = F.col, F.concat("server_key", F.lit("|S-1-5-32-544"))
    out = rows(e.principals, "principal", c("principal_key"), domain_sid=F.regexp_replace("principal_key", "-[0-9]+$", ""))
    out = out.unionByName(rows(e.servers, "principal", local, host_key=c("server_key"))).unionByName(rows(e.edges, "membership_edge", F.concat("group_key", F.lit("->"), "member_key"), group_key=c("group_key")))
    out = out.unionByName(rows(e.servers, "membership_edge", F.concat(local, F.lit("->x")), host_key=c("server_key"), group_key=local)).unionByName(rows(e.servers, "server", c("server_key"), server_key=c("server_key")))
    out = out.unionByName(rows(e.shares, "smb_share", c("share_key"), server_key=c("server_key"), share_key=c("share_key"))).unionByName(rows(e.share_aces, "smb_ace", c("ace_key"), share_key=c("share_key")))
    out = out.unionByName(rows(e.resources, "ntfs_resource", c("resource_key"), server_key=c("server_key"), share_key=c("share_key"), resource_key=c("resource_key")))
    return out.unionByName(rows(e.ntfs_aces, "ntfs_ace", c("ace_key"), resource_key=c("resource_key")))


@on_estate(_SCOPES + " SELECT scope_no, kind, count(*) AS closed, min(key) AS first_key FROM picked WHERE length(key) % 3 = 0 GROUP BY 1, 2")
def scopes_closed(e: Estate) -> DataFrame:
    """Complete runs of all kinds of scopes, and one that nothing rules, each of which saw two of three of its objects."""
    scope = lambda rows, name, key, collector, kind: rows.select(F.concat(F.lit(name), key).alias("scope_no"), F.lit(collector).alias("collector"), F.lit(kind).alias("scope_kind"), key.alias("scope_key"), F.lit(True).alias("complete"))
    scopes = scope(e.servers, "local ", F.col("server_key"), "local_groups", "local_groups_host").unionByName(scope(e.servers, "smb ", F.col("server_key"), "smb", "server"))
    scopes = scopes.unionByName(scope(e.shares.where(F.length("share_key") % 2 == 0), "share ", F.col("share_key"), "ntfs", "share")).unionByName(scope(e.resources.where("depth = 1"), "tree ", F.col("resource_key"), "ntfs", "directory_tree"))
    scopes = scopes.unionByName(scope(e.servers, "none ", F.col("server_key"), "ntfs", "volume"))
    one = e.servers.limit(1).select(F.lit("ad").alias("scope_no"), F.lit("active_directory").alias("collector"), F.lit("domain").alias("scope_kind"), F.lit("corp").alias("scope_key"), F.lit(True).alias("complete"))
    domains = F.when(F.col("scope_no") == "ad", F.array(F.lit("S-1-5-21-1-1-1"), F.lit("S-1-5-21-1-1-3")))
    scopes = tables.cut(scopes.unionByName(one).withColumn("domains", domains))
    objects = tables.cut(_objects(e))
    chosen = tables.cut(closing.selected(scopes, objects))
    observed = chosen.where(F.length("key") % 3 != 0)
    return closing.closed(scopes, objects, observed, chosen=chosen).groupBy("scope_no", "kind").agg(F.count("*").alias("closed"), F.min("key").alias("first_key"))


@on_estate(""", unread AS (SELECT resource_key, parent_key, depth FROM resources WHERE depth = 2 OR (depth = 1 AND length(resource_key) % 2 = 0)),
src AS (SELECT u.resource_key, CASE WHEN p.resource_key IS NULL THEN u.parent_key ELSE p.parent_key END AS source_key, CASE WHEN p.resource_key IS NULL THEN 1 ELSE 2 END AS distance FROM unread u LEFT JOIN unread p ON p.resource_key = u.parent_key),
lists AS (SELECT resource_key, trustee_key, ace_type, access_mask, ace_flags, order_index FROM ntfs_aces UNION ALL SELECT resource_key, 'S-1-3-0', 'allow', 268435456, 11, 5 FROM resources WHERE depth < 2 UNION ALL SELECT resource_key, 'S-1-5-11', 'allow', 1179785, 7, 6 FROM resources WHERE depth < 2 UNION ALL SELECT resource_key, 'S-1-5-11', 'deny', 278, 1, 7 FROM resources WHERE depth < 2),
kinds(ace_flags, wide, distance, seat, flags) AS (VALUES (3, false, 1, 0, 19), (3, false, 2, 0, 19), (19, false, 1, 0, 19), (19, false, 2, 0, 19), (11, true, 1, 1, 27), (11, true, 2, 1, 27), (7, false, 1, 0, 16), (1, false, 1, 0, 25), (1, false, 2, 0, 25))
SELECT s.resource_key, s.source_key, s.distance, l.trustee_key, l.ace_type, l.access_mask, k.flags AS ace_flags, (row_number() OVER (PARTITION BY s.resource_key ORDER BY l.order_index) - 1)::int AS order_index FROM src s JOIN lists l ON l.resource_key = s.source_key JOIN kinds k ON k.ace_flags = l.ace_flags AND k.wide = (l.trustee_key = 'S-1-3-0') AND k.distance = s.distance""")
def derived_entries(e: Estate) -> DataFrame:
    """Lists of leaves and of half the folders unread; folders also hand down a creator's entry, one that stops after a level, and one for files."""
    row = lambda trustee, kind, mask, flags, seat: e.resources.where("depth < 2").select("resource_key", F.lit(trustee).alias("trustee_key"), F.lit(kind).alias("ace_type"), F.lit(mask).cast("long").alias("access_mask"), F.lit(flags).alias("ace_flags"), F.lit(seat).alias("order_index"), F.concat("resource_key", F.lit(str(seat))).alias("ace_key"))
    aces = e.ntfs_aces.unionByName(row(keys.CREATOR_OWNER, "allow", 268435456, 11, 5)).unionByName(row(keys.AUTHENTICATED, "allow", 1179785, 7, 6)).unionByName(row(keys.AUTHENTICATED, "deny", 278, 1, 7))
    read = e.resources.where((F.col("depth") == 0) | ((F.col("depth") == 1) & (F.length("resource_key") % 2 != 0)))
    return access.derived_entries(e.resources, aces, read)


@on_estate("SELECT resource_key, row_number() OVER (ORDER BY resource_key) AS n FROM resources QUALIFY n = 100")
def nth_resource(e: Estate) -> DataFrame:
    return changes.nth_key(e.resources.select(F.col("resource_key").alias("k")), 100).select(F.col("k").alias("resource_key"), F.lit(100).cast("long").alias("n"))


# Classified changes

_E, _N = keys.EVERYONE, "S-1-5-21-1-1-3-1001"


def _ace(mask: str, kind: str = "allow", who: str = _N, **more: str) -> dict:
    return {"ace_type": kind, "trustee_key": who, "access_mask": mask, **more}


#: (rule, kind, action, before, after, container_key, related_key, ordering_material, sibling_ace_changes): a change for every rule, and some that several rules fit.
SCENARIOS: list[tuple] = [
    ("first_observed", "ntfs_ace", "first_observed", None, _ace("2032127", who=_E), None, None, None, None),
    ("identity.drift", "principal", "modified", {"sid": "a", "enabled": "true"}, {"sid": "b", "enabled": "false"}, None, None, None, None),
    ("ace.allow.broad.full", "ntfs_ace", "added", None, _ace("268435456", who=_E), None, None, None, None),
    ("ace.allow.broad.full", "smb_ace", "added", None, {"ace_type": "allow", "trustee_key": _E, "permission": "full"}, None, None, None, None),
    ("ace.allow.broad.escalation", "ntfs_ace", "added", None, _ace("262144", who="S-1-5-11"), None, None, None, None),
    ("ace.allow.broad.write", "smb_ace", "added", None, {"ace_type": "allow", "trustee_key": _E, "permission": "change"}, None, None, None, None),
    ("ace.allow.broad", "ntfs_ace", "added", None, _ace("1179817", who=DOMAIN_USERS), None, None, None, None),
    ("ace.deny.removed", "ntfs_ace", "removed", _ace("2032127", "deny"), None, None, None, None, None),
    ("ace.allow.full", "ntfs_ace", "added", None, _ace("2032127"), None, None, None, None),
    ("ace.allow.escalation", "ntfs_ace", "added", None, _ace("983551"), None, None, None, None),
    ("ace.order.material", "ntfs_ace", "modified", _ace("1", order_index="1"), _ace("1", order_index="2"), None, None, True, None),
    ("ace.allow.added", "ntfs_ace", "added", None, _ace("1179817"), None, None, None, None),
    ("ace.deny.added", "ntfs_ace", "added", None, _ace("2032127", "deny", _E), None, None, None, None),
    ("ace.allow.removed", "ntfs_ace", "removed", _ace("2032127", who=_E), None, None, None, None, None),
    ("ace.source.explicit", "ntfs_ace", "modified", _ace("1", source="inherited"), _ace("1", source="explicit"), None, None, None, None),
    ("ace.source.inherited", "ntfs_ace", "modified", _ace("1", source="explicit"), _ace("1", source="inherited"), None, None, None, None),
    ("ace.order.immaterial", "smb_ace", "modified", _ace("1", order_index="1"), _ace("1", order_index="2"), None, None, False, None),
    ("ace.order.undetermined", "smb_ace", "modified", _ace("1", order_index="1"), _ace("1", order_index="2"), None, None, None, None),
    ("membership.added.privileged", "membership_edge", "added", None, {}, "S-1-5-21-1-1-1-512", _E, None, None),
    ("membership.added.broad", "membership_edge", "added", None, {}, _N, DOMAIN_USERS, None, None),
    ("membership.removed.privileged", "membership_edge", "removed", {}, None, "srv|S-1-5-32-544", _N, None, None),
    ("membership.added", "membership_edge", "added", None, {}, _N, "u", None, None),
    ("membership.removed", "membership_edge", "removed", {}, None, _N, DOMAIN_USERS, None, None),
    ("principal.group_type.security", "principal", "modified", {"group_type": "distribution", "enabled": "true"}, {"group_type": "security", "enabled": "false"}, None, None, None, None),
    ("principal.group_type.distribution", "principal", "modified", {"group_type": "security"}, {"group_type": "distribution"}, None, None, None, None),
    ("principal.enabled", "principal", "modified", {"enabled": "false"}, {"enabled": "true"}, None, None, None, None),
    ("principal.disabled", "principal", "modified", {}, {"enabled": "false"}, None, None, None, None),
    ("principal.undeleted", "principal", "modified", {"is_deleted": "true"}, {"is_deleted": "false"}, None, None, None, None),
    ("principal.deleted", "principal", "modified", {"is_deleted": "false", "group_scope": "a"}, {"is_deleted": "true", "group_scope": "b"}, None, None, None, None),
    ("principal.group_scope", "principal", "modified", {"group_scope": "global"}, {"group_scope": "universal"}, None, None, None, None),
    ("principal.removed", "principal", "removed", {"enabled": "true"}, None, None, None, None, None),
    ("principal.added", "principal", "added", None, {"enabled": "true"}, None, None, None, None),
    ("resource.null_dacl", "ntfs_resource", "modified", {"dacl_present": "true"}, {"dacl_present": "false"}, None, None, None, None),
    ("resource.added.null_dacl", "ntfs_resource", "added", None, {"dacl_present": "false"}, None, None, None, None),
    ("resource.unprotected", "ntfs_resource", "modified", {"dacl_protected": "true"}, {"dacl_protected": "false"}, None, None, None, None),
    ("resource.protected", "ntfs_resource", "modified", {"dacl_protected": "false", "owner_sid": "a"}, {"dacl_protected": "true", "owner_sid": _E}, None, None, None, None),
    ("resource.inheritance", "ntfs_resource", "modified", {"inheritance_enabled": "true"}, {"inheritance_enabled": "false"}, None, None, None, None),
    ("resource.owner.broad", "ntfs_resource", "modified", {"owner_sid": "a"}, {"owner_sid": _E}, None, None, None, None),
    ("resource.owner", "ntfs_resource", "modified", {"owner_sid": _E}, {"owner_sid": "b"}, None, None, None, None),
    ("resource.acl_hash.unexplained", "ntfs_resource", "modified", {"acl_hash": "1"}, {"acl_hash": "2"}, None, None, None, 0),
    ("resource.acl_hash", "ntfs_resource", "modified", {"acl_hash": "1"}, {"acl_hash": "2"}, None, None, None, 3),
    ("resource.acl_hash", "ntfs_resource", "modified", {"acl_hash": "1"}, {"acl_hash": "2"}, None, None, None, None),
    ("resource.removed", "ntfs_resource", "removed", {"dacl_present": "false"}, None, None, None, None, None),
    ("resource.added", "ntfs_resource", "added", None, {"dacl_present": "true"}, None, None, None, None),
    ("share.local_path", "smb_share", "modified", {"local_path": "c", "share_type": "disk"}, {"local_path": "d", "share_type": "ipc"}, None, None, None, None),
    ("share.type", "smb_share", "modified", {"share_type": "disk"}, {"share_type": "ipc"}, None, None, None, None),
    ("share.added", "smb_share", "added", None, {}, None, None, None, None),
    ("share.removed", "smb_share", "removed", {}, None, None, None, None, None),
    ("server.computer_sid", "server", "modified", {"computer_sid": "1", "domain_sid": "1"}, {"computer_sid": "2", "domain_sid": "2"}, None, None, None, None),
    ("server.domain", "server", "modified", {"is_domain_member": "true"}, {"is_domain_member": "false"}, None, None, None, None),
    ("server.removed", "server", "removed", {}, None, None, None, None, None),
    ("server.added", "server", "added", None, {}, None, None, None, None),
    ("unclassified.field", "server", "modified", {"shade": "1", "operating_system": "a"}, {"shade": "2", "operating_system": "b"}, None, None, None, None),
    ("security.other", "ntfs_ace", "modified", _ace("1", source="explicit", inherited_from="a"), _ace("1", inherited_from="b"), None, None, None, None),
    ("derived.other", "principal", "modified", {"domain_sid": "1", "display_name": "a"}, {"domain_sid": "2", "display_name": "b"}, None, None, None, None),
    ("metadata.other", "smb_share", "modified", {"description": "a", "source_key": "1"}, {"description": "b", "source_key": "2"}, None, None, None, None),
    ("provenance.only", "ntfs_resource", "modified", {"source_key": "1"}, {"source_key": "2"}, None, None, None, None),
    ("unclassified", "membership_edge", "modified", {"member_kind": "a"}, {"member_kind": "a"}, None, None, None, None),
]
# Severity and direction of the rules, for the SQL form.
GRADES = """first_observed info neutral; identity.drift high undetermined; ace.allow.broad.full critical broadened; ace.allow.broad.escalation critical broadened; ace.allow.broad.write high broadened; ace.allow.broad high broadened;
ace.deny.removed high broadened; ace.allow.full high broadened; ace.allow.escalation high broadened; ace.order.material high undetermined; ace.allow.added medium broadened; ace.deny.added low narrowed; ace.allow.removed low narrowed;
ace.source.explicit medium neutral; ace.source.inherited low neutral; ace.order.immaterial info neutral; ace.order.undetermined medium undetermined; membership.added.privileged critical broadened; membership.added.broad high broadened;
membership.removed.privileged medium narrowed; membership.added medium broadened; membership.removed low narrowed; principal.group_type.security high broadened; principal.group_type.distribution medium narrowed; principal.enabled medium broadened;
principal.disabled low narrowed; principal.undeleted medium broadened; principal.deleted medium narrowed; principal.group_scope low undetermined; principal.removed low narrowed; principal.added low neutral; resource.null_dacl critical broadened;
resource.added.null_dacl high broadened; resource.unprotected high undetermined; resource.protected medium undetermined; resource.inheritance medium undetermined; resource.owner.broad high broadened; resource.owner medium broadened;
resource.acl_hash.unexplained medium undetermined; resource.acl_hash low undetermined; resource.removed low narrowed; resource.added info neutral; share.local_path high undetermined; share.type medium undetermined; share.added medium broadened;
share.removed low narrowed; server.computer_sid high undetermined; server.domain medium undetermined; server.removed low neutral; server.added info neutral; unclassified.field medium undetermined; security.other medium undetermined;
derived.other info neutral; metadata.other info neutral; provenance.only info neutral; unclassified medium undetermined"""
_GRADED = {name: (severity, way) for name, severity, way in (x.split() for x in GRADES.split(";"))}


@on_estate(", planted(n, rule, severity, direction) AS (VALUES " + ", ".join(f"({i}, '{s[0]}', '{_GRADED[s[0]][0]}', '{_GRADED[s[0]][1]}')" for i, s in enumerate(SCENARIOS)) + ") SELECT p.p_partkey AS number, rule, severity, direction FROM placed p JOIN planted ON n = p_partkey % " + str(len(SCENARIOS)))
def change_rules(e: Estate) -> DataFrame:
    """A change of some kind for each leaf, by its number; every rule occurs."""
    number = F.regexp_extract("resource_key", r"\\p(\d+)$", 1).cast("int")
    leaves = e.resources.where("depth = 2").select(number.alias("number"), (number % len(SCENARIOS)).alias("n"))
    kinds = "n int, rule string, kind string, action string, before map<string,string>, after map<string,string>, container_key string, related_key string, ordering_material boolean, sibling_ace_changes int"
    planted = e.resources.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(SCENARIOS)], kinds).drop("rule")
    rows = leaves.join(planted, "n").withColumn("key", F.col("number").cast("string"))
    return classify.classified(rows).select("number", "rule", "severity", "direction")
