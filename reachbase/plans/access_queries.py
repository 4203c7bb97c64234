"""Queries on graphs, lists and access, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachbase.functions import keys, masks
from reachbase.functions.tables import cut
from reachbase.operators import access, acl, graph
from reachbase.plans.estate import DOMAIN_USERS, Estate, project, table
from reachbase.plans.oracle import category, expand, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
ROOT = "S-1-5-21-1-1-3-1003"

#: All pairs (member, group, least depth), for DuckDB.
REACH = """, walk(member_key, group_key, depth) AS (SELECT DISTINCT member_key, group_key, 1 FROM edges UNION SELECT w.member_key, e.group_key, w.depth + 1 FROM walk w JOIN edges e ON e.member_key = w.group_key WHERE w.depth < 12),
reach AS (SELECT member_key, group_key, min(depth) AS depth FROM walk GROUP BY 1, 2)"""
TOKENS = REACH + """, subjects AS (SELECT principal_key FROM principals WHERE kind IN ('user', 'managed_service_account')),
tokens AS (SELECT principal_key, principal_key AS sid, 'subject' AS origin, 0 AS depth FROM subjects
  UNION ALL SELECT member_key, group_key, 'membership', depth FROM reach JOIN subjects ON member_key = principal_key
  UNION ALL SELECT principal_key, sid, 'assumed', 0 FROM subjects, (VALUES ('S-1-1-0'), ('S-1-5-11')) v(sid))"""
FOLD = "list_reduce(list({{'a': ace_type = 'allow', 'm': {m}, 'g': 0::bigint, 'd': 0::bigint}} ORDER BY order_index, ace_key), lambda s, e: {{'a': e.a, 'm': e.m, 'g': CASE WHEN e.a THEN s.g | (e.m & (4294967295 - s.d)) ELSE s.g END, 'd': CASE WHEN e.a THEN s.d ELSE s.d | (e.m & (4294967295 - s.g)) END}}, {{'a': true, 'm': 0::bigint, 'g': 0::bigint, 'd': 0::bigint}})".format(m=expand("access_mask"))
CLASSES = TOKENS + """, named AS (SELECT DISTINCT trustee_key FROM ntfs_aces UNION SELECT trustee_key FROM share_aces),
sets AS (SELECT principal_key, list(DISTINCT sid ORDER BY sid) AS sids FROM tokens JOIN named ON sid = trustee_key GROUP BY 1),
members AS (SELECT DISTINCT sha256(array_to_string(sids, ',')) AS class_key, unnest(sids) AS sid FROM sets),
folded AS (SELECT class_key, resource_key, """ + FOLD + """ AS f, bit_or(CASE WHEN ace_type = 'allow' THEN """ + expand("access_mask") + """ ELSE 0 END) & (4294967295 - bit_or(CASE WHEN ace_type = 'deny' THEN """ + expand("access_mask") + """ ELSE 0 END)) AS canonical
  FROM ntfs_aces JOIN members ON trustee_key = sid WHERE ace_flags & 8 = 0 GROUP BY 1, 2)"""


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def on_estate(body: str | None = None):
    """Registers a function (estate) with its SQL after the estate's tables."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(project(spark, sf_dir))

        QUERIES[f.__name__] = run
        if body is not None:
            ORACLE[f.__name__] = sql(body)
        return f

    return add


@on_estate("SELECT 'principals' AS object, count(*) AS n FROM principals UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'servers', count(*) FROM servers UNION ALL SELECT 'shares', count(*) FROM shares UNION ALL SELECT 'share_aces', count(*) FROM share_aces UNION ALL SELECT 'resources', count(*) FROM resources UNION ALL SELECT 'ntfs_aces', count(*) FROM ntfs_aces")
def object_counts(e: Estate) -> DataFrame:
    out = None
    for name in ("principals", "edges", "servers", "shares", "share_aces", "resources", "ntfs_aces"):
        rows = getattr(e, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("object"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@on_estate("SELECT ace_key, resource_key, order_index, access_mask, ace_flags FROM ntfs_aces")
def ntfs_ace_keys(e: Estate) -> DataFrame:
    return e.ntfs_aces.select("ace_key", "resource_key", "order_index", "access_mask", "ace_flags")


@on_estate("SELECT group_key || '->' || member_key || '|' || edge_kind AS edge_key FROM edges")
def edge_keys(e: Estate) -> DataFrame:
    return e.edges.select(keys.edge_key(F.col("group_key"), F.col("member_key"), F.col("edge_kind")).alias("edge_key"))


@on_estate("SELECT DISTINCT trustee_key, resource_key AS container FROM ntfs_aces UNION SELECT DISTINCT trustee_key, share_key FROM share_aces")
def trustee_references(e: Estate) -> DataFrame:
    return e.ntfs_aces.select("trustee_key", F.col("resource_key").alias("container")).union(e.share_aces.select("trustee_key", "share_key")).distinct()


@on_estate(f"SELECT access_mask, {expand('access_mask')} AS mask, access_mask & 4026531840 <> 0 AS was_generic, {category(expand('access_mask'))} AS label, count(*) AS entries FROM ntfs_aces GROUP BY 1, 2, 3, 4")
def mask_labels(e: Estate) -> DataFrame:
    n = masks.normalised(F.col("access_mask"))
    return e.ntfs_aces.select("access_mask", n["mask"].alias("mask"), n["was_generic"].alias("was_generic")).withColumn("label", masks.category(F.col("mask"))).groupBy("access_mask", "mask", "was_generic", "label").agg(F.count("*").alias("entries"))


@on_estate("SELECT permission, m AS mask, count(*) AS entries FROM share_aces JOIN (VALUES ('read', 1179817::bigint), ('change', 1245631), ('full', 2032127)) v(p, m) ON permission = p GROUP BY 1, 2")
def share_levels(e: Estate) -> DataFrame:
    return e.share_aces.withColumn("mask", masks.share_mask(F.col("permission"))).groupBy("permission", "mask").agg(F.count("*").alias("entries"))


@on_estate("SELECT trustee_key, sum((ace_flags & 8 = 0)::int)::bigint AS here, count(*) AS entries FROM ntfs_aces GROUP BY 1")
def entries_that_apply(e: Estate) -> DataFrame:
    return e.ntfs_aces.groupBy("trustee_key").agg(F.count_if(F.col("ace_flags").bitwiseAND(8) == 0).alias("here"), F.count("*").alias("entries"))


@on_estate(REACH + " SELECT member_key, group_key, depth FROM reach")
def membership_closure(e: Estate) -> DataFrame:
    return graph.closure(e.edges)


@on_estate(REACH + f" SELECT member_key, depth FROM reach WHERE group_key = '{DOMAIN_USERS}'")
def effective_members(e: Estate) -> DataFrame:
    return graph.closure(e.edges).where(F.col("group_key") == DOMAIN_USERS).select("member_key", "depth")


@on_estate(f"SELECT member_key FROM edges WHERE group_key = '{ROOT}'")
def direct_members(e: Estate) -> DataFrame:
    one = e.edges.select(F.lit(ROOT).alias("key")).distinct()
    return graph.neighbours(e.edges, one, down=True).select(F.col("neighbour").alias("member_key"))


@on_estate("SELECT principal_key, coalesce(m, 0) AS direct_members, coalesce(g, 0) AS direct_groups FROM principals LEFT JOIN (SELECT group_key, count(DISTINCT member_key) AS m FROM edges GROUP BY 1) ON group_key = principal_key LEFT JOIN (SELECT member_key, count(DISTINCT group_key) AS g FROM edges GROUP BY 1) ON member_key = principal_key")
def membership_degrees(e: Estate) -> DataFrame:
    return graph.degrees(e.principals, e.edges)


@on_estate(REACH + """, mu AS (SELECT a.member_key AS k, a.group_key AS g FROM reach a JOIN reach b ON a.member_key = b.group_key AND a.group_key = b.member_key WHERE a.member_key <> a.group_key), cy AS (SELECT DISTINCT least(k, min(g)) AS cycle_id, (count(DISTINCT g) + 1)::int AS size FROM mu GROUP BY k),
lw(start, node, path) AS (SELECT cycle_id, cycle_id, [cycle_id] FROM cy UNION ALL SELECT start, e.group_key, list_append(path, e.group_key) FROM lw JOIN edges e ON e.member_key = node JOIN mu ON mu.k = e.member_key AND mu.g = e.group_key WHERE (len(path) = 1 OR node <> start) AND (e.group_key = start OR NOT list_contains(path, e.group_key)))
SELECT cycle_id, size, (SELECT array_to_string(first(path ORDER BY len(path), path), '>') FROM lw WHERE start = cycle_id AND node = cycle_id AND len(path) > 1) AS loop FROM cy""")
def membership_cycles(e: Estate) -> DataFrame:
    return graph.cycles(e.edges).select("cycle_id", "size", F.array_join("loop", ">").alias("loop"))


@on_estate(f""", p(start, node, path) AS (SELECT member_key, group_key, [member_key, group_key] FROM edges WHERE member_key LIKE 'S-1-5-21-1-1-2-%'
  UNION ALL SELECT start, group_key, list_append(path, group_key) FROM p JOIN edges ON member_key = node WHERE node <> '{DOMAIN_USERS}' AND NOT list_contains(path, group_key) AND len(path) < 9)
SELECT start, array_to_string(path, '>') AS path, len(path)::int - 1 AS length FROM p WHERE node = '{DOMAIN_USERS}'""")
def membership_paths(e: Estate) -> DataFrame:
    start = e.principals.where("kind = 'managed_service_account'").select(F.col("principal_key").alias("key"))
    paths = graph.simple_paths(e.edges, start, e.principals.where(F.col("principal_key") == DOMAIN_USERS).select(F.col("principal_key").alias("key")))
    return paths.select("start", F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("length"))


@on_estate(""", e2 AS (SELECT group_key, member_key FROM edges UNION ALL SELECT principal_key, principal_key FROM principals WHERE kind = 'user' AND name LIKE '%50' UNION ALL SELECT 'S-1-5-21-1-1-9-' || (length(name) % 3), principal_key FROM principals WHERE kind = 'managed_service_account' UNION ALL SELECT 'S-1-5-21-1-1-3-1002', 'S-1-5-21-1-1-9-77'),
i AS (SELECT 'dangling_group' AS issue, group_key AS k FROM e2 WHERE group_key NOT IN (SELECT principal_key FROM principals) UNION SELECT 'dangling_member', member_key FROM e2 WHERE member_key NOT IN (SELECT principal_key FROM principals)
  UNION SELECT 'not_a_group', group_key FROM e2 JOIN principals ON principal_key = group_key WHERE kind NOT IN ('group', 'well_known') UNION SELECT 'self_membership', group_key FROM e2 WHERE group_key = member_key)
SELECT issue, count(*) AS n FROM i GROUP BY 1""")
def graph_lint(e: Estate) -> DataFrame:
    """With faults of each kind planted among the memberships."""
    p = F.col("principal_key")
    loops = e.principals.where("kind = 'user' AND name LIKE '%50'").select(p.alias("group_key"), p.alias("member_key"))
    nobody = e.principals.where("kind = 'managed_service_account'").select(F.concat(F.lit("S-1-5-21-1-1-9-"), (F.length("name") % 3).cast("string")).alias("group_key"), p.alias("member_key"))
    lost = e.edges.limit(1).select(F.lit("S-1-5-21-1-1-3-1002").alias("group_key"), F.lit("S-1-5-21-1-1-9-77").alias("member_key"))
    edges = e.edges.select("group_key", "member_key").unionByName(loops).unionByName(nobody).unionByName(lost)
    return graph.lint(e.principals, edges).groupBy("issue").agg(F.count("*").alias("n"))


@on_estate(f""", cut AS (SELECT group_key AS rg, member_key AS rm FROM edges WHERE group_key = '{DOMAIN_USERS}'),
w(rg, rm, group_key) AS (SELECT rg, rm, e.group_key FROM cut JOIN edges e ON e.member_key = '{ROOT}' WHERE NOT (e.group_key = rg AND e.member_key = rm)
  UNION SELECT w.rg, w.rm, e.group_key FROM w JOIN edges e ON e.member_key = w.group_key WHERE NOT (e.group_key = rg AND e.member_key = rm))
SELECT rg AS removed_group, rm AS removed_member, group_key FROM w""")
def reach_without_edge(e: Estate) -> DataFrame:
    return graph.without_edge(e.edges, e.edges.where(F.col("group_key") == DOMAIN_USERS), ROOT)


@on_estate(TOKENS + " SELECT principal_key, sid, origin, depth FROM tokens")
def subject_tokens(e: Estate) -> DataFrame:
    return access.tokens(e)


@on_estate(CLASSES + f" SELECT class_key, resource_key, f.g AS granted, f.d AS denied, f.g <> canonical AS order_dependent, {category('f.g')} AS label FROM folded")
def effective_ntfs_rights(e: Estate) -> DataFrame:
    e = e.with_(ntfs_aces=cut(e.ntfs_aces))
    _, members = access.estate_classes(e, e.ntfs_aces.select("trustee_key").union(e.share_aces.select("trustee_key")))
    rows = access.ntfs_rights(members, e.ntfs_aces)
    return rows.select("class_key", "resource_key", "granted", "denied", "order_dependent", "label")


_MATRIX = CLASSES + """, every AS (SELECT DISTINCT class_key FROM members),
lists AS (SELECT class_key, resource_key, f.g AS g, f.d AS d FROM folded UNION ALL SELECT class_key, resource_key, 2032127, 0 FROM resources, every WHERE NOT dacl_present),
sh AS (SELECT class_key, share_key, bit_or(CASE permission WHEN 'read' THEN 1179817::bigint WHEN 'change' THEN 1245631 ELSE 2032127 END) AS s FROM share_aces JOIN members ON trustee_key = sid GROUP BY 1, 2),
nobody AS (SELECT DISTINCT a.resource_key FROM ntfs_aces a WHERE a.trustee_key LIKE 'S-1-5-21-%' AND a.trustee_key NOT IN (SELECT principal_key FROM principals) AND a.trustee_key NOT IN (SELECT group_key FROM edges)),
crossed AS (SELECT l.class_key, l.resource_key, r.share_key, g, d, h.resource_key IS NOT NULL AS hidden, o.share_key IS NOT NULL AS seen, CASE WHEN o.share_key IS NULL THEN 2032127::bigint ELSE coalesce(s, 0)::bigint END AS s
  FROM lists l JOIN resources r USING (resource_key) LEFT JOIN nobody h ON h.resource_key = l.resource_key LEFT JOIN (SELECT DISTINCT share_key FROM share_aces) o ON o.share_key = r.share_key LEFT JOIN sh ON sh.share_key = r.share_key AND sh.class_key = l.class_key)"""


@on_estate(_MATRIX + f""" SELECT class_key, resource_key, g AS ntfs_rights, s AS share_rights, g & s AS rights, {category('(g & s)')} AS label,
  CASE WHEN NOT seen THEN 'unknown' WHEN g & (4294967295 - s) <> 0 AND s & (4294967295 - g) <> 0 THEN 'both' WHEN g & (4294967295 - s) <> 0 THEN 'smb_share' WHEN s & (4294967295 - g) <> 0 THEN 'ntfs' ELSE 'none' END AS limited_by,
  CASE WHEN hidden THEN CASE WHEN seen THEN 'at_least' ELSE 'uncertain' END WHEN seen THEN 'certain' ELSE 'at_most' END AS certainty, CASE WHEN g & s <> 0 THEN 'granted' WHEN hidden THEN 'indeterminate' WHEN d <> 0 THEN 'denied' ELSE 'no_grant' END AS verdict FROM crossed""")
def access_matrix(e: Estate) -> DataFrame:
    return access.matrix(e)[0].select("class_key", "resource_key", "ntfs_rights", "share_rights", "rights", "label", "limited_by", "certainty", "verdict")


@on_estate(_MATRIX + """, who AS (SELECT principal_key, sha256(array_to_string(sids, ',')) AS class_key FROM sets WHERE principal_key = 'S-1-5-21-1-1-1-100007')
SELECT resource_key, g & s AS rights FROM crossed JOIN who USING (class_key) WHERE g & s <> 0""")
def resources_of_principal(e: Estate) -> DataFrame:
    reach, _ = access.matrix(e, e.principals.where("principal_key = 'S-1-5-21-1-1-1-100007'").select("principal_key"))
    return reach.where("rights <> 0").select("resource_key", "rights")


@on_estate(_MATRIX + """, who AS (SELECT sha256(array_to_string(sids, ',')) AS class_key, count(*) AS n FROM sets GROUP BY 1)
SELECT resource_key, sum(n)::bigint AS principals, sum(CASE WHEN (g & s) & 197055 = 197055 THEN n ELSE 0 END)::bigint AS can_modify FROM crossed JOIN who USING (class_key) WHERE g & s <> 0 GROUP BY 1""")
def reach_of_resources(e: Estate) -> DataFrame:
    return access.reach_counts(e, masks.CATEGORIES["modify"]).withColumnRenamed("holding", "can_modify")


_WHO = TOKENS + f""", one AS (SELECT resource_key, share_key, dacl_present, owner_key FROM resources WHERE resource_key IN (SELECT min(resource_key) FROM ntfs_aces WHERE trustee_key = 'S-1-1-0' UNION SELECT min(resource_key) FROM resources WHERE NOT dacl_present UNION SELECT min(resource_key) FROM resources WHERE depth = 0)),
wf AS (SELECT t.principal_key, a.resource_key, {FOLD} AS f FROM one JOIN ntfs_aces a USING (resource_key) JOIN tokens t ON t.sid = a.trustee_key WHERE ace_flags & 8 = 0 GROUP BY 1, 2),
wn AS (SELECT s.principal_key, o.resource_key, o.share_key, ((CASE WHEN NOT dacl_present THEN 2032127 ELSE coalesce(wf.f.g, 0) END) | (CASE WHEN o.owner_key = s.principal_key THEN 393216 ELSE 0 END))::bigint AS n FROM one o, subjects s LEFT JOIN wf ON wf.principal_key = s.principal_key AND wf.resource_key = o.resource_key),
ws AS (SELECT t.principal_key, a.share_key, bit_or(CASE permission WHEN 'read' THEN 1179817::bigint WHEN 'change' THEN 1245631 ELSE 2032127 END) AS s FROM share_aces a JOIN one USING (share_key) JOIN tokens t ON t.sid = a.trustee_key GROUP BY 1, 2)
SELECT wn.principal_key, wn.resource_key, n AS ntfs_rights, (CASE WHEN o.share_key IS NULL THEN 2032127 ELSE coalesce(s, 0) END & n)::bigint AS remote FROM wn LEFT JOIN ws ON ws.principal_key = wn.principal_key AND ws.share_key = wn.share_key LEFT JOIN (SELECT DISTINCT share_key FROM share_aces) o ON o.share_key = wn.share_key WHERE n <> 0"""


@on_estate(_WHO)
def principals_of_resource(e: Estate) -> DataFrame:
    """On a list that names everyone, one that is missing, and a share's root."""
    e = e.settled()
    least = lambda rows: rows.agg(F.min("resource_key").alias("resource_key"))
    some = least(e.ntfs_aces.where(F.col("trustee_key") == keys.EVERYONE)).union(least(e.resources.where("NOT dacl_present"))).union(least(e.resources.where("depth = 0")))
    return access.principals_on(e, some).select("principal_key", "resource_key", "ntfs_rights", "remote")


@on_estate("SELECT trustee_key, count(*) AS entries FROM ntfs_aces WHERE trustee_key LIKE 'S-1-5-21-%' AND trustee_key NOT IN (SELECT principal_key FROM principals) AND trustee_key NOT IN (SELECT group_key FROM edges) GROUP BY 1")
def unobserved_trustees(e: Estate) -> DataFrame:
    return access.unobserved_trustees(e)


_LIST_EACH = ", s AS (SELECT resource_key, ace_key, ace_type, " + expand("access_mask") + " AS m, order_index FROM ntfs_aces WHERE ace_flags & 8 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY resource_key ORDER BY order_index, ace_key) AS k FROM s), w(resource_key, k, g, d, ace_key, contributed) AS (SELECT resource_key, 0::bigint, 0::bigint, 0::bigint, '', 0::bigint FROM (SELECT DISTINCT resource_key FROM n) UNION ALL SELECT w.resource_key, n.k, CASE WHEN ace_type = 'allow' THEN g | (m & (4294967295 - d)) ELSE g END, CASE WHEN ace_type = 'deny' THEN d | (m & (4294967295 - g)) ELSE d END, n.ace_key, CASE WHEN ace_type = 'allow' THEN m & (4294967295 - d) ELSE m & (4294967295 - g) END FROM w JOIN n ON n.resource_key = w.resource_key AND n.k = w.k + 1)"


@on_estate(_LIST_EACH + " SELECT ace_key, contributed, CASE WHEN contributed <> 0 THEN 'applied' ELSE 'superseded' END AS effect FROM w WHERE k > 0")
def entry_contributions(e: Estate) -> DataFrame:
    return acl.contributions(e.ntfs_aces, ["resource_key"]).select("ace_key", "contributed", "effect")


@on_estate(""", c AS (SELECT resource_key, count(*) AS n, bool_or(access_mask & 4026531840 <> 0) AS gen FROM ntfs_aces GROUP BY 1), r AS (SELECT resources.*, coalesce(n, 0) AS n, coalesce(gen, false) AS gen FROM resources LEFT JOIN c USING (resource_key))
SELECT resource_key, 'null_dacl' AS finding FROM r WHERE NOT dacl_present UNION ALL SELECT resource_key, 'empty_dacl' FROM r WHERE dacl_present AND n = 0 UNION ALL SELECT resource_key, 'protected_dacl' FROM r WHERE dacl_protected UNION ALL SELECT resource_key, 'generic_rights_expanded' FROM r WHERE gen""")
def list_findings(e: Estate) -> DataFrame:
    return acl.findings(e.resources, e.ntfs_aces)


@on_estate(""", p AS (SELECT *, coalesce(bool_or(ace_flags & 16 <> 0) OVER w, false) AS i, coalesce(bool_or(ace_flags & 16 = 0 AND ace_type = 'allow') OVER w, false) AS a FROM ntfs_aces WINDOW w AS (PARTITION BY resource_key ORDER BY order_index, ace_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT resource_key, ace_key, 'explicit_after_inherited' AS violation FROM p WHERE ace_flags & 16 = 0 AND i UNION ALL SELECT resource_key, ace_key, 'deny_after_allow' FROM p WHERE ace_flags & 16 = 0 AND ace_type = 'deny' AND a""")
def order_violations(e: Estate) -> DataFrame:
    return acl.order_violations(e.ntfs_aces)


_PROJECTED = """, j AS (SELECT *, access_mask & 4026531840 <> 0 AS gen, ace_flags & 3 AS reach FROM ntfs_aces),
q AS (
  SELECT resource_key, trustee_key, ace_type, access_mask, 16 | CASE WHEN ace_flags & 2 <> 0 THEN CASE WHEN ace_flags & 4 <> 0 THEN 0 ELSE reach END ELSE 9 END AS ace_flags, order_index, ace_key, 0 AS seat FROM j WHERE NOT gen AND (ace_flags & 2 <> 0 OR (ace_flags & 1 <> 0 AND ace_flags & 4 = 0))
  UNION ALL SELECT resource_key, trustee_key, ace_type, """ + expand("access_mask") + """, 16, order_index, ace_key, 0 FROM j WHERE gen AND ace_flags & 2 <> 0
  UNION ALL SELECT resource_key, trustee_key, ace_type, access_mask, 24 | reach, order_index, ace_key, 1 FROM j WHERE gen AND reach <> 0 AND ace_flags & 4 = 0),
projected AS (SELECT resource_key, trustee_key, ace_type, access_mask, ace_flags, (row_number() OVER (PARTITION BY resource_key ORDER BY order_index, ace_key, seat) - 1)::int AS order_index FROM q)"""


@on_estate(_PROJECTED + " SELECT * FROM projected")
def inherited_entries(e: Estate) -> DataFrame:
    return acl.projected(e.ntfs_aces)


@on_estate("SELECT resource_key, trustee_key, ace_type, " + expand("access_mask") + " AS access_mask, 16 AS ace_flags, (row_number() OVER (PARTITION BY resource_key ORDER BY order_index, ace_key) - 1)::int AS order_index FROM ntfs_aces WHERE ace_flags & 1 <> 0")
def inherited_by_files(e: Estate) -> DataFrame:
    return acl.projected(e.ntfs_aces, container=False)


_DIGEST = """, l AS (SELECT resource_key, trustee_key || '|' || ace_type || '|0x' || lpad(lower(to_hex(access_mask)), 8, '0') || '|0x' || lpad(lower(to_hex(ace_flags)), 2, '0') AS line, order_index FROM {aces}),
lk AS (SELECT resource_key, 'ace=' || (row_number() OVER (PARTITION BY resource_key ORDER BY order_index, line) - 1) || '|' || line AS line, order_index FROM l),
dg AS MATERIALIZED (SELECT r.resource_key, sha256('acl-normal/1' || chr(10) || 'dacl_present=' || {present} || chr(10) || 'dacl_protected=' || {protected} || chr(10) || 'order=observed' || chr(10) || coalesce(string_agg(line || chr(10), '' ORDER BY order_index, line), '')) AS acl_hash, count(line)::int AS entries
  FROM resources r LEFT JOIN lk USING (resource_key) GROUP BY r.resource_key, dacl_present, dacl_protected)"""


@on_estate(_DIGEST.format(aces="ntfs_aces", present="dacl_present::varchar", protected="dacl_protected::varchar") + " SELECT * FROM dg")
def list_digests(e: Estate) -> DataFrame:
    return acl.digests(e.resources, e.ntfs_aces)


@on_estate(_DIGEST.format(aces="ntfs_aces", present="dacl_present::varchar", protected="dacl_protected::varchar") + " SELECT acl_hash, count(*) AS resources, min(resource_key) AS example FROM dg GROUP BY 1 HAVING count(*) > 1")
def shared_lists(e: Estate) -> DataFrame:
    return acl.digests(e.resources, e.ntfs_aces).groupBy("acl_hash").agg(F.count("*").alias("resources"), F.min("resource_key").alias("example")).where("resources > 1")


@on_estate(_PROJECTED + _DIGEST.format(aces="ntfs_aces", present="dacl_present::varchar", protected="dacl_protected::varchar") + _DIGEST.replace(", l AS", ", l2 AS").replace("FROM l)", "FROM l2)").replace("lk AS", "lk2 AS").replace("JOIN lk ", "JOIN lk2 ").replace("dg AS", "dg2 AS").format(aces="projected", present="'true'", protected="'false'") + """
SELECT r.resource_key, CASE WHEN r.dacl_protected THEN 'protected_dacl' WHEN NOT r.dacl_present THEN 'null_dacl' WHEN r.parent_key IS NULL THEN 'share_root' WHEN p.resource_key IS NULL THEN 'parent_unreadable' WHEN NOT p.dacl_present THEN 'parent_null_dacl' WHEN dg.acl_hash <> dg2.acl_hash THEN 'acl_differs_from_parent' END AS boundary_reason
FROM resources r JOIN dg USING (resource_key) LEFT JOIN resources p ON p.resource_key = r.parent_key LEFT JOIN dg2 ON dg2.resource_key = r.parent_key""")
def list_boundaries(e: Estate) -> DataFrame:
    return acl.boundaries(e.resources, e.ntfs_aces)


@on_estate(""", read AS (SELECT DISTINCT resource_key FROM resources WHERE depth < 2) SELECT r.resource_key, r.parent_key AS source_key, 1 AS distance FROM resources r WHERE depth = 2""")
def derived_lists(e: Estate) -> DataFrame:
    return access.derived_lists(e.resources, e.ntfs_aces.join(e.resources.where("depth < 2"), "resource_key", "left_semi"))


@on_estate("SELECT share_key, trustee_key, count(*) AS entries, string_agg(permission, ',' ORDER BY permission) AS permissions FROM share_aces WHERE trustee_key LIKE 'S-1-5-21-1-1-3-%' GROUP BY 1, 2")
def shares_naming_trustee(e: Estate) -> DataFrame:
    rows = e.share_aces.where(F.col("trustee_key").startswith("S-1-5-21-1-1-3-"))
    return rows.groupBy("share_key", "trustee_key").agg(F.count("*").alias("entries"), F.array_join(F.array_sort(F.collect_list("permission")), ",").alias("permissions"))


@on_estate("SELECT server_key, count(DISTINCT share_key) AS shares, count(*) AS resources, sum((dacl_protected)::int)::bigint AS protected FROM resources GROUP BY 1")
def server_listing(e: Estate) -> DataFrame:
    return e.resources.groupBy("server_key").agg(F.count_distinct("share_key").alias("shares"), F.count("*").alias("resources"), F.count_if("dacl_protected").alias("protected"))


@on_estate("SELECT resource_key, depth FROM resources WHERE resource_key = '\\\\brand2\\economy' OR starts_with(resource_key, '\\\\brand2\\economy\\')".replace("\\\\\\\\", "\\\\"))
def subtree(e: Estate) -> DataFrame:
    return e.resources.where(keys.under(F.col("resource_key"), "\\\\brand2\\economy")).select("resource_key", "depth")


@on_estate("SELECT trustee_key, regexp_extract(trustee_key, '^S-1-5-21-(?:\\d+-)+(\\d+)$', 1) AS rid, trustee_key IN ('S-1-1-0', 'S-1-5-11') OR regexp_extract(trustee_key, '^S-1-5-21-(?:\\d+-)+(\\d+)$', 1) IN ('513', '514', '515') AS broad, NOT starts_with(trustee_key, 'S-1-5-21-') AS well_known FROM (SELECT DISTINCT trustee_key FROM ntfs_aces)")
def trustee_kinds(e: Estate) -> DataFrame:
    k = F.col("trustee_key")
    return e.ntfs_aces.select("trustee_key").distinct().select("trustee_key", keys.rid(k).alias("rid"), keys.is_broad(k).alias("broad"), keys.is_well_known(k).alias("well_known"))


@on_estate("SELECT kind, count(*) AS n, sum((enabled IS NULL)::int)::bigint AS unknown, count(*) FILTER (WHERE enabled = false) AS disabled FROM principals GROUP BY 1")
def principal_states(e: Estate) -> DataFrame:
    return e.principals.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("enabled").isNull()).alias("unknown"), F.count_if(F.col("enabled").eqNullSafe(F.lit(False))).alias("disabled"))


@on_estate("SELECT principal_key, name FROM principals WHERE starts_with(lower(name), 'customer#00000001') ORDER BY name, principal_key LIMIT 11")
def search_by_name(e: Estate) -> DataFrame:
    return e.principals.where(F.lower("name").startswith("customer#00000001")).select("principal_key", "name").orderBy("name", "principal_key").limit(11)


@on_estate("SELECT resource_key FROM resources WHERE resource_key > '\\\\brand1\\' ORDER BY resource_key LIMIT 51".replace("\\\\\\\\", "\\\\"))
def resource_page(e: Estate) -> DataFrame:
    return e.resources.where(F.col("resource_key") > "\\\\brand1\\").select("resource_key").orderBy("resource_key").limit(51)
