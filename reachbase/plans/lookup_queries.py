"""Queries on search, resolution, and what groups and principals reach, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.functions.tables import cut
from reachbase.operators import access, lookup
from reachbase.plans.access_queries import REACH
from reachbase.plans.estate import Estate, project
from reachbase.plans.oracle import sql
from reachbase.plans.report_queries import _pairs_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def on_estate(body: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(project(spark, sf_dir))
        ORACLE[f.__name__] = sql(body)
        return f

    return add


# A search for each server, each share and each kind of name, and two that find nothing.

_SEARCHES = r""", asked AS (SELECT 'server ' || server_key AS search_no, 'server' AS shape, server_key AS term, NULL AS server FROM servers
  UNION ALL SELECT 'path ' || share_key, 'path', name, server_key FROM shares UNION ALL SELECT 'name ' || server_key, 'name', substr(server_key, 1, 6), NULL FROM servers
  UNION ALL SELECT 'group ' || principal_key, 'name', lower(name), NULL FROM principals WHERE kind = 'group' UNION ALL SELECT 'people ' || n, 'name', 'customer#0000000' || n, NULL FROM range(10) r(n)
  UNION ALL SELECT 'share ' || left(name, 3), 'name', left(name, 3), NULL FROM (SELECT DISTINCT left(name, 3) AS name FROM shares) UNION ALL SELECT 'sid ' || principal_key, 'sid', principal_key, NULL FROM principals WHERE kind = 'managed_service_account'
  UNION ALL SELECT 'none', 'name', '100%_', NULL),
folder AS (SELECT *, '\\' || server || '\' || term AS p FROM asked WHERE shape = 'path'),
found AS (SELECT search_no, 'identities' AS category, principal_key AS key, name AS label FROM asked JOIN principals ON (shape = 'name' AND starts_with(lower(name), term)) OR (shape = 'sid' AND principal_key = term)
  UNION ALL SELECT search_no, 'servers', server_key, server_key FROM asked JOIN servers ON shape IN ('name', 'server') AND starts_with(server_key, term)
  UNION ALL SELECT search_no, 'shares', share_key, share_key FROM asked JOIN shares ON (shape = 'name' AND starts_with(lower(name), term)) OR (shape = 'server' AND server_key = term) OR (shape = 'path' AND server_key = server AND starts_with(lower(name), term))
  UNION ALL SELECT search_no, 'directories', resource_key, resource_key FROM asked JOIN resources ON shape = 'server' AND server_key = term
  UNION ALL SELECT search_no, 'directories', resource_key, resource_key FROM folder JOIN resources ON starts_with(resource_key, p)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY search_no, category ORDER BY label NULLS LAST, key) AS seat, count(*) OVER (PARTITION BY search_no, category) AS n FROM found)"""


@on_estate(_SEARCHES + " SELECT search_no, category, seat::int AS seat, key, label, n > 10 AS truncated FROM ranked WHERE seat <= 10")
def global_search(e: Estate) -> DataFrame:
    one = lambda rows, prefix, no, text: rows.select(F.concat(F.lit(prefix), no).alias("search_no"), text.alias("text"))
    spark = e.servers.sparkSession
    slash = F.lit("\\")
    out = one(e.servers, "server ", F.col("server_key"), F.concat(slash, slash, F.upper("server_key"))).unionByName(one(e.shares, "path ", F.col("share_key"), F.concat(F.lit("//"), F.replace("share_key", F.lit("|"), F.lit("/")), F.lit("/"))))
    out = out.unionByName(one(e.servers, "name ", F.col("server_key"), F.substring("server_key", 1, 6))).unionByName(one(e.principals.where("kind = 'group'"), "group ", F.col("principal_key"), F.concat(F.lit("  "), "name")))
    out = out.unionByName(one(spark.range(10), "people ", F.col("id").cast("string"), F.concat(F.lit("CUSTOMER#0000000"), F.col("id").cast("string"))))
    out = out.unionByName(one(e.shares.select(F.substring("name", 1, 3).alias("n")).distinct(), "share ", F.col("n"), F.col("n"))).unionByName(one(e.principals.where("kind = 'managed_service_account'"), "sid ", F.col("principal_key"), F.lower("principal_key")))
    return lookup.search(e, out.unionByName(spark.createDataFrame([("none", "100%_"), ("blank", "  ")], "search_no string, text string")))


_LOCAL = "people AS (SELECT principal_key FROM principals UNION ALL SELECT server_key || '|S-1-5-32-544' FROM servers UNION ALL SELECT server_key || '|S-1-5-32-545' FROM servers WHERE server_key = (SELECT min(server_key) FROM servers))"


@on_estate(", " + _LOCAL + """, q AS (SELECT principal_key AS identifier, NULL AS host, principal_key AS k FROM principals UNION ALL SELECT 'S-1-5-32-544', upper(server_key), server_key || '|S-1-5-32-544' FROM servers
  UNION ALL SELECT 'S-1-1-0', server_key, 'S-1-1-0' FROM servers UNION ALL SELECT 's-1-5-32-545', NULL, (SELECT min(server_key) FROM servers) || '|S-1-5-32-545')
SELECT identifier, host, k AS principal_key, 'exact' AS outcome, 0 AS candidates FROM q UNION ALL SELECT 'S-1-5-32-544', NULL, NULL, CASE WHEN count(*) > 1 THEN 'ambiguous' END, count(*)::int FROM servers UNION ALL SELECT 'nobody', NULL, NULL, 'unknown', 0 UNION ALL SELECT 'S-1-5-32-546', 'nowhere', NULL, 'unknown', 0""")
def principal_resolution(e: Estate) -> DataFrame:
    """Every principal by its key, each server's own administrators with and without the server, one group that a single server has, and two that nobody is."""
    groups = e.servers.select(F.concat("server_key", F.lit("|S-1-5-32-544")).alias("principal_key")).unionByName(e.servers.agg(F.concat(F.min("server_key"), F.lit("|S-1-5-32-545")).alias("principal_key")))
    people = e.principals.select("principal_key").unionByName(groups)
    ask = lambda rows, sid, host: rows.select(sid.alias("identifier"), host.cast("string").alias("host"))
    asked = ask(e.principals, F.col("principal_key"), F.lit(None)).unionByName(ask(e.servers, F.lit("S-1-5-32-544"), F.upper("server_key"))).unionByName(ask(e.servers, F.lit("S-1-1-0"), F.col("server_key")))
    few = e.servers.sparkSession.createDataFrame([("S-1-5-32-544", None), ("s-1-5-32-545", None), ("nobody", None), ("S-1-5-32-546", "nowhere")], "identifier string, host string")
    return lookup.resolved(asked.unionByName(few), people).withColumn("candidates", F.size("candidates"))


@on_estate("SELECT principal_key, kind, name FROM principals WHERE kind IN ('user', 'group') AND starts_with(lower(name), 'a') UNION ALL SELECT principal_key, kind, name FROM principals WHERE kind = 'managed_service_account'")
def principal_listings(e: Estate) -> DataFrame:
    """Users and groups by the start of a name, its domain aside, and services by the start of an identifier."""
    a = lookup.listing(e.principals, ("user", "group"), "CORP\\A").select("principal_key", "kind", "name")
    return a.unionByName(lookup.listing(e.principals, ("managed_service_account",), " s-1-5-21-1-1-2-").select("principal_key", "kind", "name"))


@on_estate("SELECT group_key, count(*) AS all_, count(*) FILTER (kind IN ('user', 'managed_service_account')) AS users, count(*) FILTER (kind IS NULL OR kind NOT IN ('group', 'local_group')) AS non_groups FROM (SELECT group_key, CASE WHEN length(member_key) % 2 = 0 THEN kind END AS kind FROM edges LEFT JOIN principals ON principal_key = member_key) GROUP BY 1")
def members_by_inclusion(e: Estate) -> DataFrame:
    """The kinds of members with keys of odd length are unknown."""
    about = e.principals.select(F.col("principal_key").alias("member_key"), "kind")
    kind = F.when(F.length("member_key") % 2 == 0, F.col("kind"))
    count = lambda name: F.count_if(lookup.included(kind, name))
    return e.edges.join(about, "member_key", "left").groupBy("group_key").agg(count("all").alias("all_"), count("users").alias("users"), count("non_groups").alias("non_groups"))


# What principals and groups reach

_HELD = REACH + """, subjects AS (SELECT principal_key FROM principals WHERE {who}),
held AS (SELECT principal_key, principal_key AS sid FROM subjects UNION SELECT member_key, group_key FROM reach JOIN subjects ON member_key = principal_key UNION SELECT principal_key, sid FROM subjects, (VALUES ('S-1-1-0'), ('S-1-5-11')) v(sid)), """


def _held_sql(who: str, asked: str) -> str:
    body = _pairs_sql("ntfs_aces")
    return _HELD.replace("{who}", who) + "asked AS (" + asked + ")" + body[body.index(",\npf AS") :].replace("tokens t", "held t")


@on_estate(_held_sql("kind IN ('user', 'managed_service_account')", "SELECT DISTINCT h.principal_key, r.resource_key, r.share_key, r.dacl_present, false AS owner FROM held h JOIN share_aces a ON a.trustee_key = h.sid JOIN resources r ON r.share_key = a.share_key AND r.depth = 0") + " SELECT principal_key, share_key, resource_key AS root_key, n AS ntfs_rights, s AS share_rights, n & s AS remote, CASE WHEN n & s <> 0 THEN 'granted' WHEN h THEN 'indeterminate' WHEN d <> 0 THEN 'denied' ELSE 'no_grant' END AS verdict FROM pr JOIN (SELECT resource_key, share_key FROM resources) USING (resource_key)")
def shares_of_principals(e: Estate) -> DataFrame:
    e = e.settled()
    return access.shares_reached(e, e.principals.where("kind IN ('user', 'managed_service_account')"))


@on_estate(_held_sql("kind = 'group'", "SELECT DISTINCT h.principal_key, r.resource_key, r.share_key, r.dacl_present, false AS owner FROM held h JOIN ntfs_aces a ON a.trustee_key = h.sid JOIN resources r ON r.resource_key = a.resource_key UNION SELECT principal_key, resource_key, share_key, dacl_present, false FROM subjects, resources WHERE NOT dacl_present") + """, nm AS (SELECT resource_key, trustee_key FROM ntfs_aces WHERE ace_flags & 8 = 0 UNION SELECT resource_key, trustee_key FROM resources JOIN share_aces USING (share_key))
SELECT principal_key AS group_key, pr.resource_key, n AS ntfs_rights, s AS share_rights, n & s AS remote, CASE WHEN n & s <> 0 THEN 'granted' WHEN h THEN 'indeterminate' WHEN d <> 0 THEN 'denied' ELSE 'no_grant' END AS verdict, nm.resource_key IS NOT NULL AS names_group FROM pr LEFT JOIN nm ON nm.resource_key = pr.resource_key AND nm.trustee_key = pr.principal_key""")
def group_impact(e: Estate) -> DataFrame:
    e = e.settled()
    return access.group_impact(e, e.principals.where("kind = 'group'").select(F.col("principal_key").alias("group_key")))


@on_estate(REACH + ", n AS (SELECT group_key, count(*) AS effective_members, count_if(kind IS NULL OR kind <> 'group')::bigint AS non_group_members, max(depth) AS depth FROM reach LEFT JOIN principals ON principal_key = member_key WHERE member_key <> group_key GROUP BY 1) SELECT principal_key AS group_key, coalesce(effective_members, 0)::bigint AS effective_members, coalesce(non_group_members, 0)::bigint AS non_group_members, coalesce(depth, 0)::int AS depth FROM principals LEFT JOIN n ON group_key = principal_key WHERE kind = 'group'")
def membership_impact(e: Estate) -> DataFrame:
    return access.membership_impact(e, e.principals.where("kind = 'group'").select(F.col("principal_key").alias("group_key")))
