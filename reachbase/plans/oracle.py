"""The estate projection once more, written for DuckDB; every estate oracle starts with it."""

from __future__ import annotations

ESTATE = r"""
WITH RECURSIVE seg AS (SELECT c_mktsegment AS segment, row_number() OVER (ORDER BY c_mktsegment) AS rank FROM (SELECT DISTINCT c_mktsegment FROM customer)),
principals AS (
  SELECT 'S-1-5-21-1-1-1-' || (c_custkey + 100000) AS principal_key, 'user' AS kind, c_name AS name, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal >= 0 END AS enabled FROM customer
  UNION ALL SELECT 'S-1-5-21-1-1-2-' || (s_suppkey + 1000), 'managed_service_account', s_name, true FROM supplier
  UNION ALL SELECT 'S-1-5-21-1-1-3-' || (n_nationkey + 1000), 'group', n_name, NULL FROM nation
  UNION ALL SELECT 'S-1-5-21-1-1-4-' || (r_regionkey + 1000), 'group', r_name, NULL FROM region
  UNION ALL SELECT 'S-1-5-21-1-1-5-' || (rank + 1000), 'group', segment, NULL FROM seg
  UNION ALL VALUES ('S-1-5-21-1-1-1-513', 'group', 'Domain Users', NULL), ('S-1-1-0', 'well_known', 'Everyone', NULL), ('S-1-5-11', 'well_known', 'Authenticated Users', NULL)),
edges AS (
  SELECT 'S-1-5-21-1-1-3-' || (c_nationkey + 1000) AS group_key, 'S-1-5-21-1-1-1-' || (c_custkey + 100000) AS member_key, 'ad_group' AS edge_kind FROM customer
  UNION ALL SELECT 'S-1-5-21-1-1-5-' || (rank + 1000), 'S-1-5-21-1-1-1-' || (c_custkey + 100000), 'ad_group' FROM customer JOIN seg ON c_mktsegment = segment
  UNION ALL SELECT 'S-1-5-21-1-1-3-' || (s_nationkey + 1000), 'S-1-5-21-1-1-2-' || (s_suppkey + 1000), 'ad_group' FROM supplier
  UNION ALL SELECT 'S-1-5-21-1-1-4-' || (n_regionkey + 1000), 'S-1-5-21-1-1-3-' || (n_nationkey + 1000), 'ad_group' FROM nation
  UNION ALL SELECT 'S-1-5-21-1-1-1-513', 'S-1-5-21-1-1-4-' || (r_regionkey + 1000), 'ad_group' FROM region
  UNION ALL SELECT 'S-1-5-21-1-1-3-1000', 'S-1-5-21-1-1-4-1000', 'ad_group' FROM region WHERE r_regionkey = 0),
placed AS (SELECT *, root || '\' || size AS middle, root || '\' || size || '\p' || p_partkey AS leaf FROM (
  SELECT p_partkey, lower(replace(p_brand, '#', '')) AS server_key, lower(p_type) AS type, lower(replace(p_brand, '#', '')) || '|' || lower(p_type) AS share_key,
         '\\' || lower(replace(p_brand, '#', '')) || '\' || lower(p_type) AS root, p_size::varchar AS size FROM part)),
servers AS (SELECT DISTINCT server_key FROM placed),
shares AS (SELECT DISTINCT share_key, server_key, type AS name FROM placed),
resources AS MATERIALIZED (
  SELECT DISTINCT root AS resource_key, NULL AS parent_key, server_key, share_key, 0 AS depth, true AS dacl_present, true AS dacl_protected, NULL::varchar AS owner_key FROM placed
  UNION ALL SELECT DISTINCT middle, root, server_key, share_key, 1, true, false, NULL::varchar FROM placed
  UNION ALL SELECT leaf, middle, server_key, share_key, 2, p_partkey % 97 <> 0, p_partkey % 11 = 0, 'S-1-5-21-1-1-2-' || (o + 1000)
    FROM placed LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS o FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
leaf_aces AS (
  SELECT leaf AS resource_key, trustee_key, ace_type, access_mask, ace_flags, min(l_orderkey) AS first_order FROM (
    SELECT l_partkey, l_orderkey, CASE WHEN l_suppkey % 10 = 0 THEN 'S-1-1-0' WHEN l_suppkey % 10 = 1 THEN 'S-1-5-11' WHEN l_suppkey % 10 <= 4 THEN 'S-1-5-21-1-1-3-' || (s_nationkey + 1000)
        WHEN l_suppkey % 10 <= 6 THEN 'S-1-5-21-1-1-4-' || (n_regionkey + 1000) WHEN l_suppkey % 10 = 7 THEN 'S-1-5-21-1-1-2-' || (l_suppkey + 1000)
        WHEN l_suppkey % 10 = 8 THEN 'S-1-5-21-1-1-5-' || ((l_suppkey // 10) % 5 + 1001) ELSE 'S-1-5-21-1-1-9-' || (l_suppkey + 1) END AS trustee_key,
      CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'deny' ELSE 'allow' END AS ace_type,
      ([1179817, 1245631, 2032127, 1179785, 1179926, 268435456, 2147483648, 262144]::bigint[])[1 + (floor(l_quantity)::bigint % 8)] AS access_mask,
      ([0, 3, 11, 16, 19, 0, 2, 1]::int[])[1 + (l_linenumber % 8)] AS ace_flags
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
  JOIN placed ON l_partkey = p_partkey WHERE p_partkey % 97 <> 0 GROUP BY ALL),
keyed_aces AS (SELECT *, resource_key || '|' || trustee_key || '|' || ace_type || '|0x' || lpad(lower(to_hex(access_mask)), 8, '0') || '|0x' || lpad(lower(to_hex(ace_flags)), 2, '0') AS ace_key FROM leaf_aces),
ntfs_aces AS MATERIALIZED (
  SELECT resource_key, trustee_key, ace_type, access_mask, ace_flags, (row_number() OVER (PARTITION BY resource_key ORDER BY first_order, ace_key) - 1)::int AS order_index, ace_key FROM keyed_aces
  UNION ALL SELECT resource_key, 'S-1-5-21-1-1-1-513', 'allow', 1179817, CASE depth WHEN 0 THEN 3 ELSE 19 END, 0,
    resource_key || '|S-1-5-21-1-1-1-513|allow|0x001200a9|' || CASE depth WHEN 0 THEN '0x03' ELSE '0x13' END FROM resources WHERE depth < 2),
share_aces AS MATERIALIZED (
  SELECT share_key, trustee_key, 'allow' AS ace_type, permission, share_key || '|' || trustee_key || '|allow|' || permission AS ace_key FROM (
    SELECT DISTINCT share_key, 'S-1-5-21-1-1-3-' || (s_nationkey + 1000) AS trustee_key, (['read', 'change', 'full'])[1 + (s_nationkey + length(type)) % 3] AS permission
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN placed ON l_partkey = p_partkey WHERE (substr(server_key, 6)::int + length(type)) % 7 <> 0)),
full_mask(m) AS (VALUES (4294967295::bigint))
"""

#: SQL of a mask with its generic rights expanded.
EXPAND = "(({m} & 268435455) | CASE WHEN {m} & 2147483648 <> 0 THEN 1179785 ELSE 0 END | CASE WHEN {m} & 1073741824 <> 0 THEN 1179926 ELSE 0 END | CASE WHEN {m} & 536870912 <> 0 THEN 1179808 ELSE 0 END | CASE WHEN {m} & 268435456 <> 0 THEN 2032127 ELSE 0 END)"
#: SQL of a mask's broadest category.
CATEGORY = (
    "CASE WHEN {m} & 983551 = 983551 THEN 'full_control' WHEN {m} & 197055 = 197055 THEN 'modify' WHEN {m} & 131241 = 131241 THEN 'read_execute' WHEN {m} & 278 = 278 THEN 'write'"
    " WHEN {m} & 131209 = 131209 THEN 'read' WHEN {m} & 32 = 32 THEN 'traverse' WHEN {m} & 4293918719 = 0 THEN 'none' ELSE 'special' END"
)


def expand(m: str) -> str:
    return EXPAND.replace("{m}", m)


def category(m: str) -> str:
    return CATEGORY.replace("{m}", m)


def sql(body: str) -> str:
    """``body`` (further CTEs begin with a comma, or a SELECT) after the estate's tables."""
    return f"{ESTATE}{body}"
