"""The tables that every operator reads, and their projection from the synthetic tables.

An ``Estate`` is a set of DataFrames: the live one, one as it was at an instant, and one with planned
changes laid over it have the same shape, so each operator runs on any of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachbase.functions import keys, masks
from reachbase.functions.tables import cut

USERS, SERVICES, NATIONS, REGIONS, SEGMENTS, UNKNOWN = (f"S-1-5-21-1-1-{n}-" for n in (1, 2, 3, 4, 5, 9))
DOMAIN_USERS = USERS + "513"
LEAF_MASKS = (0x001200A9, 0x001301BF, 0x001F01FF, 0x00120089, 0x00120116, masks.GENERIC_ALL, masks.GENERIC_READ, masks.WRITE_DAC)
LEAF_FLAGS = (0, 3, 11, 16, 19, 0, 2, 1)


@dataclass(frozen=True)
class Estate:
    """principals: key, kind, name, enabled (null: nobody said).  edges: group_key, member_key, edge_kind.
    servers: server_key.  shares: share_key, server_key, name.  share_aces: share_key, trustee_key,
    ace_type, permission, ace_key.  resources: resource_key, parent_key, server_key, share_key, depth,
    dacl_present, dacl_protected, owner_key.  ntfs_aces: resource_key, trustee_key, ace_type,
    access_mask, ace_flags, order_index, ace_key."""

    principals: DataFrame
    edges: DataFrame
    servers: DataFrame
    shares: DataFrame
    share_aces: DataFrame
    resources: DataFrame
    ntfs_aces: DataFrame

    def with_(self, **tables: DataFrame) -> Estate:
        return replace(self, **tables)

    def settled(self) -> Estate:
        """The estate with its lists and resources written once, for operators that read them several times."""
        return self.with_(share_aces=cut(self.share_aces), resources=cut(self.resources), ntfs_aces=cut(self.ntfs_aces))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("long").cast("string"))


def _pick(values: tuple[int, ...], at: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (at + 1).cast("int"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five market segments with their rank."""
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    return names.withColumn("rank", F.dense_rank().over(Window.orderBy("segment")))


def project(spark: SparkSession, sf_dir: str) -> Estate:
    """The estate that the synthetic tables stand for; integer rules only, so that SQL agrees."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "supplier", "nation", "region", "part", "lineitem")}
    c, s, n, r, p, item = (t[x] for x in ("customer", "supplier", "nation", "region", "part", "lineitem"))
    seg = F.broadcast(segments(spark, sf_dir))  # five rows

    def principal(rows: DataFrame, key: Column, kind: str, name: Column, enabled: Column) -> DataFrame:
        return rows.select(key.alias("principal_key"), F.lit(kind).alias("kind"), name.alias("name"), enabled.alias("enabled"))

    nobody_said, yes = F.lit(None).cast("boolean"), F.lit(True)
    principals = principal(c, _key(USERS, F.col("c_custkey") + 100000), "user", F.col("c_name"), F.when(F.col("c_custkey") % 17 != 0, F.col("c_acctbal") >= 0))
    principals = principals.unionByName(principal(s, _key(SERVICES, F.col("s_suppkey") + 1000), "managed_service_account", F.col("s_name"), yes))
    principals = principals.unionByName(principal(n, _key(NATIONS, F.col("n_nationkey") + 1000), "group", F.col("n_name"), nobody_said))
    principals = principals.unionByName(principal(r, _key(REGIONS, F.col("r_regionkey") + 1000), "group", F.col("r_name"), nobody_said))
    principals = principals.unionByName(principal(seg, _key(SEGMENTS, F.col("rank") + 1000), "group", F.col("segment"), nobody_said))
    fixed = spark.createDataFrame([(DOMAIN_USERS, "group", "Domain Users"), (keys.EVERYONE, "well_known", "Everyone"), (keys.AUTHENTICATED, "well_known", "Authenticated Users")], "principal_key string, kind string, name string")
    principals = principals.unionByName(fixed.withColumn("enabled", nobody_said))

    def edge(rows: DataFrame, group: Column, member: Column) -> DataFrame:
        return rows.select(group.alias("group_key"), member.alias("member_key"), F.lit("ad_group").alias("edge_kind"))

    user, service = _key(USERS, F.col("c_custkey") + 100000), _key(SERVICES, F.col("s_suppkey") + 1000)
    edges = edge(c, _key(NATIONS, F.col("c_nationkey") + 1000), user)
    edges = edges.unionByName(edge(c.join(seg, c["c_mktsegment"] == seg["segment"]), _key(SEGMENTS, F.col("rank") + 1000), user))
    edges = edges.unionByName(edge(s, _key(NATIONS, F.col("s_nationkey") + 1000), service))
    edges = edges.unionByName(edge(n, _key(REGIONS, F.col("n_regionkey") + 1000), _key(NATIONS, F.col("n_nationkey") + 1000)))
    edges = edges.unionByName(edge(r, F.lit(DOMAIN_USERS), _key(REGIONS, F.col("r_regionkey") + 1000)))
    edges = edges.unionByName(edge(r.where("r_regionkey = 0"), _key(NATIONS, F.lit(1000)), _key(REGIONS, F.lit(1000))))

    server, kind = F.lower(F.replace("p_brand", F.lit("#"))), F.lower("p_type")
    placed = p.select("p_partkey", server.alias("server_key"), kind.alias("type"), keys.share_key(server, kind).alias("share_key"), F.col("p_size").cast("string").alias("size"))
    root = F.concat(F.lit("\\\\"), F.col("server_key"), F.lit("\\"), F.col("type"))
    placed = placed.withColumns({"root": root, "middle": F.concat(root, F.lit("\\"), "size")})
    placed = placed.withColumn("leaf", F.concat("middle", F.lit("\\p"), F.col("p_partkey").cast("string")))
    servers = placed.select("server_key").distinct()
    shares = placed.select("share_key", "server_key", F.col("type").alias("name")).distinct()
    owner = item.groupBy("l_partkey").agg(_key(SERVICES, F.min("l_suppkey") + 1000).alias("owner_key"))

    def resource(rows: DataFrame, key: str, depth: int, present: Column, protected: Column, owner_key: Column) -> DataFrame:
        return rows.select(F.col(key).alias("resource_key"), keys.parent_key(F.col(key)).alias("parent_key"), "server_key", "share_key", F.lit(depth).alias("depth"), present.alias("dacl_present"), protected.alias("dacl_protected"), owner_key.alias("owner_key"))

    none = F.lit(None).cast("string")
    roots = resource(placed.select("server_key", "share_key", "root").distinct(), "root", 0, yes, yes, none)
    middles = resource(placed.select("server_key", "share_key", "middle").distinct(), "middle", 1, yes, F.lit(False), none)
    leaves = resource(placed.join(owner, placed["p_partkey"] == owner["l_partkey"], "left"), "leaf", 2, F.col("p_partkey") % 97 != 0, F.col("p_partkey") % 11 == 0, F.col("owner_key"))
    resources = roots.unionByName(middles).unionByName(leaves)

    # Lines are dealt by their part once, as numbers; lists are gathered, placed and ordered where they lie.
    deny = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    slim = item.select("l_partkey", "l_orderkey", "l_suppkey", deny.alias("deny"), (F.floor("l_quantity") % 8).cast("byte").alias("m"), (F.col("l_linenumber") % 8).cast("byte").alias("f")).repartition("l_partkey")
    lines = slim.join(s, slim["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"])
    k = F.col("l_suppkey") % 10
    trustee = (
        F.when(k == 0, F.lit(keys.EVERYONE)).when(k == 1, F.lit(keys.AUTHENTICATED)).when(k <= 4, _key(NATIONS, F.col("s_nationkey") + 1000)).when(k <= 6, _key(REGIONS, F.col("n_regionkey") + 1000))
        .when(k == 7, _key(SERVICES, F.col("l_suppkey") + 1000)).when(k == 8, _key(SEGMENTS, F.expr("(l_suppkey div 10) % 5") + 1001)).otherwise(_key(UNKNOWN, F.col("l_suppkey") + 1))
    )
    entry = lines.select(
        F.col("l_partkey"), "l_orderkey", trustee.alias("trustee_key"), F.when(F.col("deny"), "deny").otherwise("allow").alias("ace_type"),
        _pick(LEAF_MASKS, F.col("m"), "long").alias("access_mask"), _pick(LEAF_FLAGS, F.col("f"), "int").alias("ace_flags"),
    )
    entry = entry.groupBy("l_partkey", "trustee_key", "ace_type", "access_mask", "ace_flags").agg(F.min("l_orderkey").alias("at"))
    entry = entry.join(placed.where("p_partkey % 97 <> 0").select("p_partkey", F.col("leaf").alias("resource_key")), F.col("l_partkey") == F.col("p_partkey"))
    entry = entry.withColumn("ace_key", keys.ntfs_ace_key(F.col("resource_key"), F.col("trustee_key"), F.col("ace_type"), F.col("access_mask"), F.col("ace_flags")))
    entry = entry.withColumn("order_index", F.row_number().over(Window.partitionBy("l_partkey", "resource_key").orderBy("at", "ace_key")) - 1)
    columns = ["resource_key", "trustee_key", "ace_type", "access_mask", "ace_flags", "order_index", "ace_key"]

    def above(rows: DataFrame, flags: int) -> DataFrame:
        held = rows.select("resource_key", F.lit(DOMAIN_USERS).alias("trustee_key"), F.lit("allow").alias("ace_type"), F.lit(0x001200A9).cast("long").alias("access_mask"), F.lit(flags).alias("ace_flags"), F.lit(0).alias("order_index"))
        return held.withColumn("ace_key", keys.ntfs_ace_key(F.col("resource_key"), F.col("trustee_key"), F.col("ace_type"), F.col("access_mask"), F.col("ace_flags")))

    ntfs_aces = entry.select(*columns).unionByName(above(roots, 3)).unionByName(above(middles, 19))

    granted = item.join(s, item["l_suppkey"] == s["s_suppkey"]).select("l_partkey", "s_nationkey").repartition("l_partkey").join(placed, F.col("l_partkey") == F.col("p_partkey"))
    granted = granted.where((F.substring("server_key", 6, 9).cast("int") + F.length("type")) % 7 != 0).select("share_key", "type", "s_nationkey").distinct()
    level = F.element_at(F.array(*[F.lit(x) for x in masks.SHARE_LEVELS]), ((F.col("s_nationkey") + F.length("type")) % 3 + 1).cast("int"))
    share_aces = granted.select("share_key", _key(NATIONS, F.col("s_nationkey") + 1000).alias("trustee_key"), F.lit("allow").alias("ace_type"), level.alias("permission"))
    share_aces = share_aces.withColumn("ace_key", keys.share_ace_key(F.col("share_key"), F.col("trustee_key"), F.col("ace_type"), F.col("permission")))
    return Estate(principals, edges, servers, shares, share_aces, resources, ntfs_aces)
