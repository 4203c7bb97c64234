"""Collector batches: JSON envelopes to typed rows, each batch taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachbase.functions import keys, masks

_S, _B, _L, _I = T.StringType(), T.BooleanType(), T.LongType(), T.IntegerType()
#: Every field that an observation of any kind may carry.
OBSERVATION = T.StructType([T.StructField(n, t) for n, t in {
    "kind": _S, "observed_at": _S, "source_key": _S, "sid": _S, "principal_kind": _S, "host_key": _S, "domain_sid": _S, "display_name": _S, "enabled": _B, "is_deleted": _B,
    "group_sid": _S, "member_sid": _S, "edge_kind": _S, "name": _S, "server_name": _S, "share_name": _S, "local_path": _S, "share_type": _S, "trustee_sid": _S, "ace_type": _S,
    "access_mask": _L, "permission": _S, "order_index": _I, "path": _S, "owner_sid": _S, "dacl_present": _B, "dacl_protected": _B, "ace_count": _I, "acl_hash": _S, "ace_flags": _I, "source": _S,
}.items()])
ENVELOPE = T.StructType([
    T.StructField("run_id", _S), T.StructField("batch_id", _S), T.StructField("sequence", _I), T.StructField("is_final", _B), T.StructField("observations", T.ArrayType(OBSERVATION)),
])
KINDS = ("principal", "membership_edge", "server", "smb_share", "smb_ace", "ntfs_resource", "ntfs_ace")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of a folder, one JSON document for each file."""
    return spark.read.schema(ENVELOPE).json(path, multiLine=True)


def parse_batches(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, ENVELOPE).alias("b")).select("b.*")


def claimed(batches: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """A batch counts once, however often it is sent."""
    once = batches.dropDuplicates(["run_id", "batch_id"])
    return once if applied is None else once.join(applied.select("run_id", "batch_id"), ["run_id", "batch_id"], "left_anti")


def observations(batches: DataFrame) -> DataFrame:
    """One row for each observation, with its run, and its place in the run as arrival order."""
    rows = batches.select("run_id", "batch_id", "sequence", F.posexplode("observations").alias("position", "o")).select("run_id", "batch_id", (F.col("sequence").cast("long") * 1_000_000 + F.col("position")).alias("arrival"), "o.*")
    return rows.withColumn("observed_at", F.to_timestamp_ltz("observed_at"))


def rejected(rows: DataFrame) -> DataFrame:
    """run_id, source_key, problem: what the contract forbids."""
    named = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown_kind"), F.when(F.col("observed_at").isNull(), "no_instant"),
        F.when((F.col("kind") == "smb_ace") & (F.col("access_mask").isNotNull() == F.col("permission").isNotNull()), "mask_xor_permission"),
        F.when(F.col("access_mask").isNotNull() & ~F.col("access_mask").between(0, masks.FULL_32), "mask_out_of_range"), F.when((F.col("kind") == "ntfs_ace") & ~F.col("ace_flags").between(0, 255), "flags_out_of_range"),
    ))
    return rows.select("run_id", "source_key", F.explode(named).alias("problem"))


def principals(rows: DataFrame) -> DataFrame:
    p = rows.where("kind = 'principal'")
    return p.select(keys.principal_key(F.col("sid"), F.col("host_key"), F.col("principal_kind")).alias("principal_key"), F.col("principal_kind").alias("kind"), F.col("display_name").alias("name"), "enabled", "observed_at", "arrival")


def edges(rows: DataFrame) -> DataFrame:
    e = rows.where("kind = 'membership_edge'")
    return e.select(keys.principal_key(F.col("group_sid"), F.col("host_key")).alias("group_key"), keys.principal_key(F.col("member_sid"), F.col("host_key")).alias("member_key"), "edge_kind", "observed_at", "arrival")


def servers(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'server'").select(F.lower("name").alias("server_key"), "observed_at", "arrival")


def shares(rows: DataFrame) -> DataFrame:
    s = rows.where("kind = 'smb_share'")
    return s.select(keys.share_key(F.col("server_name"), F.col("share_name")).alias("share_key"), F.lower("server_name").alias("server_key"), F.lower("share_name").alias("name"), "local_path", "share_type", "observed_at", "arrival")


def ntfs_aces(rows: DataFrame) -> DataFrame:
    a = rows.where("kind = 'ntfs_ace'").withColumns({"resource_key": keys.resource_key(F.col("path")), "trustee_key": keys.principal_key(F.col("trustee_sid"), F.element_at(keys.parts(F.col("path")), 1))})
    return a.select("resource_key", "trustee_key", "ace_type", "access_mask", "ace_flags", "order_index", keys.ntfs_ace_key(F.col("resource_key"), F.col("trustee_key"), F.col("ace_type"), F.col("access_mask"), F.col("ace_flags")).alias("ace_key"), "observed_at", "arrival")


def share_aces(rows: DataFrame) -> DataFrame:
    a = rows.where("kind = 'smb_ace'").withColumns({"share_key": keys.share_key(F.col("server_name"), F.col("share_name")), "trustee_key": keys.principal_key(F.col("trustee_sid"), F.col("server_name")), "permission": F.coalesce("permission", masks.share_level(F.col("access_mask")))})
    return a.select("share_key", "trustee_key", "ace_type", "permission", keys.share_ace_key(F.col("share_key"), F.col("trustee_key"), F.col("ace_type"), F.col("permission")).alias("ace_key"), "observed_at", "arrival")


def resources(rows: DataFrame) -> DataFrame:
    r = rows.where("kind = 'ntfs_resource'").withColumn("resource_key", keys.resource_key(F.col("path")))
    names = keys.parts(F.col("resource_key"))
    return r.select("resource_key", keys.parent_key(F.col("resource_key")).alias("parent_key"), names[0].alias("server_key"), F.concat_ws("|", names[0], names[1]).alias("share_key"), (F.size(names) - 2).alias("depth"), "dacl_present", "dacl_protected", F.col("owner_sid").alias("owner_key"), "observed_at", "arrival")


def run_totals(batches: DataFrame) -> DataFrame:
    """run_id, batches, observations, first_missing: a gap in the sequence numbers, if there is one."""
    held = batches.groupBy("run_id").agg(F.count("*").alias("batches"), F.sum(F.size("observations")).alias("observations"), F.array_sort(F.collect_set("sequence")).alias("s"), F.bool_or("is_final").alias("closed"))
    gap = F.array_min(F.array_except(F.sequence(F.lit(0), F.array_max("s")), F.col("s")))
    return held.select("run_id", "batches", "observations", gap.alias("first_missing"), "closed")
