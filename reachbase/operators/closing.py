"""What a complete collection run may declare absent: rules as data, selected in one join.

A scope (collector, scope_kind, scope_key) is an authority for some kinds of objects.  Each rule names the kind and the
column that tells which objects are the scope's: equal to the scope's key, on or below its path, of a domain that the
run saw, or hanging on an object that another rule of the scope selected.  Every object offers its columns, a resource
also each path above it, as (kind, column, value); one equi-join with what the scopes ask for selects all objects of all
scopes, and a second one what hangs on these.  A scope without rules closes nothing.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachbase.functions import keys
from reachbase.functions.tables import cut


class Rule(NamedTuple):
    """``selector``: equals, subtree, run_domains or via_parent (of kind ``parent``).  ``hosted``: only objects with a host (true), without (false), or any (null)."""

    collector: str
    scope_kind: str
    kind: str
    selector: str
    column: str
    parent: str | None = None
    hosted: bool | None = None


# Which collector and scope may close which kinds.
RULES = (
    Rule("active_directory", "domain", "principal", "run_domains", "domain_sid", None, False),
    Rule("active_directory", "domain", "membership_edge", "via_parent", "group_key", "principal", False),
    Rule("local_groups", "local_groups_host", "principal", "equals", "host_key", None, True),
    Rule("local_groups", "local_groups_host", "membership_edge", "equals", "host_key", None, True),
    Rule("smb", "server", "server", "equals", "server_key"),
    Rule("smb", "server", "smb_share", "equals", "server_key"),
    Rule("smb", "server", "smb_ace", "via_parent", "share_key", "smb_share"),
    Rule("smb", "share", "smb_share", "equals", "share_key"),
    Rule("smb", "share", "smb_ace", "via_parent", "share_key", "smb_share"),
    Rule("ntfs", "server", "ntfs_resource", "equals", "server_key"),
    Rule("ntfs", "server", "ntfs_ace", "via_parent", "resource_key", "ntfs_resource"),
    Rule("ntfs", "share", "ntfs_resource", "equals", "share_key"),
    Rule("ntfs", "share", "ntfs_ace", "via_parent", "resource_key", "ntfs_resource"),
    Rule("ntfs", "directory_tree", "ntfs_resource", "subtree", "resource_key"),
    Rule("ntfs", "directory_tree", "ntfs_ace", "via_parent", "resource_key", "ntfs_resource"),
)
#: Columns of objects that rules look at.
COLUMNS = ("server_key", "share_key", "resource_key", "host_key", "group_key", "domain_sid")


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    for r in rules:
        same = {(x.collector, x.scope_kind, x.kind) for x in rules}
        if r.selector == "via_parent" and (r.collector, r.scope_kind, r.parent) not in same:
            raise ValueError(f"{r.kind} hangs on {r.parent}, which no rule of {r.collector} and {r.scope_kind} selects")
    return spark.createDataFrame(list(rules), "collector string, scope_kind string, kind string, selector string, column string, parent string, hosted boolean")


def _matched(scopes: DataFrame, objects: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``selected``, an object once for each rule that selects it.  An object offers only what some rule on its kind looks at."""
    table = rule_table(scopes.sparkSession, rules)
    asked = scopes.join(F.broadcast(table), ["collector", "scope_kind"])  # a constant table
    value = F.when(F.col("selector") == "run_domains", F.col("domains")).otherwise(F.array("scope_key"))
    direct = asked.where("selector <> 'via_parent'").select("scope_no", "kind", "selector", "column", "hosted", F.explode(value).alias("value")).distinct()
    on_host = F.col("host_key").isNotNull().alias("on_host")

    def offered(looks: list[tuple[str, str, str]]) -> DataFrame:
        offer = lambda selector, c, v: F.struct(F.lit(selector).alias("selector"), F.lit(c).alias("column"), v.alias("value"))
        none = F.array().cast("array<struct<selector:string,column:string,value:string>>")
        each = [
            F.when((F.col("kind") == kind) & F.col(c).isNotNull(), F.transform(_and_above(c), partial(offer, selector, c)) if selector == "subtree" else F.array(offer(selector, c, F.col(c))))
            for kind, selector, c in looks
        ]
        kinds = sorted({kind for kind, _, _ in looks})
        return objects.where(F.col("kind").isin(*kinds)).select("kind", "key", on_host, F.explode(F.concat(none, *[F.coalesce(x, none) for x in each])).alias("o")).select("kind", "key", "on_host", "o.*")

    fits = F.col("hosted").isNull() | (F.col("hosted") == F.col("on_host"))
    looks = sorted({(r.kind, r.selector, r.column) for r in rules if r.selector != "via_parent"})
    first = cut(offered(looks).join(direct, ["kind", "selector", "column", "value"]).where(fits).select("scope_no", "kind", "key").distinct())
    hanging = asked.where("selector = 'via_parent'").select("scope_no", "kind", "column", "hosted", "parent").join(first.select("scope_no", F.col("kind").alias("parent"), F.col("key").alias("value")), ["scope_no", "parent"])
    looks = sorted({(r.kind, "equals", r.column) for r in rules if r.selector == "via_parent"})
    if not looks:
        return first
    return first.unionByName(offered(looks).drop("selector").join(hanging, ["kind", "column", "value"]).where(fits).select("scope_no", "kind", "key"))


def _and_above(c: str) -> Column:
    return F.concat(F.array(c), F.transform(keys.ancestors(F.col(c)), lambda a: a["key"]))


def selected(scopes: DataFrame, objects: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """scope_no, kind, key: the objects each scope is an authority for.

    ``scopes``: scope_no, collector, scope_kind, scope_key, domains (those the run saw).  ``objects``: kind, key and ``COLUMNS``, null
    where an object has none.
    """
    return _matched(scopes, objects, rules).distinct()


def closed(scopes: DataFrame, objects: DataFrame, observed: DataFrame, rules: tuple[Rule, ...] = RULES, chosen: DataFrame | None = None) -> DataFrame:
    """scope_no, kind, key of what the scopes may close: selected, not in ``observed`` (scope_no, kind, key), and only where ``scopes.complete``.

    Objects that another scope of the same kind of collector saw are still closed here: each scope answers for itself.  ``chosen`` is what
    ``selected`` gave for these scopes and objects, where the caller has it.  What was selected and what was seen meet in one grouping.
    """
    done = scopes.where("complete").drop("complete")
    may = _matched(done, objects, rules) if chosen is None else chosen.join(done.select("scope_no"), "scope_no", "left_semi")
    side = lambda rows, seen: rows.select("scope_no", "kind", "key", F.lit(seen).alias("seen"))
    rows = side(may, False).unionByName(side(observed, True)).groupBy("scope_no", "kind", "key").agg(F.bool_or("seen").alias("seen"))
    return rows.where(~F.col("seen")).drop("seen")


def completion(runs: DataFrame) -> DataFrame:
    """run_id, status, reconciles from runs (run_id, claimed, expected_batches, received_batches, errors): what a run's own claim is worth.

    A run that claims success but sent fewer batches than it announced is partial; only full runs that
    succeeded may close anything.
    """
    short = F.col("received_batches") < F.col("expected_batches")
    status = F.when((F.col("claimed") == "succeeded") & (short | F.col("expected_batches").isNull()), "partial").otherwise(F.col("claimed"))
    return runs.select("run_id", status.alias("status"), (status == "succeeded").alias("reconciles"))
