"""What a collector's word is worth on arrival: starts of runs, affirmations, drift of a scope, and where a stored row comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.functions.tables import canonical_json

#: Columns that say who saw a state and not what it is.
PROVENANCE = ("source_key", "first_observed_at", "first_observed_run_id", "last_observed_at", "last_observed_run_id", "observed_at", "run_id")


def state_digest(rows: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """Digest of a row's state: its columns by name as JSON, nulls kept, provenance and ``without`` left out.

    Rows that differ in provenance alone have one digest; a null and a missing column differ.
    """
    return F.sha2(canonical_json(*[c for c in rows.columns if c not in PROVENANCE and c not in without]), 256)


def started(stored: DataFrame, starts: DataFrame) -> DataFrame:
    """run_id, outcome from runs and envelopes (run_id, source, mode, job, started_at, scopes): created, replayed or conflict.

    ``scopes`` is an array of text in any order, repeats aside.  An envelope of a stored run must describe the same run; among new
    envelopes of one run all must agree, else none is taken.  Equal ones create the run once.
    """
    face = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in ("source", "mode", "job", "started_at")], F.array_sort(F.array_distinct(F.coalesce("scopes", F.array().cast("array<string>")))).alias("scopes")), {"ignoreNullFields": "false"}), 256)
    new = starts.select("run_id", face.alias("face")).groupBy("run_id").agg(F.min("face").alias("face"), F.max("face").alias("other"))
    old = stored.select("run_id", face.alias("held"))
    rows = new.join(old, "run_id", "left")
    outcome = F.when(F.col("face") != F.col("other"), "conflict").when(F.col("held").isNull(), "created").when(F.col("held") == F.col("face"), "replayed").otherwise("conflict")
    return rows.select("run_id", outcome.alias("outcome"))


def affirmations(claims: DataFrame, stored: DataFrame, log: DataFrame, kind: str) -> DataFrame:
    """key, observed_at, outcome: what becomes of claims (key, digest, observed_at) that an object is still as it was.

    The server compares with its own copy, ``stored`` (key, digest), and with the open version in ``log``.  In this order: unknown_object (nothing
    stored), no_stored_digest (unknown is never taken for equal), digest_mismatch, untracked (no open version), absent (the open version is a tombstone: a claim
    carries no state that could bring an object back), else applied.  Of several claims on one object the newest counts, then the greatest digest.
    """
    newest = claims.groupBy("key").agg(F.max(F.struct("observed_at", "digest")).alias("c")).select("key", "c.observed_at", "c.digest")
    held = stored.select("key", F.col("digest").alias("held"), F.lit(True).alias("known"))
    open_ = log.where((F.col("kind") == kind) & F.col("valid_to").isNull()).select("key", F.col("state").isNotNull().alias("present"))
    rows = newest.join(held, "key", "left").join(open_, "key", "left")
    outcome = (
        F.when(F.col("known").isNull(), "unknown_object").when(F.col("held").isNull(), "no_stored_digest").when(~F.col("held").eqNullSafe(F.col("digest")), "digest_mismatch")
        .when(F.col("present").isNull(), "untracked").when(~F.col("present"), "absent").otherwise("applied")
    )
    return rows.select("key", "observed_at", outcome.alias("outcome"))


def confirm(log: DataFrame, outcomes: DataFrame, kind: str, contained: str) -> DataFrame:
    """The log with last_seen_at moved for the objects that ``affirmations`` applied and for the present entries that they contain.

    Without the entries the next completion would find them unseen and close them.  Nothing moves back.
    """
    done = outcomes.where("outcome = 'applied'").select("key", F.col("observed_at").alias("_at"))
    target = F.when(F.col("kind") == kind, F.col("key")).when((F.col("kind") == contained) & F.col("state").isNotNull(), F.col("container"))
    rows = log.withColumn("_target", F.when(F.col("valid_to").isNull(), target)).join(done.withColumnRenamed("key", "_target"), "_target", "left")
    return rows.withColumn("last_seen_at", F.greatest("last_seen_at", "_at")).select(*log.columns)


def drift(scopes: DataFrame, runs: DataFrame, corrected: DataFrame) -> DataFrame:
    """run_id, scope_kind, scope_key, marked_absent, revived, delta_runs_since for every scope that a run reconciled.

    ``scopes``: run_id, scope_kind, scope_key, reconciled.  ``runs``: run_id, mode, completed_at.  ``corrected``: run_id, scope_kind, scope_key, marked_absent, revived.
    Delta runs count from the last completion, at an earlier time, that reconciled the scope, whatever job ran it: no delta announces what has vanished, so that many runs
    could not have told.  Runs that never completed count for nothing.
    """
    place = ["scope_kind", "scope_key"]
    rows = scopes.join(runs.where("completed_at IS NOT NULL"), "run_id").select("run_id", *place, "completed_at", F.coalesce("reconciled", F.lit(False)).alias("reconciled"), (F.col("mode") == "delta").cast("long").alias("delta"))
    # Ticks of one instant stand together: running sums by instant, so that order within it does not matter.
    at = rows.groupBy(*place, "completed_at").agg(F.sum("delta").alias("delta"), F.bool_or("reconciled").alias("reconciled"))
    by = Window.partitionBy(*place).orderBy("completed_at")
    summed = at.withColumn("upto", F.sum("delta").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.last(F.when(F.col("reconciled"), F.col("upto")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    since = summed.select(*place, "completed_at", (F.col("upto") - F.coalesce(before, F.lit(0).cast("long"))).alias("delta_runs_since"))
    done = rows.where("reconciled").join(since, [*place, "completed_at"]).join(corrected, ["run_id", *place], "left")
    zero = F.lit(0).cast("long")
    return done.select("run_id", *place, F.coalesce("marked_absent", zero).alias("marked_absent"), F.coalesce("revived", zero).alias("revived"), "delta_runs_since")


def provenance(asked: DataFrame, tables: dict[str, tuple[DataFrame, str]], runs: DataFrame, sources: DataFrame) -> DataFrame:
    """record, key, source_key, first and last time and run, collector, method, last_run_status for the rows asked for (record, key).

    ``tables`` names for each kind of record its rows (with ``PROVENANCE``'s first six columns) and their key column.  ``runs``: run_id, source_id, status;
    ``sources``: source_id, collector, method.  A key without a row is not in the result; a row whose run is unknown keeps nulls.
    """
    columns = ["source_key", "first_observed_at", "first_observed_run_id", "last_observed_at", "last_observed_run_id"]
    rows = None
    for record, (table, key) in tables.items():
        side = table.select(F.lit(record).alias("record"), F.col(key).alias("key"), *columns)
        rows = side if rows is None else rows.unionByName(side)
    found = rows.join(asked.select("record", "key").distinct(), ["record", "key"], "left_semi")
    by_run = runs.join(sources, "source_id", "left").select(F.col("run_id").alias("last_observed_run_id"), "collector", "method", F.col("status").alias("last_run_status"))
    return found.join(by_run, "last_observed_run_id", "left").select("record", "key", *columns, "collector", "method", "last_run_status")
