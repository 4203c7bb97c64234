"""Versions of observed objects: ``[valid_from, valid_to)`` with the last time each was confirmed.

A version with a null state is a tombstone: absence that was measured.  No version at all means that
nobody looked, which is neither presence nor absence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(observations: DataFrame) -> DataFrame:
    """From (kind, key, container, observed_at, state): one row for each stretch with one state.

    Readings are ordered by when they were made, so late ones fall into place; readings of one instant
    that differ are settled by the greatest state.  A move to another container begins a new stretch.  Objects
    are independent: one shuffle by kind and key.
    """
    once = observations.groupBy("kind", "key", "observed_at").agg(F.max(F.struct(F.col("state").isNotNull(), "state", "container")).alias("s"))
    by = Window.partitionBy("kind", "key").orderBy("observed_at")
    rows = once.select("kind", "key", "observed_at", "s.state", "s.container")
    moved = ~F.col("state").eqNullSafe(F.lag("state").over(by)) | ~F.col("container").eqNullSafe(F.lag("container").over(by))
    rows = rows.withColumn("new", moved | (F.row_number().over(by) == 1))
    rows = rows.withColumn("stretch", F.sum(F.col("new").cast("int")).over(by))
    held = rows.groupBy("kind", "key", "container", "stretch").agg(F.first("state").alias("state"), F.min("observed_at").alias("valid_from"), F.max("observed_at").alias("last_seen_at"))
    return held.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("kind", "key").orderBy("valid_from"))).drop("stretch")


def as_of(log: DataFrame, t: Column) -> DataFrame:
    """The version of each object that holds at an instant."""
    return log.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def presence(keys_: DataFrame, log: DataFrame, t: Column) -> DataFrame:
    """kind, key, present: true, false if measured absent, null if nobody looked."""
    return keys_.join(as_of(log, t).select("kind", "key", F.col("state").isNotNull().alias("present")), ["kind", "key"], "left")


def certainty_at(t: Column) -> Column:
    """How well a version is known to hold at an instant: read at or after it, or only before."""
    return F.when(F.col("last_seen_at") >= t, "observed").otherwise("inferred")


def absent_now(log: DataFrame) -> DataFrame:
    return log.where(F.col("state").isNull() & F.col("valid_to").isNull())


def with_predecessor(log: DataFrame) -> DataFrame:
    """Adds before_state, before_seen_at and had_before."""
    by = Window.partitionBy("kind", "key").orderBy("valid_from")
    return log.withColumns({"before_state": F.lag("state").over(by), "before_seen_at": F.lag("last_seen_at").over(by), "had_before": F.lag("valid_from").over(by).isNotNull()})


def first_present(log: DataFrame) -> DataFrame:
    """kind, container, first_at."""
    return log.where(F.col("state").isNotNull()).groupBy("kind", "container").agg(F.min("valid_from").alias("first_at"))


def confirmed_before(log: DataFrame, asked: DataFrame, bucket: str = "day") -> DataFrame:
    """Adds confirmed_at to (kind, container, at): the newest confirmation in the container before the instant.

    Confirmations and questions are put in one order inside buckets of time, so a container of many readings is
    spread; what earlier buckets hold comes from one maximum for each.  No range is joined.
    """
    seen = log.select("kind", "container", F.col("last_seen_at").alias("at"), F.col("last_seen_at").alias("seen"), F.lit(1).alias("turn"))
    # At one instant the question comes first: only earlier confirmations count.
    questions = asked.select("kind", "container", "at").distinct().select("*", F.lit(None).cast("timestamp_ntz").alias("seen"), F.lit(0).alias("turn"))
    rows = seen.unionByName(questions).withColumn("bucket", F.date_trunc(bucket, "at"))
    earlier = Window.partitionBy("kind", "container").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("kind", "container", "bucket").agg(F.max("seen").alias("most")).select("kind", "container", "bucket", F.max("most").over(earlier).alias("before"))
    run = Window.partitionBy("kind", "container", "bucket").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    answered = rows.withColumn("inside", F.max("seen").over(run)).where("turn = 0").join(before, ["kind", "container", "bucket"])
    answered = answered.select("kind", "container", "at", F.coalesce("inside", "before").alias("confirmed_at"))
    return asked.join(answered, ["kind", "container", "at"], "left")


def close_absent(log: DataFrame, scope: Column, observed: DataFrame, completed_at: Column) -> DataFrame:
    """Open versions of a scope that a complete run did not see, each with the instant of its tombstone."""
    open_ = log.where(F.col("valid_to").isNull() & F.col("state").isNotNull() & scope & (F.col("last_seen_at") <= completed_at))
    return open_.join(observed.select("kind", "key").distinct(), ["kind", "key"], "left_anti").withColumn("closed_at", completed_at)


def removable(log: DataFrame, cutoff: Column) -> DataFrame:
    """Closed versions older than the cutoff, except the newest closed one of each object."""
    newest = F.max(F.when(F.col("valid_to").isNotNull(), F.col("valid_from"))).over(Window.partitionBy("kind", "key"))
    return log.withColumn("newest", newest).where(F.col("valid_to").isNotNull() & (F.col("valid_to") < cutoff) & (F.col("valid_from") != F.col("newest"))).drop("newest")


def violations(log: DataFrame) -> DataFrame:
    """kind, key, violation: what may never be in a log."""
    by = Window.partitionBy("kind", "key").orderBy("valid_from")
    named = F.array_compact(F.array(
        F.when(F.col("valid_to") <= F.col("valid_from"), "empty_interval"), F.when(F.col("last_seen_at") < F.col("valid_from"), "seen_before_start"),
        F.when(F.lead("valid_from").over(by) < F.col("valid_to"), "overlap"), F.when(F.col("valid_to").isNull() & F.lead("valid_from").over(by).isNotNull(), "open_before_later"),
    ))
    return log.withColumn("_v", named).select("kind", "key", F.explode("_v").alias("violation"))


def newest_wins(rows: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """From (key, payload, observed_at, arrival): the newest payload, with the first and last time seen.

    An older reading moves only the first time back; at one instant the later arrival wins.
    """
    return rows.groupBy(*key).agg(F.max_by(F.struct(*payload), F.struct("observed_at", "arrival")).alias("p"), F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at")).select(*key, "p.*", "first_observed_at", "last_observed_at")


def aliases(rows: DataFrame) -> DataFrame:
    """key, alias, first_seen, last_seen: every name that an object went by, letter case aside."""
    return rows.groupBy("key", F.lower("name").alias("alias")).agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))


def estate_at(estate, logs: dict[str, DataFrame], t: Column):
    """The estate as it was at an instant: each table named in ``logs`` (its columns, valid_from, valid_to) by its versions that hold then."""
    return estate.with_(**{name: as_of(log, t).select(*getattr(estate, name).columns) for name, log in logs.items()})


def affirmed(log: DataFrame, seen: DataFrame) -> DataFrame:
    """The log with open versions confirmed by readings (kind, key, at) that say: still as it was."""
    newest = seen.groupBy("kind", "key").agg(F.max("at").alias("_at"))
    rows = log.join(newest, ["kind", "key"], "left")
    return rows.withColumn("last_seen_at", F.when(F.col("valid_to").isNull(), F.greatest("last_seen_at", "_at")).otherwise(F.col("last_seen_at"))).drop("_at")


def affirmed_contained(log: DataFrame, seen: DataFrame) -> DataFrame:
    """The same for all open, present versions of a container (kind, container, at)."""
    newest = seen.groupBy("kind", "container").agg(F.max("at").alias("_at"))
    open_ = F.col("valid_to").isNull() & F.col("state").isNotNull()
    return log.join(newest, ["kind", "container"], "left").withColumn("last_seen_at", F.when(open_, F.greatest("last_seen_at", "_at")).otherwise(F.col("last_seen_at"))).drop("_at")


def timeline(log: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` versions of each object in order, each with its transition and whether older ones were left out."""
    down = Window.partitionBy("kind", "key").orderBy(F.col("valid_from").desc())
    rows = with_predecessor(log).withColumns({"seat": F.row_number().over(down), "n": F.count("*").over(Window.partitionBy("kind", "key"))})
    move = F.when(F.col("state").isNull(), "removed").when(~F.col("had_before"), "first_observed").when(F.col("before_state").isNull(), "returned").otherwise("changed")
    return rows.where(F.col("seat") <= limit).select("kind", "key", "valid_from", "state", move.alias("transition"), (F.col("n") > limit).alias("truncated"))


def currently_present(base: DataFrame, log: DataFrame, kind: str, key: str) -> DataFrame:
    """The rows of a table whose object has no open tombstone."""
    gone = absent_now(log).where(F.col("kind") == kind).select(F.col("key").alias(key))
    return base.join(gone, key, "left_anti")
