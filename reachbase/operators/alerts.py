"""Alerts: which changes a watch concerns, and who is told again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched(watches: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that a watch (watch_id, kind, key, trigger, enabled) names, letter case of the key aside."""
    w = watches.withColumn("key", F.lower("key"))
    c = changes.withColumn("_key", F.lower("key")).drop("key").withColumnRenamed("_key", "key").withColumnRenamed("action", "trigger")
    return c.join(w, ["kind", "key", "trigger"])


def decide(events: DataFrame, cooldown_seconds: int) -> DataFrame:
    """alert, seq, transition, folds, from events (alert, seq, at, digest, ends, enabled).

    Events of an alert are folded in order.  The first is raised; one after a resolution reopens; equal
    content, and what comes before the cool-down since the last notice has passed, is suppressed and
    counted; the rest repeats and says how many it folds in.
    """
    item = F.struct("seq", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "digest", "ends", "enabled")
    lists = events.groupBy("alert").agg(F.array_sort(F.collect_list(item)).alias("e"))
    null_text, null_long = F.lit(None).cast("string"), F.lit(None).cast("long")
    out_type = "array<struct<seq:bigint,transition:string,folds:int>>"
    start = F.struct(null_text.alias("status"), null_text.alias("told"), null_long.alias("told_at"), F.lit(0).alias("folds"), F.array().cast(out_type).alias("out"))

    def step(s: Column, x: Column) -> Column:
        transition = (
            F.when(x["ends"], F.when(s["status"] == "open", "resolved").otherwise("ignored")).when(~x["enabled"], "suppressed_disabled").when(s["status"].isNull(), "raised").when(s["status"] == "resolved", "reopened")
            .when(s["told"] == x["digest"], "suppressed_identical").when(x["us"] < s["told_at"] + cooldown_seconds * 1_000_000, "suppressed_cooldown").otherwise("repeated")
        )
        told, quiet = transition.isin("raised", "reopened", "repeated"), transition.startswith("suppressed")
        folds = F.when(quiet, s["folds"] + 1).when(transition == "repeated", s["folds"] + 1).otherwise(F.lit(0))
        return F.struct(
            F.when(told, "open").when(transition == "resolved", "resolved").otherwise(s["status"]).alias("status"), F.when(told, x["digest"]).otherwise(s["told"]).alias("told"),
            F.when(told, x["us"]).otherwise(s["told_at"]).alias("told_at"), F.when(told, F.lit(0)).when(quiet, s["folds"] + 1).otherwise(s["folds"]).alias("folds"),
            F.concat(s["out"], F.array(F.struct(x["seq"].cast("long").alias("seq"), transition.alias("transition"), folds.alias("folds")))).alias("out"),
        )

    each = lists.select("alert", F.explode(F.aggregate("e", start, step, lambda s: s["out"])).alias("x"))
    return each.select("alert", "x.*")


def due(outbox: DataFrame, now: Column, limit: int) -> DataFrame:
    """What to deliver next, oldest first; a failed attempt waits twice as long each time."""
    wait = F.make_dt_interval(secs=F.pow(F.lit(2.0), "attempts").cast("decimal(18,6)") * 30)
    return outbox.where((F.col("status") == "pending") & (F.col("created_at") + wait <= now)).orderBy("created_at", "outbox_id").limit(limit)
