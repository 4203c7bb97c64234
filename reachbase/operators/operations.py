"""Collection runs: the latest of each scope, how complete they are and what they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.functions.tables import first_by


def latest(runs: DataFrame, only: Column | None = None) -> DataFrame:
    """The newest run of each collector and target."""
    rows = runs if only is None else runs.where(only)
    return first_by(rows.withColumn("target", F.coalesce("target", F.lit(""))), ["collector", "target"], [F.col("started_at").desc(), F.col("run_id").desc()])


def completeness(runs: DataFrame) -> DataFrame:
    """Adds missing (claimed and not stored, never below zero) and completeness."""
    missing = F.when(F.col("reported").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("reported") - F.col("received")))
    rows = runs.withColumn("missing", missing)
    return rows.withColumn("completeness", F.when(F.col("status").isin("running", "pending"), "in_progress").when(F.col("status").isin("failed", "canceled"), "none").when((F.col("status") == "succeeded") & (F.col("errors") == 0) & (F.col("missing") == 0), "complete").otherwise("partial"))


def scopes(runs: DataFrame) -> DataFrame:
    """collector, target, state, last_success, last_failure, stale: a success older than the latest failed run."""
    now = latest(runs).select("collector", "target", F.col("status").alias("state"), F.col("started_at").alias("latest_at"))
    good = latest(runs, F.col("status") == "succeeded").select("collector", "target", F.col("started_at").alias("last_success"))
    bad = latest(runs, F.col("status") == "failed").select("collector", "target", F.col("started_at").alias("last_failure"))
    rows = now.join(good, ["collector", "target"], "left").join(bad, ["collector", "target"], "left")
    return rows.withColumn("stale", F.col("last_success").isNotNull() & (F.col("latest_at") > F.col("last_success")))


def coverage(runs: DataFrame) -> DataFrame:
    """collector, scopes, collected, failed, stale, never, verdict."""
    rows = scopes(runs).groupBy("collector").agg(F.count("*").alias("scopes"), F.count_if(F.col("state") == "succeeded").alias("collected"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if("stale").alias("stale"), F.count_if(F.col("last_success").isNull()).alias("never"))
    return rows.withColumn("verdict", F.when(F.col("failed") > 0, "incomplete").when(F.col("collected") == F.col("scopes"), "complete").otherwise("partial"))


def errors_by_code(errors: DataFrame) -> DataFrame:
    """code, errors, collectors, latest, examples: at most three targets, the first by name."""
    first = first_by(errors.select("code", "target").where("target IS NOT NULL").distinct(), ["code"], [F.col("target").asc()], 3)
    examples = first.groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("examples"))
    tallies = errors.groupBy("code").agg(F.count("*").alias("errors"), F.count_distinct("collector").alias("collectors"), F.max("occurred_at").alias("latest"))
    return tallies.join(examples, "code", "left").fillna("", ["examples"])


def facets(rows: DataFrame, column: str, members: list[str]) -> DataFrame:
    """A count for every member of a vocabulary, zero where it does not occur."""
    names = rows.sparkSession.createDataFrame([(m,) for m in members], f"{column} string")
    return names.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def basis(rows: DataFrame) -> DataFrame:
    """n, latest, token: what was collected so far, as a short digest that changes when it does."""
    held = rows.agg(F.count("*").alias("n"), F.max("started_at").alias("latest"), F.max_by("run_id", F.struct("started_at", "run_id")).alias("latest_run"))
    return held.withColumn("token", F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.date_format("latest", "yyyy-MM-dd HH:mm:ss"), F.col("latest_run").cast("string")), 256), 1, 32))


def runs_since(runs: DataFrame) -> DataFrame:
    """collector, target, since: runs after the last successful one, all if there is none."""
    good = latest(runs, F.col("status") == "succeeded").select("collector", "target", F.col("started_at").alias("good_at"))
    rows = runs.join(good, ["collector", "target"], "left")
    return rows.groupBy("collector", "target").agg(F.count_if(F.col("good_at").isNull() | (F.col("started_at") > F.col("good_at"))).alias("since"))


def scope_counts(scopes_: DataFrame) -> DataFrame:
    """run_id, scopes, reconciled, codes: how many scopes of a run were reconciled, and the codes of those that failed."""
    return scopes_.groupBy("run_id").agg(F.count("*").alias("scopes"), F.count_if("reconciled").alias("reconciled"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def health(runs: DataFrame) -> DataFrame:
    """One row: whether anything was ever collected, whether anything failed last, and the word for both."""
    rows = scopes(runs).agg(F.bool_or(F.col("last_success").isNotNull()).alias("any_success"), F.bool_or(F.col("state") == "failed").alias("any_failed"), F.bool_and(F.col("state") == "succeeded").alias("all_good"))
    return rows.withColumn("health", F.when(~F.coalesce("any_success", F.lit(False)), "never_collected").when(F.col("all_good"), "healthy").when(F.col("any_failed"), "failing").otherwise("degraded"))
