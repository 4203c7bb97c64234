"""Reviews: items from grants, drift against a baseline, decisions and the audit chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def review_items(grants: DataFrame) -> DataFrame:
    """From (target_key, principal_key, evidence): one item for each pair, with the digest of its sorted evidence."""
    return grants.groupBy("target_key", "principal_key").agg(F.array_join(F.array_sort(F.collect_set("evidence")), "\n").alias("e"), F.count("*").alias("grants")).select("target_key", "principal_key", "grants", F.sha2("e", 256).alias("digest"))


def drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """What became of each item since the baseline."""
    a = baseline.select("target_key", "principal_key", F.col("digest").alias("was"))
    both = a.join(current.select("target_key", "principal_key", F.col("digest").alias("is_now")), ["target_key", "principal_key"], "full_outer")
    verdict = F.when(F.col("was").isNull(), "new").when(F.col("is_now").isNull(), "gone").when(F.col("was") == F.col("is_now"), "unchanged").otherwise("changed")
    return both.select("target_key", "principal_key", verdict.alias("drift"))


def snapshot_digest(items: DataFrame, bits: int = 24, fan: int = 4) -> DataFrame:
    """One digest for a set of items in any order, folded level by level over the leading bits of each item's own digest.

    A part of the finest level holds one of 2^24 shares of the items; each level above folds 16 parts into one.
    """
    line = F.concat_ws("|", "target_key", "principal_key", "digest")
    level = items.select(F.sha2(line, 256).alias("d")).withColumn("part", F.conv(F.substring("d", 1, bits // 4), 16, 10).cast("long"))
    while True:
        level = level.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d"))
        if bits <= 0:
            return level.select(F.col("d").alias("digest"))
        bits -= fan
        level = level.withColumn("part", F.shiftright("part", fan))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The decision of each item that no later one supersedes."""
    seat = F.row_number().over(Window.partitionBy("item").orderBy(F.col("decided_at").desc(), F.col("decision_id").desc()))
    return decisions.withColumn("_n", seat).where("_n = 1").drop("_n")


def progress(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """assignment, items, decided, late."""
    rows = items.join(latest_decisions(decisions).select("item", "decided_at"), "item", "left")
    return rows.groupBy("assignment").agg(F.count("*").alias("items"), F.count("decided_at").alias("decided"), F.count_if(F.col("decided_at") > F.col("due_at")).alias("late"))


def chained(entries: DataFrame) -> DataFrame:
    """chain, index, payload, previous, digest: each entry's digest covers its payload and the digest before it.

    A chain is sequential by its nature: it streams through one task in order, which holds its last digest alone.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = None, ""
        for batch in batches:
            previous, digest = [], []
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != chain:
                    chain, last = name, ""
                previous.append(last)
                last = hashlib.sha256(f"{last}\n{payload}".encode()).hexdigest()
                digest.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(previous, pa.string()), pa.array(digest, pa.string())], [*batch.schema.names, "previous", "digest"])

    rows = entries.select("chain", F.col("index").cast("long").alias("index"), F.col("payload").cast("string").alias("payload"))
    return rows.repartition("chain").sortWithinPartitions("chain", "index").mapInArrow(link, "chain string, index long, payload string, previous string, digest string")


def broken_links(chain: DataFrame) -> DataFrame:
    """chain, first_broken: where an entry does not follow from the one before it, or was altered."""
    by = Window.partitionBy("chain").orderBy("index")
    rows = chain.withColumns({"_before": F.coalesce(F.lag("digest").over(by), F.lit("")), "_seat": F.row_number().over(by)})
    bad = (F.col("previous") != F.col("_before")) | (F.col("index") != F.col("_seat")) | (F.col("digest") != F.sha2(F.concat_ws("\n", "previous", "payload"), 256))
    return rows.where(bad).groupBy("chain").agg(F.min("index").alias("first_broken"))


def preconditions(planned: DataFrame, current: DataFrame) -> DataFrame:
    """For planned changes (key, digest): whether the state they were made for still holds."""
    rows = planned.join(current.select("key", F.col("digest").alias("is_now"), F.lit(True).alias("seen")), "key", "left")
    outcome = F.when(F.col("seen").isNull(), "unobserved").when(F.col("is_now").isNull(), "missing").when(F.col("is_now") == F.col("digest"), "satisfied").otherwise("changed")
    return rows.select("key", outcome.alias("outcome"))


def uncovered(decisions: DataFrame, plans: DataFrame) -> DataFrame:
    """Decisions to remove that no plan covers yet."""
    return decisions.where("decision = 'remove'").join(plans.select("item"), "item", "left_anti")
