"""Collector batches as a stream: each batch once, late readings counted and not lost."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reachbase.sources import contract


def batches(spark: SparkSession, landing: str, delay: str = "7 days") -> DataFrame:
    """Envelopes that arrive in a folder; a resent batch is dropped while its watermark holds."""
    raw = spark.readStream.schema(contract.ENVELOPE).option("multiLine", True).json(landing)
    return raw.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["run_id", "batch_id"])


def to_tables(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends typed rows, one folder for each micro-batch; writing one again replaces it."""

    def write(rows: DataFrame, epoch: int) -> None:
        seen = contract.observations(rows)
        for name in ("principals", "edges", "servers", "shares", "share_aces", "resources", "ntfs_aces"):
            getattr(contract, name)(seen).write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_OUT = "key string, outcome string, state string, observed_at timestamp"
_HELD = "state string, valid_from timestamp, last_seen_at timestamp"


def _record(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    """One reading after another against the open version of an object, in the order in which they arrive."""
    out = []
    # A key's readings of one trigger may come in several parts, whose order says nothing.
    for part in [pd.concat(list(parts)).sort_values("arrival")]:
        for row in part.itertuples():
            if not held.exists:
                held.update((row.state, row.observed_at, row.observed_at))
                out.append((key[0], "opened", row.state, row.observed_at))
                continue
            state, start, seen = held.get
            if row.state == state:
                held.update((state, min(start, row.observed_at), max(seen, row.observed_at)))
                out.append((key[0], "extended" if row.observed_at >= start else "extended_back", row.state, row.observed_at))
            elif row.observed_at > seen:
                held.update((row.state, row.observed_at, row.observed_at))
                out.append((key[0], "superseded", row.state, row.observed_at))
            else:  # something newer has confirmed another state: counted, not spliced in
                out.append((key[0], "stale", row.state, row.observed_at))
    yield pd.DataFrame(out, columns=["key", "outcome", "state", "observed_at"])


def versions(stream: DataFrame) -> DataFrame:
    """key, outcome, state, observed_at from a stream of (key, state, observed_at, arrival)."""
    return stream.groupBy("key").applyInPandasWithState(_record, _OUT, _HELD, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n: readings by event time, closed once the watermark has passed."""
    held = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return held.select(F.col("window.start").alias("window_start"), "event_type", "n")
