"""Cutting the lineage of loops, and picking rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(rows: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder once and reads them from there; Spark's checkpoint would compute them twice.

    The files go when the application ends.
    """
    session = rows.sparkSession
    folder = session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", session.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        session.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    place = session._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(session._jsc.hadoopConfiguration()).deleteOnExit(place)
    return session.read.schema(rows.schema).parquet(path)


#: So many rows of a settled table are sent to all executors, whatever Spark thinks of the size of its files.
BROADCAST_ROWS = 200_000


def broadcast_few(rows: DataFrame) -> DataFrame:
    """For tables of keys that are few in any usual estate: broadcast while they are, else left to Spark."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def first_by(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    seat = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_seat", seat).where(F.col("_seat") <= n).drop("_seat")


def page(rows: DataFrame, order: list[Column], limit: int, after: Column | None = None) -> DataFrame:
    """One row more than the limit, which says whether another page follows."""
    return (rows if after is None else rows.where(after)).orderBy(*order).limit(limit + 1)


def numbered_page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Some rows in order, each with the exact total."""
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", rows.agg(F.count("*")).scalar())


def cursor(*columns: str) -> Column:
    """An opaque mark of a place in an order: base64 of the row's keys as JSON."""
    return F.base64(F.to_json(F.struct(*columns)).cast("binary"))


def cursor_fields(value: Column, schema: str) -> Column:
    return F.from_json(F.unbase64(value).cast("string"), schema)


def iso_instant(t: Column) -> Column:
    """UTC with microseconds."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def canonical_json(*columns: str) -> Column:
    """Fields by name, without spaces, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
