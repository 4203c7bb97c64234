"""Cutting lineage through the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs on this machine alone, a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    return folder


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(rows: DataFrame) -> DataFrame:
    """For large tables: a compressed table in the shared folder; what was shuffled for it is deleted once it is written."""
    session = rows.sparkSession
    path = f"{shared_folder(session)}/stored-{uuid.uuid4().hex}"
    before = session.conf.get(_CLEAN_UP)
    session.conf.set(_CLEAN_UP, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        session.conf.set(_CLEAN_UP, before)
    return session.read.schema(rows.schema).parquet(path)


def checkpoint(rows: DataFrame) -> DataFrame:
    """For the small tables of loops: the same.  Spark's own checkpoint computes its rows twice, once to count them and once to write them."""
    return stored(rows)


def discard(rows: DataFrame) -> None:
    """Deletes the files of a stored() table; for tables that only other stored tables were made from."""
    session = rows.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        path = session._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
