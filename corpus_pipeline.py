"""A corpus from raw documents to token ids, in five stages.

Each stage works on all that the one before it kept, and is written as Parquet and read again.  All but the
last return the columns of their input, whatever these are called besides doc_id, text, source and n_chars.
An empty table stays empty through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachbase.llm import byte_bpe, importance, jaccard_join, mixing, pii
from reachbase.llm.checkpoints import stored
from reachbase.llm.words import unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that importance resampling rejects.

    Null and empty texts have no evidence against them and are drawn like others of log ratio 0; repeated rows go or
    stay together; without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.select(docs, importance.fit(docs, labels))[1]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one row of each group of linked ones: of the smallest doc_id, a null one last, and the least text digest under it.

    Rows without a set link with nothing and stay; those with one doc_id and equal text are one document.
    """
    digest, count, held = unused(docs, "_digest", "_rows", "_held")
    linked = jaccard_join.link(docs).where("n_shingles > 0").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n"))
    least = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "n")).alias("x"))
    stays = stored(least.select(F.col("x.doc_id").alias(held), F.col("x.digest").alias(digest), F.col("x.n").alias(count)))
    kept = docs.withColumn(digest, F.sha2("text", 256)).join(stays, digest).where(F.col("doc_id").eqNullSafe(F.col(held)))
    kept = stored(kept.select(*docs.columns, digest, count))
    single, repeated = kept.where(F.col(count) == 1), kept.where(F.col(count) > 1).dropDuplicates(["doc_id", digest])
    bare = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x09-\x0d ]"), F.lit(False)))
    alone, unnamed = bare.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]), bare.where("doc_id IS NULL")
    return single.select(*docs.columns).unionByName(repeated.select(*docs.columns)).unionByName(alone.select(*docs.columns)).unionByName(unnamed.select(*docs.columns))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces private data by pseudonyms of the same format; a null text stays null and has no n_chars."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passes every document once, and those of small sources again as their weight asks for; a null source is one of its own, empty texts pass once."""
    return mixing.deal(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document; none for a null or empty text."""
    ids = byte_bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("PII", private_data), ("mixing sources", mix), ("byte-level BPE", tokens)]
#: Fitted models and hashes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
