"""The queries of this package and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from reachbase.llm import byte_bpe, fingerprints, importance, jaccard_join, mixing, periodic_runs, pii, quality_rules, recompression, sentence_pieces, spelling, suffix_dedup, url_rules
from reachbase.llm.words import whole


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return importance.select(docs, importance.fit(docs, labels))[0]


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    rules = quality_rules.fit(docs, labels)
    judged = quality_rules.apply_rules(quality_rules.with_stats(docs.select("doc_id", "text")), rules)
    return judged.select("doc_id", *quality_rules.STATS, "base_failed", "kept", "rule_no")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", whole(F.col("text")).alias("text"))
    rows = fingerprints.with_next(docs, fingerprints.with_fingerprint, ["text", "fingerprint"])
    rows = rows.withColumn("edited", fingerprints.edited_text(F.col("text"), F.col("next_text")))
    rows = fingerprints.with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(rows, ranks, public_tokenizers.PATTERN)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.deal(_read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "tokens", "pass", "block")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = recompression.dedup(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, found="n_found")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"), one_in=spelling.EDITED)


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentence_pieces.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    rows = sentence_pieces.decode(rows, model)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digests(periodic_runs.collapse(periodic_runs.tiled(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_suffix_dedup, op3_quality_rules, op4_url_filters, op5_fingerprints, op6_byte_bpe, op7_mixing, op8_substring_dedup, op9_pii, op10_ngram_jaccard_join, op11_spelling_variants, op12_sentence_pieces, op13_periodic_runs)
}
ORACLE_SQL: dict[str, str] = {"op4_url_filters": url_rules.ORACLE_SQL, "op11_spelling_variants": spelling.ORACLE_SQL}
