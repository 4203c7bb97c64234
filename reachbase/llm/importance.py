"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k.

Two generative models hash n-grams into buckets: words with pairs of words, and the first four bytes of
each word.  Each is counted over all documents (raw) and over labelled good ones (target).  Buckets that
the target does not hold markedly less often than the raw text share one pooled ratio; the others keep
their own.  A document's log ratio is the sum over its n-grams.  Its log weight is b + a * asinh(ratio), a
monotone scale (a > 0) that tames the long tail of long texts; a and b are fitted by logistic regression on
labelled rows that the target counts have not seen.  Adding standard Gumbel noise, seeded, to the log
weights and keeping the k greatest draws k documents without replacement in proportion to their weights;
k is the number of documents that the weights expect to fit.

Labelled rows are bounded by ``label_rows``; everything else covers all rows.  Cases: null and empty
texts have a ratio of zero; repeated rows draw the same noise and stay or go together, so ties at the k-th
key are all kept; without usable labels every row has weight 0 and stays; an empty table gives no rows;
other input columns pass through unless a result has that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.llm import wordhash
from reachbase.llm.checkpoints import checkpoint
from reachbase.llm.words import unused

BITS = 16
STARTS = 1 << BITS  # buckets below are words and pairs, from here on word starts
PSEUDO = 3.0
#: Buckets whose log ratio is not below this share one ratio.
UNLIKELY = -0.5
LABEL_ROWS = 40_000


def _buckets(w: wordhash.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each n-gram of a chunk."""
    row = np.repeat(np.arange(w.rows), np.diff(w.bounds))
    pairs, pair_row = wordhash.gram_rows(w, 2)
    starts = wordhash.hashes(w.data, w.start, np.minimum(w.stop, w.start + 4))
    cut = np.uint64(64 - BITS)
    return np.concatenate([w.hash >> cut, pairs >> cut, (starts >> cut) + np.uint64(STARTS)]).astype(np.int64), np.concatenate([row, pair_row, row])


def count_ngrams(docs: DataFrame) -> DataFrame:
    """bucket, raw, target from rows of (text, good); one row for each bucket and partition is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * STARTS, np.int64), np.zeros(2 * STARTS, np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for w in wordhash.words(batch.column(0), fold=True):
                bucket, row = _buckets(w)
                raw += np.bincount(bucket, minlength=2 * STARTS)
                target += np.bincount(bucket[good[w.first + row]], minlength=2 * STARTS)
        there = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(raw[there]), pa.array(target[there])], ["bucket", "raw", "target"])

    counted = docs.mapInArrow(count, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray
    scale: tuple[float, float] | None  # b and a; none without usable labels


def ratio_of(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> Column:
    """The sum of the log ratios of a text's n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float32))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shared.value.astype(float)
        for column in batches:
            total = np.zeros(len(column))
            for w in wordhash.words(column, fold=True):
                bucket, row = _buckets(w)
                total[w.first : w.first + w.rows] = np.bincount(row, table[bucket], minlength=w.rows)
            yield pa.array(total)

    return score(F.col(text))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model by Newton steps; columns are scaled first."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    a = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate([w[:1], w[1:] / scale])


def fit(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS, key: str = "doc_id", text: str = "text") -> Model:
    """Counts both models over all documents and fits the scale on the other half of the labelled rows."""
    known = labels.where("quality IS NOT NULL").groupBy(key).agg((F.min("quality") == 1).alias("_q"), F.max(F.coalesce("toxic", F.lit(0))).alias("_t"))
    chosen = known.select(key, (F.col("_q") & (F.col("_t") == 0)).alias("good"), (F.xxhash64(key) % 2 == 0).alias("counted")).orderBy(F.xxhash64(key), key).limit(label_rows)
    texts = docs.select(F.col(key), F.col(text).alias("text"))
    labelled = texts.join(F.broadcast(chosen), key, "left")
    counts = count_ngrams(labelled.select("text", F.coalesce(F.col("good") & F.col("counted"), F.lit(False)).alias("good"))).toArrow()
    raw, target = np.zeros(2 * STARTS), np.zeros(2 * STARTS)
    raw[counts["bucket"].to_numpy()], target[counts["bucket"].to_numpy()] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    ratios = np.zeros(2 * STARTS)
    for part in (slice(0, STARTS), slice(STARTS, None)):
        if target[part].sum():
            ratios[part] = _pooled(raw[part], target[part])
    held = texts.join(F.broadcast(chosen.where(~F.col("counted"))), key)
    rows = held.select("good", ratio_of(held, ratios).alias("ratio")).toArrow()
    good = rows["good"].to_numpy().astype(float)
    if not len(good) or good.min() == good.max():
        return Model(ratios, None)
    b, a = _logistic(np.arcsinh(rows["ratio"].to_numpy())[:, None], good)
    return Model(ratios, (float(b), float(a)) if a > 0 else None)


def _pooled(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket under both models."""
    likely = raw * (target.sum() / raw.sum())
    out = np.log((target + PSEUDO) / (likely + PSEUDO))
    usual = out >= UNLIKELY
    if target[usual].sum():
        out[usual] = np.log(target[usual].sum() / likely[usual].sum())
    return out


def gumbel(seed: int, *columns: str) -> Column:
    """Standard Gumbel noise from a hash of the columns."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def with_keys(docs: DataFrame, model: Model, seed: int, weight: str, drawn: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds the log weight and, with noise, the Gumbel key under these names."""
    b, a = model.scale or (0.0, 0.0)
    out = docs.withColumn(weight, F.lit(b) + F.lit(a) * F.asinh(ratio_of(docs, model.ratios, text)))
    return out.withColumn(drawn, F.col(weight) + gumbel(seed, key, text))


def cut_of(keys: DataFrame, k: int, column: str = "gumbel_key", bins: int = 4096) -> float:
    """The k-th greatest value, by histograms that narrow to the bin that holds it."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while True:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return low
        inside = keys.where(F.col(column).between(low, high))
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width)))
        hist = sorted(((r["b"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()), reverse=True)
        for _, count, lo, hi in hist:
            if k <= count:
                break
            k -= count
        if lo == hi or k == count:
            return lo
        low, high = lo, hi


def select(docs: DataFrame, model: Model, seed: int = 11, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows' keys with kept, and the documents that are kept.

    Only identifiers and keys are written to the checkpoint; the kept documents are scored as they pass.
    """
    weight, drawn = unused(docs, "log_weight", "gumbel_key")
    scored = with_keys(docs, model, seed, weight, drawn, key, text)
    keys = checkpoint(scored.select(key, F.col(weight).alias("log_weight"), F.col(drawn).alias("gumbel_key")))
    if model.scale is None:
        return keys.withColumn("kept", F.lit(True)), docs
    expected = keys.agg(F.sum(1 / (1 + F.exp(-F.col("log_weight"))))).first()[0] or 0.0
    cut = cut_of(keys, round(expected))
    return keys.withColumn("kept", F.col("gumbel_key") >= F.lit(cut)), scored.where(F.col(drawn) >= F.lit(cut)).select(*docs.columns)
