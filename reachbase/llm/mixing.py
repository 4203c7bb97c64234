"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations.

A source's weight is its share of all tokens raised to an exponent, normalised.  The exponent is the
greatest one, found by bisection over aggregates of the table of sources, at which the weights reach a
target entropy and no source is passed more often than a limit.  A budget of tokens is then dealt by
weight.  Each source is read in passes; a pass is a seeded permutation of its rows, cut into blocks of
consecutive places; the last pass of a source ends where its share of the budget is used up.

Places are hashes, so the end of the last pass is one number for each source: a histogram of blocks
finds the block that holds it and the rows of that block alone are summed in order.  No source is
gathered in one task.  Tokens are estimated as a quarter of the UTF-8 bytes, rounded up.

Cases: a null source counts as a source of its own; rows without tokens are passed once and use no
budget; repeated rows share a place and are dealt together; an empty table gives no rows; other columns
pass through unless a result has that name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.llm.checkpoints import checkpoint
from reachbase.llm.words import unused

#: Sources up to this number are sent to every executor; more are joined by shuffle.
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Mix:
    """``entropy`` is in nats as a share of the greatest possible; ``most_passes`` limits repetition.

    ``budget_tokens`` None is the least budget that passes every source at least once.
    """

    entropy: float | None = 0.9
    most_passes: float = 2.0
    budget_tokens: int | None = None
    seed: int = 3
    rows_per_block: int = 2_000


def tokens_of(text: Column) -> Column:
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def _bisect(right, low: float, high: float, steps: int) -> tuple[float, float]:
    """Halves [low, high] towards the point where ``right`` turns true."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if right(mid) else (mid, high)
    return low, high


def exponent(sources: DataFrame, mix: Mix, steps: int = 20) -> tuple[float, float, float]:
    """The exponent, the sum of the raised shares and the budget; ``sources`` has one row for each with its tokens > 0.

    Entropy and repetition both fall as the exponent rises to 1.  Where no exponent meets both aims, the
    limit on repetition holds.
    """
    n, total = sources.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return 1.0, 1.0, 0.0
    p = F.col("tokens") / F.lit(float(total))

    def figures(a: float) -> tuple[float, float, float, float]:
        """Sum of raised shares, entropy, passes of the most repeated source, budget."""
        power = F.pow(p, F.lit(a))
        z, plogp, least, most = sources.agg(F.sum(power), F.sum(power * F.log(p)), F.max(F.pow(p, F.lit(a - 1))), F.max(F.pow(p, F.lit(1 - a)))).first()
        budget = mix.budget_tokens or total * z * most
        return z, math.log(z) - a * plogp / z, least * budget / (z * total), budget

    a = 1.0
    if mix.entropy is not None and figures(1.0)[1] < mix.entropy * math.log(n):
        a = _bisect(lambda x: figures(x)[1] < mix.entropy * math.log(n), 0.0, 1.0, steps)[0]
    if a < 1.0 and figures(a)[2] > mix.most_passes:
        a = _bisect(lambda x: figures(x)[2] <= mix.most_passes, a, 1.0, steps)[1]
    z, _, _, budget = figures(a)
    return a, z, budget


def plan(docs: DataFrame, mix: Mix, source: str = "source", text: str = "text") -> DataFrame:
    """One row for each source: tokens, rows, weight, passes (whole ones) and rest (tokens of the last one)."""
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(tokens_of(F.col(text))).alias("tokens"), F.count("*").alias("rows"))
    counts = checkpoint(counts.coalesce(4))
    total = counts.agg(F.sum("tokens")).first()[0] or 1
    a, z, budget = exponent(counts.where("tokens > 0"), mix)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a)) / F.lit(z)).otherwise(0.0)
    quota = F.round(F.col("weight") * F.lit(float(budget))).cast("long")
    if mix.budget_tokens is None:
        quota = F.greatest(quota, "tokens")  # rounding takes no row of the largest source
    planned = counts.withColumns({"weight": weight, "blocks": F.ceil(F.col("rows") / mix.rows_per_block).cast("long")}).withColumn("quota", quota)
    return planned.withColumns({"passes": F.expr("CASE WHEN tokens > 0 THEN quota div tokens ELSE 0 END"), "rest": F.expr("CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END")})


def _place(seed: int, a_pass: Column, *columns: str) -> Column:
    """A row's place in a pass, 0 to 2^53 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), a_pass, *columns), 11)


def _block(place: str, blocks: str) -> Column:
    return F.expr(f"cast(floor({place} / 9007199254740992D * {blocks}) as bigint)")


def deal(docs: DataFrame, mix: Mix = Mix(), source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with tokens, pass and block, one row for each time that a row is passed."""
    columns = [c for c in docs.columns if c not in ("tokens", "pass", "block")]
    planned = checkpoint(plan(docs, mix, source, text))
    small = F.broadcast if planned.count() <= BROADCAST_SOURCES else (lambda x: x)

    ending = planned.where("rest > 0").select("_source", "blocks", "passes", "rest")
    placed = docs.select(F.col(source).alias("_from"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    placed = placed.join(small(ending), F.col("_from").eqNullSafe(F.col("_source")))
    placed = placed.select("_source", tokens_of(F.col("_text")).alias("_tokens"), "blocks", "rest", _place(mix.seed, F.col("passes"), "_key", "_text").alias("_place")).withColumn("_block", _block("_place", "blocks"))
    sums = placed.groupBy("_source", "_block", "rest").agg(F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edge = checkpoint(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where("_before < rest AND _before + _sum >= rest").select("_source", F.col("_block").alias("_edge"), "_before"))
    edge_at = edge.withColumnRenamed("_source", "_s")
    inside = placed.join(small(edge_at), placed["_source"].eqNullSafe(edge_at["_s"]) & (placed["_block"] == edge_at["_edge"]))
    run = Window.partitionBy("_source").orderBy("_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("_to", F.col("_before") + F.sum("_tokens").over(run)).where("_to <= rest").groupBy("_source").agg(F.max("_place").alias("_cut"))
    ends = edge.select(F.col("_source").alias("_s"), F.col("_edge").alias("_floor")).join(last, F.col("_s").eqNullSafe(F.col("_source")), "left").select("_s", "_floor", F.coalesce("_cut", F.lit(-1)).alias("_cut"))

    origin, blocks, passes, floor, cut, place, copy = unused(docs, "_source", "_blocks", "_passes", "_floor", "_cut", "_place", "_pass")
    full = planned.join(ends, F.col("_source").eqNullSafe(F.col("_s")), "left")
    full = checkpoint(full.select(F.col("_source").alias(origin), F.col("blocks").alias(blocks), F.col("passes").alias(passes), F.col("_floor").alias(floor), F.col("_cut").alias(cut)))
    rows = docs.join(small(full), docs[source].eqNullSafe(full[origin])).withColumn(place, _place(mix.seed, F.col(passes), key, text))
    within = (_block(place, blocks) < F.col(floor)) | (F.col(place) <= F.col(cut))
    copies = F.when(tokens_of(F.col(text)) == 0, F.lit(1)).otherwise(F.col(passes) + F.coalesce(within.cast("long"), F.lit(0)))
    rows = rows.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), copies - 1)))
    rows = rows.withColumn(place, _place(mix.seed, F.col(copy), key, text))
    return rows.select(*columns, tokens_of(F.col(text)).alias("tokens"), F.col(copy).alias("pass"), _block(place, blocks).alias("block"))
