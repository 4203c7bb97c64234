"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.llm.checkpoints import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, root); nodes without an edge have no row.

    Each round sends every node to the least of itself and its neighbours and joins what meets, so long
    chains shrink by a share each time; what remains of the edges is written out between rounds.
    """
    live = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to")))
        moves.append(move)
        a, b = move.select(F.col("node").alias("a"), F.col("to").alias("ta")), move.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        met = live.join(a, "a").join(b, "b").where("ta <> tb")
        live = checkpoint(met.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        out = out.join(move.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return checkpoint(out)
