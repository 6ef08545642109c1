"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.llm.store import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its least neighbour."""
    both = edges.union(edges.select("other", "node"))
    least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    return both.where("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("least").alias("other"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
    least = down.groupBy("node").agg(F.min("other").alias("least"))
    moved = down.join(least, "node").where("other > least").select(F.col("other").alias("node"), F.col("least").alias("other"))
    return moved.union(least.select("node", F.col("least").alias("other")))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every linked node but the least of its component; ``links`` has longs ``a`` and ``b``.

    Each turn is written to the shared folder, so its lineage stays short and a lost executor costs no earlier turn.
    """
    edges = written(links.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other")).distinct())
    before = None
    while (state := _state(edges)) != before and state[0]:
        before = state
        edges = written(_small_star(_large_star(edges)).where("node <> other").distinct())
    return edges.select("node", F.col("other").alias("component"))
