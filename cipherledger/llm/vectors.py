"""Blocks of vectors, and pairs of query and candidate blocks, for searches of a query set against all rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block; both bound what a task holds.
BLOCK_ROWS = 16_384
QUERY_ROWS = 1_024
#: Small tables are still cut into this many blocks, for the sake of many tasks.
LEAST_BLOCKS = 24


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector, dim`` of the rows that have an id and a vector of finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
        .select(
            F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"),
            F.size("embedding").alias("dim"),
        )
    )


def once_each(queries: DataFrame) -> DataFrame:
    """Of queries that share an id, the one of the smallest vector."""
    return queries.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def few_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of equal rows k at most: a query's k best can hold no more of them, and blocks stay bounded."""
    counted = rows.groupBy("vec_id", "vector", "dim").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    return counted.select("vec_id", "vector", "dim", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def _packed(rows: DataFrame, n_blocks: int, make: Callable[[np.ndarray, np.ndarray], object]) -> DataFrame:
    """``dim, block, held``: what ``make`` makes of the ids and vectors of each block."""
    def pack(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("vec_id", kind="stable")
        made = make(held["vec_id"].to_numpy(np.int64), np.stack(held["vector"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "held": [pickle.dumps(made)]})

    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n_blocks)).cast("int").alias("block")
    return rows.select("*", block).groupBy("dim", "block").applyInPandas(pack, "dim int, block int, held binary")


def search(
    candidates: DataFrame,
    queries: DataFrame,
    k: int,
    make: Callable[[np.ndarray, np.ndarray], object],
    find: Callable[[object, tuple[np.ndarray, np.ndarray]], pd.DataFrame],
    score_type: str,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best, from ``find`` over every pair of blocks.

    ``make`` prepares a candidate block once; ``find`` returns the best of one block for each query of another. Queries
    meet candidates of their own dimension.
    """
    n_blocks = max(LEAST_BLOCKS, -(-candidates.count() // BLOCK_ROWS))
    n_queries = max(1, -(-queries.count() // QUERY_ROWS))
    blocks = _packed(few_copies(candidates, k), n_blocks, make).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    asked = _packed(queries, n_queries, lambda ids, vectors: (ids, vectors)).select(
        "dim", F.col("block").alias("part"), F.col("held").alias("asked"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
    )

    def run(batches):
        for batch in batches:
            for held, own in zip(batch["held"], batch["asked"], strict=True):
                yield find(pickle.loads(held), pickle.loads(own))

    pairs = blocks.join(asked, ["dim", "block", "part"]).select("held", "asked")
    found = pairs.mapInPandas(run, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
