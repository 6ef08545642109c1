"""Sharding by longest processing time: groups of equal texts, largest first, go to the least loaded shard.

Large groups, of which there can be only so many, go through one heap. The others are dealt at random into batches of
bounded size; each batch starts from its share of the large groups' loads and runs a heap of its own, so every batch
levels the shards to within its smallest groups.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.llm.store import written

#: A group is large if it has this part of a shard's fair load; at most shards x LARGE groups are.
LARGE = 1000
BATCH_GROUPS = 20_000
LEAST_BATCHES = 32
#: Bytes that every document counts besides its text.
OVERHEAD = 16
GROUP = ["text_hash", "text_crc32", "size"]


def least_loaded(sizes: list[int], loads: list[float]) -> list[int]:
    """A shard for each size, in the order given; ``loads`` is what the shards hold before."""
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    chosen = []
    for size in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        chosen.append(shard)
    return chosen


def group_shards(groups: DataFrame, n_shards: int) -> DataFrame:
    """Groups (``GROUP`` columns and their ``bytes``) with their shard."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bar = max(1, total // (n_shards * LARGE))
    # at most n_shards * LARGE rows reach the bar, whatever the input
    large = groups.where(F.col("bytes") >= bar).collect()
    large.sort(key=lambda g: (-g["bytes"], g["text_hash"], g["text_crc32"], g["size"]))
    shards = least_loaded([g["bytes"] for g in large], [0.0] * n_shards)
    loads = [0] * n_shards
    for g, shard in zip(large, shards, strict=True):
        loads[shard] += g["bytes"]
    schema = "text_hash long, text_crc32 long, size long, shard int"
    first = spark.createDataFrame([(*(g[c] for c in GROUP), s) for g, s in zip(large, shards, strict=True)], schema)
    small = groups.where(F.col("bytes") < bar)
    rest, n_small = total - sum(loads), small.count()
    n_batches = max(LEAST_BATCHES, -(-n_small // BATCH_GROUPS))

    def deal(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["bytes", *GROUP], ascending=[False, True, True, True])
        share = batch["bytes"].sum() / rest
        batch["shard"] = least_loaded(batch["bytes"].tolist(), [load * share for load in loads])
        return batch[[*GROUP, "shard"]]

    batch = F.pmod(F.xxhash64(*GROUP), F.lit(n_batches)).alias("batch")
    return first.unionByName(small.groupBy(batch).applyInPandas(deal, schema))


def shard(docs: DataFrame, n_shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: equal texts share a shard, and shards hold about as many bytes.

    ``size`` is the text's UTF-8 bytes plus 16; a null text counts as empty. ``slot`` numbers a shard's rows from 0
    without gaps. Every row is placed, repeated ones and those without an id too; other columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    ))
    groups = written(rows.groupBy(*GROUP).agg(F.sum("size").alias("bytes")))
    # a shard's rows are numbered part by part: a group may be too large for one task
    placed = written(rows.join(group_shards(groups, n_shards), GROUP).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("shard", "part").count().select(
        "shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")
    )
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1
    return placed.withColumn("within", within).join(parts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("within")).alias("slot")
    )
