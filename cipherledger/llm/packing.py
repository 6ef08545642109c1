"""Best-fit packing by a grouping genetic algorithm on islands.

Items are dealt at random into blocks of bounded size, and each block is packed by several islands. An individual is a
set of bins. Crossover injects whole well-filled bins of one parent into the other, drops the bins they overlap, and
puts displaced items back by best fit. After each epoch an island's best individual migrates to the next island of its
block. Bins that a block leaves open are packed once more as items, level by level, so the loss is that of one block.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.llm import bpe
from cipherledger.llm.store import written

BLOCK_ITEMS = 2048
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
#: Crossover injects bins filled at least this far; a bin filled less is open, and is packed again on the next level.
WELL_FILLED = 0.98

Bins = list[list[int]]


def pieces(
    docs: DataFrame, path: str, size: int, end_id: int = 0, cache_bytes: int | None = None, run_bytes: int | None = None
) -> DataFrame:
    """``doc_id, piece, start, length, ids``: each document's ids and one end id, cut every ``size`` ids.

    A null or empty text is one piece of the end id alone. Repeated rows give repeated pieces. A worker's memory is
    bounded by ``cache_bytes`` for each of its three caches and ``run_bytes`` of text at once (else those of ``bpe``): with
    less of it, words are worked out more often.
    """
    end = end_id.to_bytes(4, "little")

    def batches(source):
        vocabulary = bpe.load(path)
        vocabulary.bound(cache_bytes)
        for batch in bpe.small(source, vocabulary, run_bytes):
            held = [packed + end for packed in vocabulary.encode(batch.column(1).to_pylist())]
            n_ids = np.array([len(x) // 4 for x in held])
            n_pieces = -(-n_ids // size)
            row = np.repeat(np.arange(len(held)), n_pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = number * size
            length = np.minimum(n_ids[row] - start, size)
            # pieces follow each other as ids do: offsets alone cut them
            offsets = np.append(0, 4 * np.cumsum(length)).astype(np.int64)
            data = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(held))]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), data.cast(pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, piece int, start long, length long, ids binary")


# ---- one block


def best_fit(order: list[int], lengths: list[int], capacity: int, bins: Bins) -> Bins:
    """Put items, in the given order, each into the fullest bin that still holds it."""
    free = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for item in order:
        at = bisect.bisect_left(free, (lengths[item], -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(item)
        else:
            room, k = capacity, len(bins)
            bins.append([item])
        if room > lengths[item]:
            bisect.insort(free, (room - lengths[item], k))
    return bins


def fitness(bins: Bins, lengths: list[int]) -> tuple[int, float]:
    """Fewer bins are better, then the more uneven ones, which leave more room together."""
    return -len(bins), sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def crossover(giver: Bins, taker: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """The taker with some of the giver's well-filled bins; what they displace comes back by best fit."""
    good = [b for b in giver if sum(lengths[i] for i in b) >= WELL_FILLED * capacity]
    injected = rng.sample(good, (len(good) + 1) // 2)
    inside = {i for b in injected for i in b}
    kept, displaced = [list(b) for b in injected], []
    for b in taker:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    return best_fit(sorted(displaced, key=lambda i: -lengths[i]), lengths, capacity, kept)


def mutate(bins: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """Empty the least filled bins and a few others; best fit puts their items back."""
    ranked = sorted(bins, key=lambda b: sum(lengths[i] for i in b))
    gone = ranked[:2] + rng.sample(ranked[2:], min(len(ranked[2:]), 8))
    marked = {id(b) for b in gone}
    rest = [list(b) for b in bins if id(b) not in marked]
    return best_fit(sorted((i for b in gone for i in b), key=lambda i: -lengths[i]), lengths, capacity, rest)


def evolve(lengths: list[int], capacity: int, seeds: list[Bins], rng: random.Random) -> Bins:
    """The best individual after some generations; stops where no fewer bins can hold the items."""
    least = -(-sum(lengths) // capacity)
    everyone = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    population = [*seeds] or [best_fit(everyone, lengths, capacity, [])]
    while len(population) < POPULATION and len(min(population, key=len)) > least:
        blurred = sorted(everyone, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0))
        population.append(best_fit(blurred, lengths, capacity, []))
    for _ in range(GENERATIONS):
        population.sort(key=lambda b: fitness(b, lengths), reverse=True)
        if len(population[0]) <= least:
            break
        giver, taker = rng.sample(population, 2)
        child = mutate(crossover(giver, taker, lengths, capacity, rng), lengths, capacity, rng)
        population[-1] = child
    return max(population, key=lambda b: fitness(b, lengths))


def to_bins(genes: list[int]) -> Bins:
    bins: dict[int, list[int]] = {}
    for item, k in enumerate(genes):
        bins.setdefault(k, []).append(item)
    return list(bins.values())


def to_genes(bins: Bins, n: int) -> list[int]:
    genes = [0] * n
    for k, b in enumerate(bins):
        for item in b:
            genes[item] = k
    return genes


# ---- all blocks


def _epoch(islands: DataFrame, capacity: int, epoch: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            genes = []
            for row in batch.itertuples():
                lengths = [int(x) for x in row.lengths]
                seeds = [to_bins(list(g)) for g in (row.genes, row.migrant) if g is not None]
                rng = random.Random((row.block * ISLANDS + row.island) * EPOCHS + epoch)
                genes.append(to_genes(evolve(lengths, capacity, seeds, rng), len(lengths)))
            yield batch.assign(genes=genes, migrant=None)

    return islands.mapInPandas(run, islands.schema)


def _blocks(items: DataFrame, capacity: int, n_blocks: int, level: int) -> DataFrame:
    """``item, length, sequence_id, offset`` of every item."""
    islands = (
        items.groupBy(F.pmod(F.xxhash64("item"), F.lit(n_blocks)).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("length", "item")), asc=False).alias("held"))
        .select(
            "block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"),
            F.col("held.item").alias("items"), F.col("held.length").alias("lengths"),
            F.lit(None).cast("array<int>").alias("genes"), F.lit(None).cast("array<int>").alias("migrant"),
        )
        .repartition(n_blocks * ISLANDS, "block", "island")
    )
    for epoch in range(EPOCHS):
        if epoch:
            elite = islands.select(
                "block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("genes").alias("migrant")
            )
            islands = islands.drop("migrant").join(elite, ["block", "island"]).select(*islands.columns)
        islands = written(_epoch(islands, capacity, epoch))
    best = islands.groupBy("block").agg(
        F.min_by(F.struct("items", "lengths", "genes"), F.struct(F.array_max("genes"), "island")).alias("best")
    )

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                held = pd.DataFrame({"item": row.items, "length": row.lengths, "bin": row.genes})
                held["offset"] = held.groupby("bin")["length"].cumsum() - held["length"]
                # a hash may deal a block more items than BLOCK_ITEMS, never a million
                held["sequence_id"] = held["bin"].astype("int64") + (row.block << 20) + (level << 56)
                yield held[["item", "length", "sequence_id", "offset"]]

    return best.select("block", "best.*").mapInPandas(lay_out, "item long, length long, sequence_id long, offset long")


def _levels(items: DataFrame, capacity: int, level: int = 0) -> DataFrame:
    """Blocks, then what they leave open as items of the next level, until a level saves nothing."""
    n = items.count()
    n_blocks = max(1, -(-n // BLOCK_ITEMS))
    placed = written(_blocks(items, capacity, n_blocks, level))
    if n_blocks == 1:
        return placed
    bins = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"))
    if bins.count() == n:
        return placed
    left_open = written(bins.where(F.col("length") < WELL_FILLED * capacity).withColumnRenamed("sequence_id", "item"))
    again = _levels(left_open, capacity, level + 1).select(
        F.col("item").alias("sequence_id"), F.col("sequence_id").alias("moved"), F.col("offset").alias("base")
    )
    return placed.join(again, "sequence_id", "left").select(
        "item", "length", F.coalesce("moved", "sequence_id").alias("sequence_id"),
        (F.coalesce("base", F.lit(0)) + F.col("offset")).alias("offset"),
    )


def pack(pieces: DataFrame, capacity: int, batch_rows: int | None = None) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; pieces of a sequence follow each other without gaps.

    ``pieces`` needs a ``length``; other columns are kept (own ``sequence_id`` and ``offset`` are replaced). Rows whose
    length is null, below 1 or above the capacity get null places. Ties and repeated rows are items like any other.
    While ``pieces`` is worked out, ``batch_rows`` bounds the rows that go to a Python worker at once.
    """
    own = pieces.drop("sequence_id", "offset")
    item = "_item"
    while item in map(str.lower, own.columns):
        item += "_"
    numbered = written(own.withColumn(item, F.monotonically_increasing_id()), batch_rows)
    fits = numbered.where(F.col("length").between(1, capacity))
    placed = _levels(fits.select(F.col(item).alias("item"), F.col("length").cast("long")), capacity)
    places = placed.select(F.col("item").alias(item), "sequence_id", "offset")
    return numbered.join(places, item, "left").select(*own.columns, "sequence_id", "offset")
