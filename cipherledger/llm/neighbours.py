"""Nearest neighbours by inner product: a block matrix join over int8 tiles.

Vectors are quantised to int8 by a scale of their own. A tile's products are exact in float; with the quantisation
errors they bound the true product from both sides. Pairs whose upper bound reaches the query's k-th lower bound are
computed again from the original vectors in double precision, and heaps keep the best. Nothing is lost: recall is 1.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.llm import vectors

TILE = 2048
#: Components of surviving pairs that are computed again at once: many ties take time, not memory.
SURVIVORS = 1 << 20


@dataclass
class Quantised:
    """Original vectors, their int8 values and scales, and the norms of vector, quantised vector and difference."""

    ids: np.ndarray
    exact: np.ndarray
    small: np.ndarray
    scale: np.ndarray
    norm: np.ndarray
    small_norm: np.ndarray
    error: np.ndarray


def quantise(ids: np.ndarray, exact: np.ndarray) -> Quantised:
    scale = np.maximum(np.abs(exact).max(axis=1) / 127, np.finfo(np.float64).tiny)
    small = np.rint(exact / scale[:, None]).astype(np.int8)
    back = small * scale[:, None]
    # norms a little too long, so that rounding can't make a bound too tight
    lengths = [np.sqrt((x**2).sum(axis=1)) * (1 + 1e-9) for x in (exact, back, exact - back)]
    return Quantised(ids, exact, small, scale, *lengths)


def best(block: Quantised, queries: Quantised, k: int) -> list[list[tuple[float, int]]]:
    """The k nearest of a block for each query as a heap of (score, -vec_id), its own id left out."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
    reached = np.full(len(queries.ids), -np.inf)
    whole = np.float32 if queries.small.shape[1] * 127**2 < 2**24 else np.float64
    left = queries.small.astype(whole)
    step = max(1, SURVIVORS // queries.small.shape[1])
    for at in range(0, len(block.ids), TILE):
        part = slice(at, at + TILE)
        product = (left @ block.small[part].astype(whole).T).astype(np.float64)
        product *= queries.scale[:, None] * block.scale[part]
        slack = queries.error[:, None] * block.norm[part] + queries.small_norm[:, None] * block.error[part]
        slack += 1e-12 * queries.norm[:, None] * block.norm[part]
        own = queries.ids[:, None] == block.ids[part]
        lower = np.where(own, -np.inf, product - slack)
        if lower.shape[1] >= k:
            reached = np.maximum(reached, np.partition(lower, -k, axis=1)[:, -k])
        rows, columns = np.nonzero((product + slack >= reached[:, None]) & ~own)
        for some in range(0, len(rows), step):
            row, column = rows[some : some + step], columns[some : some + step]
            scores = (queries.exact[row] * block.exact[part][column]).sum(axis=1)
            for i, score, vec_id in zip(row.tolist(), scores.tolist(), block.ids[part][column].tolist(), strict=True):
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec_id))
                elif (score, -vec_id) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec_id))
        # a computed score may be off its bound by rounding: stay just below it
        full = [i for i, h in enumerate(heaps) if len(h) == k]
        if full:
            sure = np.array([heaps[i][0][0] for i in full])
            reached[full] = np.maximum(reached[full], sure - 1e-12 * (1 + np.abs(sure)))
    return heaps


def nearest(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k candidates of the largest inner product, in double precision.

    Ties go to the smaller vec_id; a query's own id is no candidate. Rows without an id, and vectors that are null,
    empty, all zero or hold null or non-finite components, take no part. Repeated candidate rows are candidates each; a
    repeated query id is asked once, with its smallest vector.
    """
    def taking_part(rows: DataFrame) -> DataFrame:
        return vectors.usable(rows).where(F.exists("vector", lambda x: x != 0))

    def find(block: Quantised, asked: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        rows = [
            (query_id, -vec_id, score)
            for query_id, heap in zip(asked[0].tolist(), best(block, quantise(*asked), k), strict=True)
            for score, vec_id in heap
        ]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return vectors.search(taking_part(candidates), vectors.once_each(taking_part(queries)), k, quantise, find, "double")
