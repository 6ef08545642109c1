"""Exact top-k by inner product over integer vectors: best-first search in M-trees.

Inner products become distances by one more coordinate that brings all vectors of a block to the same norm; the nearest
are then those of the largest product. A tree has pages of entries: a routing vector, its covering radius and its
distance to the page's own routing vector. The triangle inequality over that stored distance rules entries out before
their distance is computed; pages are visited by the best product they may still hold, until none beats the k-th.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cipherledger.llm import vectors

PAGE = 256
FAN_OUT = 16
SCALE = 1024


@dataclass
class Page:
    """Entries of one node: their vectors, covering radii, distances to the parent's vector, and pages below (or none)."""

    at: np.ndarray
    radius: np.ndarray
    to_parent: np.ndarray
    below: list[int] | None


@dataclass
class Tree:
    ids: np.ndarray
    values: np.ndarray
    lifted: np.ndarray
    largest: float
    pages: list[Page]
    root: int


def build(ids: np.ndarray, values: np.ndarray) -> Tree:
    """A tree over integer vectors, loaded from above: each page's vectors go to the nearest of a few routing vectors."""
    norms = (values.astype(np.float64) ** 2).sum(axis=1)
    largest = float(norms.max())
    lifted = np.column_stack([values, np.sqrt(largest - norms)])
    rng, pages = np.random.default_rng(len(ids)), []

    def apart(at: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((lifted[at] - lifted[centre]) ** 2).sum(axis=1))

    def load(at: np.ndarray, parent: int | None) -> int:
        def to_parent(some: np.ndarray) -> np.ndarray:
            return np.zeros(len(some)) if parent is None else apart(some, parent)

        if len(at) <= PAGE:
            pages.append(Page(at, np.zeros(len(at)), to_parent(at), None))
            return len(pages) - 1
        centres = np.sort(rng.choice(at, FAN_OUT, replace=False))
        nearest = np.argmin([apart(at, c) for c in centres], axis=0)
        groups = [at[nearest == g] for g in range(FAN_OUT)]
        if max(map(len, groups)) > 0.9 * len(at):  # many equal vectors: any even split is as good
            groups = np.array_split(at, FAN_OUT)
            centres = np.array([g[0] for g in groups])
        filled = [(c, g) for c, g in zip(centres, groups, strict=True) if len(g)]
        below = [load(g, c) for c, g in filled]
        routing = np.array([c for c, _ in filled])
        pages.append(Page(routing, np.array([apart(g, c).max() for c, g in filled]), to_parent(routing), below))
        return len(pages) - 1

    root = load(np.arange(len(ids)), None)
    return Tree(ids, values, lifted, largest, pages, root)


def best(tree: Tree, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best of a tree as (score, -vec_id), the query's own id left out."""
    size = float((query.astype(np.float64) ** 2).sum())
    lifted = np.append(query.astype(np.float64), 0.0)
    slack = 0.5 + 1e-9 * (size + tree.largest)  # scores are whole numbers; rounding stays far below

    def ceiling(distance: np.ndarray) -> np.ndarray:
        """The largest product at that distance or more."""
        return (size + tree.largest - np.maximum(distance, 0) ** 2) / 2 + slack

    found: list[tuple[int, int]] = []
    heap = [(-np.inf, tree.root, None)]
    while heap:
        bound, number, from_parent = heapq.heappop(heap)
        if len(found) == k and -bound < found[0][0]:
            break
        page = tree.pages[number]
        keep = np.arange(len(page.at))
        if from_parent is not None and len(found) == k:
            unseen = np.abs(from_parent - page.to_parent) - page.radius
            keep = keep[ceiling(unseen) >= found[0][0]]
        at = page.at[keep]
        if page.below is None:
            scores = tree.values[at] @ query
            if len(found) == k:
                good = scores >= found[0][0]
                at, scores = at[good], scores[good]
            for score, vec_id in zip(scores.tolist(), tree.ids[at].tolist(), strict=True):
                if vec_id != query_id:
                    if len(found) < k:
                        heapq.heappush(found, (score, -vec_id))
                    else:
                        heapq.heappushpop(found, (score, -vec_id))
        else:
            distance = np.sqrt(((tree.lifted[at] - lifted) ** 2).sum(axis=1))
            tops = ceiling(distance - page.radius[keep])
            for i, d, top in zip(keep.tolist(), distance.tolist(), tops.tolist(), strict=True):
                if len(found) < k or top >= found[0][0]:
                    heapq.heappush(heap, (-top, page.below[i], d))
    return found


def whole(values: np.ndarray) -> np.ndarray:
    """Components as whole numbers."""
    return np.floor(SCALE * values).astype(np.int64)


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k candidates of the largest integer inner product.

    Components are floor(1024 x). Ties go to the smaller vec_id; a query's own id is no candidate. Rows without an id,
    and vectors that are null, empty or hold null or non-finite components, take no part. Repeated candidate rows are
    candidates each; a repeated query id is asked once, with its smallest vector. Scores must fit a long.
    """
    def find(tree: Tree, asked: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        rows = [
            (query_id, -vec_id, score)
            for query_id, query in zip(asked[0].tolist(), whole(asked[1]), strict=True)
            for score, vec_id in best(tree, query_id, query, k)
        ]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return vectors.search(
        vectors.usable(candidates), vectors.once_each(vectors.usable(queries)), k,
        lambda ids, values: build(ids, whole(values)), find, "long",
    )
