"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers, and the scatter is summed over entries less a whole centre, so the sums of all tasks are
exact and don't depend on how rows are dealt. The scatter (one small square matrix a dimension, whatever the number of
rows) is factored with pivots into a tall triangle; rotating the triangle's columns against each other until they are
orthogonal leaves eigenvalues as their squared norms and eigenvectors as their directions, without ever squaring again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries are kept in steps of 1 / SCALE and moved by SHIFT.
SCALE = 64
SHIFT = 1_000_000
#: Entries beyond this have no exact whole number in a double; their rows take no part.
LARGEST = 2.0**40
#: Bytes of output that one Arrow batch may hold.
BATCH_BYTES = 8_000_000
#: What is left of a dimension's variance below this part of it is rounding.
NO_VARIANCE = 1e-13
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, x``: entries as whole numbers, of rows whose vector is finite, not empty, and of no entry beyond LARGEST."""
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("long"),
        F.size("embedding").alias("dim"),
        F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"),
    )


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, row numbers and whole entries of a batch, for each dimension in it."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        own = batch.column("x").take(pa.array(rows)) if len(rows) < len(dims) else batch.column("x")
        yield dim, rows, own.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Rows ``dim, i, line`` summed by dimension and line: a matrix for each dimension.

    There are as many lines as dimensions, however many tasks and rows there were.
    """
    def add(lines: pd.Series) -> bytes:
        return np.sum([np.frombuffer(x) for x in lines], axis=0).tobytes()

    def total(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "i": [key[1]], "line": [add(held["line"])]})

    lines = parts.groupBy("dim", "i").applyInPandas(total, "dim int, i int, line binary").collect()
    out: dict[int, dict[int, np.ndarray]] = {}
    for row in lines:
        out.setdefault(row["dim"], {})[row["i"]] = np.frombuffer(row["line"])
    return {dim: np.stack([by_line[i] for i in range(len(by_line))]) for dim, by_line in out.items()}


def products(rows: DataFrame, factor) -> dict[int, np.ndarray]:
    """``factor(dim, x)`` times itself, summed over all rows, with its column sums as last line and the number of rows.

    A task keeps one matrix a dimension and gives it out once.
    """
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in matrices(batch):
                made = factor(dim, x)
                own = np.vstack([made.T @ made, made.sum(axis=0)])
                held[dim] = held[dim] + own if dim in held else own
        for dim, matrix in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([dim] * len(matrix), pa.int32()), pa.array(range(len(matrix)), pa.int32()),
                    pa.array([line.tobytes() for line in matrix], pa.binary()),
                ],
                ["dim", "i", "line"],
            )

    return summed(rows.mapInArrow(run, "dim int, i int, line binary"))


def sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of rows and exact sums of their entries, for each dimension."""
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in matrices(batch):
                n, total = held.get(dim, (0, 0))
                held[dim] = (n + len(x), total + x.sum(axis=0))
        for dim, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))],
                ["dim", "n", "total"],
            )

    parts = rows.mapInArrow(run, "dim int, n long, total array<long>").select("dim", "n", F.posexplode("total"))
    # wide enough for any number of rows
    added = parts.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for row in added.collect():
        out.setdefault(row["dim"], (row["n"], {}))[1][row["pos"]] = int(row["total"])
    return {dim: (n, [by_place[i] for i in range(dim)]) for dim, (n, by_place) in out.items()}


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """``G`` of full column rank with ``G @ G.T`` = matrix: its rows, in the order of the pivots, are a lower triangle."""
    size = len(matrix)
    left = np.array(matrix, dtype=np.float64)
    factor = np.zeros((size, size))
    free = np.ones(size, dtype=bool)
    least = NO_VARIANCE * left.diagonal().copy()
    for column in range(size):
        diagonal = np.where(free & (left.diagonal() > least), left.diagonal(), 0.0)
        pivot = int(diagonal.argmax())
        if diagonal[pivot] <= 0:
            return factor[:, :column]
        factor[:, column] = np.where(free, left[:, pivot], 0.0) / np.sqrt(diagonal[pivot])
        left -= np.outer(factor[:, column], factor[:, column])
        free[pivot] = False
    return factor


def rotated(factor: np.ndarray, turns: int = 60) -> np.ndarray:
    """The factor's columns, turned against each other two by two until all are orthogonal."""
    columns = np.array(factor)
    count = columns.shape[1]
    if count < 2:
        return columns
    seats = list(range(count + count % 2))  # every pair meets once in a sweep, disjoint pairs at a time
    for _ in range(turns):
        largest = 0.0
        for _ in range(len(seats) - 1):
            pairs = [(a, b) for a, b in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2 :])) if max(a, b) < count]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            a, b = np.array(pairs).T
            p, q = columns[:, a], columns[:, b]
            pp, qq, pq = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            bound = np.sqrt(pp * qq)
            off = np.divide(np.abs(pq), bound, out=np.zeros_like(pq), where=bound > 0)
            largest = max(largest, float(off.max()))
            turn = off > 1e-16
            ratio = np.divide(qq - pp, 2 * pq, out=np.zeros_like(pq), where=turn & (pq != 0))
            tangent = np.where(ratio >= 0, 1.0, -1.0) / (np.abs(ratio) + np.hypot(1.0, ratio))
            tangent = np.where(turn & (pq != 0), tangent, 0.0)
            cosine = 1 / np.hypot(1.0, tangent)
            columns[:, a], columns[:, b] = cosine * p - tangent * cosine * q, tangent * cosine * p + cosine * q
        if largest < 1e-15:
            break
    return columns


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a scatter by size, and unit eigenvectors as columns; as many as its rank."""
    columns = rotated(pivoted_cholesky(matrix))
    values = (columns * columns).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > 0]
    return values[order], columns[:, order] / np.sqrt(values[order])


def whiten(vectors: DataFrame, n_components: int = 32) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component.

    ``deviation`` is the exact sum over dimensions of (n x - S)^2, null where it fits no long. Components are numbered from
    1 by falling variance; where the rows span fewer than ``n_components`` directions there are only so many. Rows without
    variance (a single row, all rows equal) and an empty table give none. Vectors of different length are fitted apart;
    repeated rows and null ids count and come back as they are; other columns are left out.
    """
    rows = whole(vectors)
    fits = {}
    for dim, (n, total) in sums(rows).items():
        centre = [round(t / n) if abs(t) < 2**53 else t // n for t in total]
        fits[dim] = {"n": n, "total": total, "centre": np.array(centre, dtype=np.int64)}
    if not fits:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    centres = {dim: fit["centre"] for dim, fit in fits.items()}
    for dim, sums_of in products(rows, lambda dim, x: (x - centres[dim]).astype(np.float64)).items():
        fit = fits[dim]
        n = fit["n"]
        # what the whole centre leaves of the mean; at most half a step
        rest = np.array([float(t - n * int(c)) for t, c in zip(fit["total"], fit["centre"], strict=True)])
        covariance = (sums_of[:-1] - np.outer(rest, rest) / n) / n
        values, components = eigen(covariance)
        kept = min(n_components, len(values))
        fit["rest"], fit["values"], fit["components"] = rest / n, values[:kept], components[:, :kept]
        trace = float(np.trace(covariance))
        fit["explained"] = values[:kept] / trace if kept else values[:kept]
    projection = {
        dim: (fit["centre"], fit["rest"], fit["components"] / np.sqrt(fit["values"])) for dim, fit in fits.items()
    }

    def projected(dim: int, x: np.ndarray) -> np.ndarray:
        centre, rest, turn = projection[dim]
        return ((x - centre).astype(np.float64) - rest) @ turn

    spread = products(rows, projected)
    error = 0.0
    for dim, fit in fits.items():
        if len(fit["values"]):
            mean = spread[dim][-1] / fit["n"]
            found = spread[dim][:-1] / fit["n"] - np.outer(mean, mean)
            error = max(error, float(np.abs(found - np.eye(len(found))).max()))
    exact = {dim: (fit["n"], [fit["n"] * int(c) - t for c, t in zip(fit["centre"], fit["total"], strict=True)]) for dim, fit in fits.items()}
    explained = {dim: fit["explained"] for dim, fit in fits.items()}

    def give(batches):
        for batch in batches:
            for dim, places, x in matrices(batch):
                kept = len(explained[dim])
                step = max(1, BATCH_BYTES // (56 * max(kept, dim)))
                ids = batch.column("vec_id").take(pa.array(places))
                for at in range(0, len(x) if kept else 0, step):
                    some = x[at : at + step]
                    near = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(at, near).take(pa.array(np.repeat(np.arange(near), kept))),
                            pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), near)),
                            pa.array(np.full(near * kept, exact[dim][0], dtype=np.int64)),
                            deviations(some - centres[dim], *exact[dim]).take(pa.array(np.repeat(np.arange(near), kept))),
                            pa.array(projected(dim, some).ravel()),
                            pa.array(np.tile(explained[dim], near)),
                            pa.array(np.full(near * kept, error)),
                        ],
                        COLUMNS,
                    )

    return rows.mapInArrow(give, SCHEMA)


def deviations(off: np.ndarray, n: int, shift: list[int]) -> pa.Array:
    """Exact sums of (n * off + shift)^2 over each row; null where a sum fits no long."""
    rough = ((n * off.astype(np.float64) + np.array(shift, dtype=np.float64)) ** 2).sum(axis=1)
    fits = rough < 2.0**62
    out = np.zeros(len(off), dtype=np.int64)
    if fits.any():
        # every term is below 2^31 then, hence so is its whole number
        terms = n * off[fits] + np.array([s if abs(s) < 2**62 else 0 for s in shift], dtype=np.int64)
        out[fits] = (terms * terms).sum(axis=1)
    return pa.array(out, mask=~fits)
