"""Whitening: eigenvectors against numpy's, exact deviations, odd rows."""

import numpy as np
import pytest

from cipherledger.llm import queries, whitening
from tests.llm.conftest import SF


def plain(vectors, kept=32):
    """x, eigenvalues and eigenvectors by numpy."""
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    centred = x - x.sum(axis=0) / len(x)
    values, turned = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, values[::-1][:kept], turned[:, ::-1][:, :kept], values.sum()


def test_query_by_brute_force(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x, centred, values, turned, trace = plain([r.embedding for r in rows])
    found = queries.op11_whitening(spark, SF).collect()
    assert len(found) == 32 * len(rows)
    table = np.zeros((len(rows), 32))
    place = {r.vec_id: i for i, r in enumerate(rows)}
    deviation = ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)
    for r in found:
        table[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(x) and r.deviation == deviation[place[r.vec_id]] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
    want = centred @ turned / np.sqrt(values)
    signs = np.sign((want * table).sum(axis=0))
    assert np.abs(table - want * signs).max() < 1e-7


@pytest.mark.parametrize("size, rank, spread", [(1, 1, 0), (2, 1, 0), (9, 9, 3), (33, 33, 0), (64, 20, 2), (12, 0, 0)])
def test_eigenvectors(size, rank, spread):
    dice = np.random.default_rng(size)
    data = dice.normal(size=(500, rank)) @ dice.normal(size=(rank, size)) * np.exp(spread * dice.normal(size=size))
    matrix = data.T @ data / 500
    values, turned = whitening.eigen(matrix)
    want = np.linalg.eigvalsh(matrix)[::-1]
    assert len(values) == rank and (np.diff(values) <= 0).all()
    if rank:
        assert np.abs(values - want[:rank]).max() <= 1e-12 * want[0]
        assert np.abs(turned.T @ turned - np.eye(rank)).max() < 1e-12
        assert np.abs(matrix @ turned - turned * values).max() <= 1e-12 * want[0]


def test_small_variances_keep_their_digits():
    scales = np.array([1e6, 1.0, 1e-3])
    values, _ = whitening.eigen(np.diag(scales))
    assert values == pytest.approx(scales, rel=1e-14)


def test_odd_rows(spark, vectors):
    found = whitening.whiten(vectors).collect()
    ids = {r.vec_id for r in found}
    assert None in ids and 0 in ids and 700 in ids and not ids & {200, 300, 400, 600, 900}
    of_two = [r for r in found if r.vec_id in (700, 800)]
    assert {(r.component, r.n) for r in of_two} == {(1, 2)} and sorted(abs(r.whitened) for r in of_two) == pytest.approx([1, 1])
    assert sum(r.vec_id == 3 and r.component == 1 for r in found) == 2
    assert whitening.whiten(vectors.limit(0)).count() == 0
    assert whitening.whiten(vectors.where("vec_id = 700")).count() == 0
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<float>")
    assert whitening.whiten(equal).count() == 0


def test_sums_that_fit_no_long_are_null(spark):
    rows = spark.createDataFrame([(i, [float(i) * 2.0**34, 1.0 * (i % 3)]) for i in range(10)] + [(11, [1e300, 1.0])], "vec_id long, embedding array<double>")
    found = whitening.whiten(rows).collect()
    assert {r.vec_id for r in found} == set(range(10)) and any(r.deviation is None for r in found)
    assert all(abs(r.identity_error) < 1e-6 for r in found)


def test_exact_deviation():
    off = np.array([[3, -4], [2**31, 0]])
    assert whitening.deviations(off, 10, [5, 1]).to_pylist() == [35**2 + 39**2, None]
