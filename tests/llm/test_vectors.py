"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from cohortline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, _x array<long>, _vector string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, None, 7, 8, [9], "x") for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def dense(vectors, dims):
    """(x by position, n, mean, falling eigenvalues, eigenvectors) of the usable vectors."""
    usable = {i: v for i, v in enumerate(vectors) if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)}
    x = {i: np.floor(256 * np.array(v, dtype="f4").astype(float)).astype(int) for i, v in usable.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, len(fit), fit.sum(axis=0), values[::-1], vectors[:, ::-1]


def check(spark, vectors, dims, count, separate=True):
    got = whitening.whiten(table(spark, vectors)).collect()
    x, n, sums, values, axes = dense(vectors, dims)
    assert sorted((r.vec_id, r.component) for r in got) == [(i, k + 1) for i in sorted(x) for k in range(count)]
    coordinates = {}
    for r in got:
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - sums) ** 2).sum())
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
        coordinates.setdefault(r.component, {})[r.vec_id] = r.whitened
    for k in range(count if separate else 0):
        expected = np.array([(x[i] - sums / n) @ axes[:, k] / math.sqrt(values[k]) for i in sorted(x)])
        found = np.array([coordinates[k + 1][i] for i in sorted(x)])
        assert min(abs(expected - found).max(), abs(expected + found).max()) < 1e-8
    return got


def test_whitening_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 12)) * np.linspace(1, 0.2, 12) + rng.standard_normal(12)).tolist()
    awkward = [None, [], [1.0] * 11, [0.5] * 11 + [None], [0.5] * 11 + [float("nan")], [0.5] * 11 + [float("inf")], [-0.0] * 12, vectors[3], vectors[3]]
    check(spark, vectors + awkward, 12, 4)


def test_equal_deviations_are_all_found(spark):
    """A chain of steps finds one vector of each eigenvalue; here the largest has three, and there are rows with every sign."""
    corners = [[a, b, c, d / 8, e / 16, f / 16] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1) for d in (-1, 1) for e in (-1, 1) for f in (-1, 1)]
    got = check(spark, [[float(v) for v in row] for row in corners], 6, 4, separate=False)
    assert sorted(round(r.explained, 6) for r in got if r.vec_id == 0)[1:] == [round(got[0].explained, 6)] * 3


def test_fewer_directions_than_components(spark):
    check(spark, [[i / 256, 2 * i / 256, 0.0, 3.0] for i in range(20)], 4, 1)
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, [None])).count() == 0


def test_wide_entries(spark):
    """Sums beyond a long are exact; a deviation beyond one is missing."""
    vectors = [[1e30, 1.0], [-1e30, 2.0], [3.0, 4.0], [5.0, 1e4]]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(table(spark, vectors)).collect()}
    assert got[0, 1].deviation is None and got[0, 1].n == 4 and got[0, 1].identity_error < 1e-6


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[1 << 40, 3], [-(1 << 40) + 1, 5]], dtype="i8")
    sums = [1, 8]
    assert whitening._deviations(x, 1, sums) == [None, None]
    x = np.array([[1 << 30, 3], [-(1 << 30) + 1, 5]], dtype="i8")
    assert list(whitening._deviations(x, 2, sums)) == [sum((2 * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
