import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioseek.llm.whitening import deviations, numerators, principal_components, refine_eigenvectors, whiten

WIDE = np.longdouble


def rotated(values, seed=0):
    """A symmetric matrix with these eigenvalues, and its vectors, in extended precision."""
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(len(values), len(values))).astype(WIDE)
    for i in range(len(values)):  # Gram-Schmidt, twice
        for _ in range(2):
            q[:, i] -= q[:, :i] @ (q[:, :i].T @ q[:, i])
        q[:, i] /= np.sqrt((q[:, i] ** 2).sum())
    return (q * np.array(values, dtype=WIDE)) @ q.T, q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(3, 1, 40),
        [5, 1 + 1e-9, 1 + 2e-9, 1, 0.5, 1e-3],
        [2, 2, 2, 1, 1, 0.25],
        [7, 7 - 1e-12, 7 - 2e-12, 3, 3 - 1e-7, 3 - 1e-10, 1e-5, 1e-5 - 1e-14],
        [1] * 8,
        np.geomspace(1, 1e-9, 12),
    ],
)
def test_refinement(values):
    a, q = rotated(values)
    _, first = np.linalg.eigh(a.astype(np.float32))
    got, x = refine_eigenvectors(a, first)
    want = -np.sort(-np.array(values, dtype=WIDE))
    top = np.abs(want).max()
    assert np.abs(got - want).max() < 1e-17 * top
    assert np.abs(x.T @ x - np.eye(len(want))).max() < 1e-17
    assert np.abs(a @ x - x * got).max() < 3e-17 * top
    coarse = first[:, ::-1].astype(WIDE)
    assert np.abs(a @ coarse - coarse * want).max() > 1e-9 * top or len(set(values)) == 1
    for i, v in enumerate(want):
        gap = min((abs(v - w) for j, w in enumerate(want) if j != i), default=1)
        if gap > 1e-13:  # rounding of the matrix itself turns a vector by about 1e-18 / gap
            j = np.argmin(np.abs(np.array(values, dtype=WIDE) - v))
            assert 1 - abs(x[:, i] @ q[:, j]) < 1e-17 + (1e-17 * top / gap) ** 2


def test_components_without_variance():
    a, _ = rotated([4, 2, 0, 0, 0])
    value, vector = principal_components(a.astype(float), 16)
    assert vector.shape == (5, 2) and np.allclose(value, [4, 2])
    assert principal_components(np.zeros((3, 3)), 16)[0].size == 0


def test_exact_deviations():
    rng = np.random.default_rng(4)
    x = rng.integers(-100, 100, size=(50, 6)) + 1_000_000
    sums = [int(s) for s in x.sum(axis=0)]
    want = [sum((50 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert deviations(numerators(x, 50, sums)) == want
    big = x * 10**12
    found = deviations(numerators(big, 50, [s * 10**12 for s in sums]))
    assert found == [w * 10**24 if w * 10**24 < 1 << 63 else None for w in want]


def plain(rows):
    """Everything at once, from all vectors in one place."""
    fit = np.array(sorted({r for r in rows}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s).astype(float) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:16]
    return n, s, v, e[order], u[:, order]


def test_whitened_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 20)) * np.linspace(2, 0.3, 20)
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(150)] + [(3, vectors[3][1]), (None, vectors[4][1])]
    odd = [(-1, None), (-2, []), (-3, [None] * 20), (-4, [math.nan] * 20), (-5, [math.inf] * 20), (-6, [1.0]), (-7, [1e30] * 20)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    got = whiten(df).collect()
    assert len(got) == 16 * len(vectors) and {r.component for r in got} == set(range(1, 17))
    whole = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v in vectors}
    n, s, v, e, u = plain(whole.values())
    assert {r.n for r in got} == {n} == {400}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    signs = {}
    for r in got:
        x = np.array(whole[r.vec_id], dtype=object)
        assert r.deviation == sum(int(k) ** 2 for k in n * x - s)
        c = r.component - 1
        want = float(((n * x - s).astype(float) / n) @ u[:, c] / math.sqrt(e[c]))
        assert abs(abs(r.whitened) - abs(want)) < 1e-8
        if abs(want) > 1e-6:
            assert signs.setdefault(c, r.whitened * want > 0) == (r.whitened * want > 0)
        assert abs(r.explained - e[c] / np.trace(v)) < 1e-10


def test_empty_and_single(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])] * 3):
        assert whiten(spark.createDataFrame(rows, schema)).collect() == []
    two = whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], schema)).collect()
    assert len(two) == 3 and {round(abs(r.whitened), 9) for r in two} == {1.0} and {r.explained for r in two} == {1.0}
