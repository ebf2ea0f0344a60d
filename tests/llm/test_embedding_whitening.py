"""Whitening against LAPACK and plain sums, the eigenvalue split on hard matrices, edge cases."""

import numpy as np
import pytest
from folioscope.llm import embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n int"


def symmetric(values, seed=0):
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return basis @ np.diag(values) @ basis.T


@pytest.mark.parametrize(
    "values",
    [[3.0], [2.0, 1.0], [5.0] * 6, [2.0] * 9 + [0.0] * 7, [1.0, -1.0, 0.0], 10.0 ** -np.linspace(0, 12, 40),
     [1 + 1e-9, 1.0, 1 - 1e-9], np.linspace(1, 2, 130), [0.0, 0.0]],
)
def test_divide_and_conquer(values):
    matrix = symmetric(np.array(values))
    found = embedding_whitening.eigen(matrix)
    size, scale = len(matrix), max(np.abs(matrix).max(), 1e-300)
    assert np.allclose(found.values, np.linalg.eigvalsh(matrix)[::-1], atol=1e-13 * scale * size, rtol=0)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(size), atol=1e-13 * size)
    assert np.allclose(matrix @ found.vectors, found.vectors * found.values, atol=1e-13 * scale * size)


def test_polar_factor_is_the_sign():
    values = np.array([4.0, 1e-3, -2.0, -1e-9, 7.0])
    sign = embedding_whitening.polar(symmetric(values))
    assert np.allclose(sign, symmetric(np.sign(values)), atol=1e-6)
    assert np.allclose(sign @ sign, np.eye(5), atol=1e-12)


def sample(n=300, size=24):
    random = np.random.default_rng(4)
    return (random.standard_normal((n, size)) * np.linspace(0.2, 3, size)).astype(np.float32)


def test_matches_plain_whitening(spark):
    vectors = sample()
    rows = [(n, vector.tolist(), "c", 1) for n, vector in enumerate(vectors)] + [(900 + n, vectors[0].tolist(), "c", 1) for n in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = embedding_whitening.whitened(df).orderBy("vec_id", "component").collect()
    x = np.floor(64 * np.array([row[1] for row in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    sums, n = fit.sum(axis=0), len(fit)
    assert n == 300 and len(got) == 500 * 16
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - sums / n) @ axes[:, :16] / np.sqrt(values[:16])
    found = np.array([row.whitened for row in got]).reshape(-1, 16)
    assert np.allclose(found * np.sign((found * want).sum(axis=0)), want, atol=1e-9)
    assert [int(row.deviation) for row in got[::16]] == ((n * x - sums) ** 2).sum(axis=1).tolist()
    assert np.allclose([row.explained for row in got[:16]], values[:16] / values.sum(), rtol=1e-9)
    assert {row.n for row in got} == {n} and max(row.identity_error for row in got) < 1e-9
    assert len({row.identity_error for row in got}) == 1


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 4.0]), (2, [3.0, 0.5]), (None, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, []), (8, [1.0]), (9, [2.0, 3.0, 4.0]), (10, [5.0, 3.0, 4.0])]
    df = spark.createDataFrame([(*row, "c", 1) for row in rows], SCHEMA)
    got = embedding_whitening.whitened(df).collect()
    # Dimension 2 has three distinct vectors and two components; dimension 3 varies in one direction, dimension 1 in none.
    keys = sorted(((row.vec_id, row.component, row.n) for row in got), key=str)
    want = [(1, 1, 3), (1, 2, 3), (10, 1, 2), (2, 1, 3), (2, 1, 3), (2, 2, 3), (2, 2, 3), (9, 1, 2), (None, 1, 3), (None, 2, 3)]
    assert keys == sorted(want, key=str)
    assert embedding_whitening.whitened(df.limit(0)).count() == 0
    assert embedding_whitening.whitened(df.filter("vec_id = 1")).count() == 0


def test_sums_beyond_64_bits(spark):
    rows = [(n, [3e38 if n % 2 else -3e38, float(n)], "c", 1) for n in range(40)]
    got = embedding_whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {row.n for row in got} == {40}
    far = int(embedding_whitening.LARGEST)
    x = [[(far if n % 2 else -far) + 1_000_000, 64 * n + 1_000_000] for n in range(40)]
    sums = [sum(column) for column in zip(*x)]
    want = {n: sum((40 * value - total) ** 2 for value, total in zip(vector, sums)) for n, vector in enumerate(x)}
    assert {row.vec_id: int(row.deviation) for row in got} == want
