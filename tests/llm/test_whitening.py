"""Exact polynomials, roots and components; whitening against numpy and against integer arithmetic."""

import random
from fractions import Fraction

import numpy as np
import pytest
from material import work  # noqa: F401

from groundtrace.llm import whitening as wh


def slow_polynomial(matrix):
    """Faddeev and LeVerrier's recursion in fractions, constant term first."""
    d = len(matrix)
    a = [[Fraction(v) for v in row] for row in matrix]
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(0)] * d + [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(sum(a[i][t] * m[t][i] for t in range(d)) for i in range(d)) / k
    return [int(v) for v in c]


def scatter(rows):
    return [[sum(r[i] * r[j] for r in rows) for j in range(len(rows[0]))] for i in range(len(rows[0]))]


def test_polynomial_is_exact(spark):
    rng = random.Random(4)
    for d, size in ((1, 10), (2, 5), (5, 10 ** 9), (8, 1000), (9, 10 ** 14)):
        matrix = scatter([[rng.randint(-size, size) for _ in range(d)] for _ in range(d + 3)])
        assert wh.characteristic_polynomial(spark, matrix) == slow_polynomial(matrix)
    low_rank = scatter([[rng.randint(-9, 9) for _ in range(6)] for _ in range(2)])
    assert wh.characteristic_polynomial(spark, low_rank) == slow_polynomial(low_rank)
    assert wh.characteristic_polynomial(spark, [[0, 0], [0, 0]]) == [0, 0, 1]


def test_roots_with_copies():
    def times(p, q):
        out = [0] * (len(p) + len(q) - 1)
        for i, a in enumerate(p):
            for j, b in enumerate(q):
                out[i + j] += a * b
        return out

    p = [1]
    for root in (7, 7, 7, 1000003, 3, 0, 0):
        p = times(p, [-root, 1])
    assert [round(n / (1 << b)) for n, b in wh.largest_roots(p, 7)] == [1000003, 7, 7, 7, 3]
    near = times([-2, 0, 1], [-(10 ** 30) * 2 - 1, 0, 10 ** 30])  # +-sqrt(2) and a neighbour 3.5e-31 away
    assert wh.roots_above(near, 0, 0) == 2 and wh.roots_above(near, 2, 0) == 0
    n, b = wh.largest_roots(times([-2, 1], [-5, 1]), 1)[0]
    assert abs(Fraction(n, 1 << b) - 5) < Fraction(1, 1 << 150)


def test_repeated_root_gives_orthogonal_components():
    vectors = [[float(v) for v in row] for row in wh.null_vectors([[4, 0, 0], [0, 4, 0], [0, 0, 1]], (4, 0), 2)]
    assert np.allclose(np.array(vectors) @ np.array(vectors).T, np.eye(2))
    assert np.allclose(np.array(vectors)[:, 2], 0)


def brute(rows):
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(row, sums)) for (i, _), row in zip(good, x)}
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums)] for row in x])
    values, units = np.linalg.eigh(centred.T @ centred / n)
    return good, deviation, centred, values[::-1], units[:, ::-1]


@pytest.mark.parametrize("scale", [1.0, 3e7])
def test_whiten_against_numpy(spark, work, scale):  # noqa: F811
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 10)) @ rng.normal(size=(10, 10)) * scale
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(400, None), (401, [None] * 10), (402, [float("nan")] * 10), (403, [1.0] * 9 + [float("inf")]), (404, []),
             (405, [1e300] * 10), (406, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id long, e array<double>, n int, w double, id int")
    found = wh.whiten(table, work, "vec_id", "e").collect()
    rows = [r for r in rows if r[0] < 405]
    good, deviation, centred, values, units = brute(rows)
    assert len(found) == 8 * len(good) and {r.n for r in found} == {len(good)}
    assert {(r.id, int(r.deviation)) for r in found} == set(deviation.items())
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9
    order = {i: k for k, (i, _) in enumerate(good)}
    white = np.zeros((len(good), 8))
    for r in found:
        white[order[r.id], r.component - 1] = r.whitened
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
    want = centred @ units[:, :8] / np.sqrt(values[:8])
    signs = np.sign((white * want).sum(axis=0))
    assert np.allclose(white, want * signs, atol=1e-7)


def test_whiten_odd_tables(spark, work):  # noqa: F811
    shape = "id long, vector array<float>"
    assert wh.whiten(spark.createDataFrame([], shape), work).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None), (2, [])], shape), work).count() == 0
    equal = wh.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])], shape), work).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in equal] == 2 * [
        (1, 3, 0, None, None, None), (2, 3, 0, None, None, None)] + [(1, 3, 0, None, None, None), (2, 3, 0, None, None, None)]
    line = wh.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 2.0])], shape), work).collect()
    first, second = [r for r in line if r.component == 1], [r for r in line if r.component == 2]
    assert sorted(round(r.whitened, 9) for r in first) == [-1, 1] and {r.explained for r in first} == {1.0}
    assert {r.whitened for r in second} == {None} and {r.explained for r in second} == {0.0}
