"""Whitening against exact fractions and numpy's own eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest

from twinlake.llm import whitening as W
from twinlake.llm.eigen import symmetric_eigen

SCHEMA = "vec_id long, embedding array<double>, x string, component double"


def exact_covariance(x):
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return n, s, [[sum(Fraction(n * r[i] - s[i], n) * Fraction(n * r[j] - s[j], n) for r in x) / n for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("n", [1, 2, 3, 9, 64, 130])
@pytest.mark.parametrize("kind", ["random", "low rank", "equal values", "almost equal"])
def test_eigenpairs(n, kind):
    b = np.random.default_rng(n).normal(size=(n, n))
    a = {
        "random": b @ b.T, "low rank": b[:, :2] @ b[:, :2].T, "equal values": np.eye(n) * 3.0,
        "almost equal": np.diag(np.repeat([1.0, 2.0], [n // 2, n - n // 2])) + 1e-9 * (b + b.T),
    }[kind]
    values, q = symmetric_eigen(a)
    assert np.abs(values - np.linalg.eigvalsh(a)).max() <= 1e-12 * np.abs(a).max() * n
    assert np.abs(q.T @ q - np.eye(n)).max() < 1e-13
    assert np.abs(a @ q - q * values).max() <= 1e-12 * np.abs(a).max()


def test_products_keep_what_doubles_lose():
    """Entries near 2 ** 50 whose spread is 8: a plain sum of squares has no right digit left."""
    rng = np.random.default_rng(3)
    x = (1 << 50) + rng.integers(0, 8, (700, 3))
    n, s, v = exact_covariance(x.tolist())
    hi, lo = W.covariance_part(x[:300], n, s, np.zeros((3, 3)), np.zeros((3, 3)))
    more = W.covariance_part(x[300:], n, s, np.zeros((3, 3)), np.zeros((3, 3)))
    hi, lo = W.add(hi, lo, *more)
    for i in range(3):
        for j in range(3):
            assert abs((Fraction(hi[i, j]) + Fraction(lo[i, j])) / (v[i][j] * n) - 1) < Fraction(1, 10**25)


def test_whiten_is_the_exact_one(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(300, 6)) * [3, 2, 1.5, 1, 0.5, 0.1] + 40
    rows = [(k, v.tolist(), "x", 1.0) for k, v in enumerate(e)] + [(1000 + k, e[0].tolist(), None, None) for k in range(50)]
    rows += [(None, e[1].tolist(), None, None), (2000, None, None, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0], None, None)]
    rows += [(2002, [float("nan")] * 6, None, None), (2003, [float("-inf")] + [0.0] * 5, None, None), (2004, [-0.0] * 6, None, None), (2005, [1.0] * 4, None, None)]
    out = W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    given = [(r[0], [int(np.floor(256 * c)) for c in r[1]]) for r in rows if r[1] and len(r[1]) == 6 and all(c is not None and np.isfinite(c) for c in r[1])]
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in out) == sorted((k is None, k or 0, c) for k, _ in given for c in range(1, 5))
    n, s, v = exact_covariance([list(x) for x in {tuple(x) for _, x in given}])
    values, q = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    x_of = dict(given)
    for r in out:
        k = -r.component
        x = x_of[r.vec_id]
        want = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s)]) @ q[:, k] / np.sqrt(values[k])
        assert abs(abs(r.whitened) - abs(want)) < 1e-9
        assert (r.n, r.deviation) == (n, sum((n * c - t) ** 2 for c, t in zip(x, s)))
        assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-10 and r.identity_error < 1e-10
    signs = {(r.component, np.sign(r.whitened) == np.sign(np.array([float(Fraction(n * c - t, n)) for c, t in zip(x_of[r.vec_id], s)]) @ q[:, -r.component])) for r in out}
    assert len(signs) == 4  # one sign for all rows


def test_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert W.whiten(frame([])).count() == 0 == W.whiten(frame([(1, None, "", 0.0)])).count()
    assert W.whiten(frame([(k, [1.0, 2.0], "", 0.0) for k in range(3)])).count() == 0  # all equal
    assert W.whiten(frame([(1, [], "", 0.0)])).count() == 0
    narrow = W.whiten(frame([(k, [float(k), 2.0 * k], "", 0.0) for k in range(9)])).collect()
    assert [r.component for r in narrow] == [1] * 9  # they span one dimension
    huge = W.whiten(frame([(k, [1e300 * (k - 1), float(k)], "", 0.0) for k in range(3)])).collect()
    assert len(huge) == 3 and {r.deviation for r in huge if r.vec_id != 1} == {None}  # 2 ** 53 * 3, squared
    assert {r.deviation for r in huge if r.vec_id == 1} == {0} and all(r.identity_error < 1e-4 for r in huge)
