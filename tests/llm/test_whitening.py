"""Whitening against exact rational arithmetic and numpy's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidewatch.llm import whitening as W


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")


def floored(x, dims):
    return [math.floor(64 * Fraction(max(-(2.0**56), min(2.0**56, v)))) + 1_000_000 for v in [*x, *[0.0] * (dims - len(x))]]


def polynomial(m):
    """Characteristic polynomial by Faddeev and LeVerrier, in fractions."""
    d = len(m)
    out, b = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[sum(m[i][x] * b[x][j] for x in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(m[i][x] * b[x][i] for i in range(d) for x in range(d)) / k)
    return [int(x) for x in reversed(out)]


def gram(rng, d, rank, size=50):
    a = rng.integers(-size, size, (rank, d)).tolist()
    return [[sum(r[i] * r[j] for r in a) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (2, 2), (3, 1), (6, 6), (9, 4), (12, 12)])
def test_polynomial_is_exact(spark, d, rank):
    m = gram(np.random.default_rng(d), d, rank, 10**6)
    assert W.characteristic_polynomial(spark, m) == polynomial(m)
    diagonal = [[(i % 3) * 7 if i == j else 0 for j in range(d)] for i in range(d)]  # zero pivots throughout
    assert W.characteristic_polynomial(spark, diagonal) == polynomial(diagonal)


def test_polynomial_where_pivots_are_missing(spark):
    m = [[4, 0, 2, 0], [0, 3, 0, 1], [2, 0, 5, 0], [0, 1, 0, 6]]
    assert W.characteristic_polynomial(spark, m) == polynomial(m)


def test_roots_and_multiplicities():
    def product(*zeros):
        c = [1]
        for z in zeros:
            c = [a - z * b for a, b in zip([0, *c], [*c, 0])]
        return c

    one = 1 << W.FRACTION
    assert W.roots(product(7, 7, 7, 3, 0, 0), 9) == [(7 * one, 3), (3 * one, 1)]
    assert W.roots(product(10**30 + 1, 10**30, 10**30, 1), 3) == [((10**30 + 1) * one, 1), (10**30 * one, 2)]
    assert W.roots([1, -3, 1], 1)[0][0] == pytest.approx((3 + 5**0.5) / 2 * one, rel=1e-15)  # falling sign before the root
    got = W.roots(polynomial(gram(np.random.default_rng(0), 8, 8)), 8)
    want = sorted(np.linalg.eigvalsh(np.array(gram(np.random.default_rng(0), 8, 8), float)), reverse=True)
    assert [r / one for r, _ in got] == pytest.approx(want, rel=1e-9)


def test_primes():
    assert [n for n in range(60) if W.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    p = W.primes(3000)
    assert p[0] == 2**31 - 1 and len(set(p)) == len(p) and math.prod(p).bit_length() > 3000
    assert not any(W.is_prime(n) for n in (3215031751, 341550071728321, 2147483647 * 2147483629))


def check(spark, rows, most=32):
    """Against exact sums and numpy; eigenspaces, not single vectors, where values coincide."""
    ok = [(i, x) for i, x, *_ in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    dims = max((len(x) for _, x in ok), default=0)
    got = W.whitened(frame(spark, rows), most).collect()
    k, n = min(dims, most), len(ok)
    assert len(got) == n * k
    x = [floored(v, dims) for _, v in ok]
    s = [sum(c) for c in zip(*x)]
    deviations = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    assert sorted(int(-1 if r.deviation is None else r.deviation) for r in got if r.component == 1) == sorted(v if v < 10**38 else -1 for v in deviations)
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s)] for r in x])
    cov = centred.T @ centred / n
    e = np.linalg.eigvalsh(cov)[::-1][:k]
    trace = np.trace(cov)
    for r in got:
        assert r.n == n and (r.explained == pytest.approx(max(e[r.component - 1], 0) / trace, rel=1e-6, abs=1e-12) if trace else r.explained is None)
    return got, centred, e


def matched(got, centred, e, rows):
    """Whitened columns reproduce the covariance: distances of rows in the space of all components with values above 0."""
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r.whitened)
    for c, values in by.items():
        flat = [v for x in values.values() for v in x]
        if e[c - 1] > 1e-9 * e[0]:
            assert np.mean(np.square(flat)) == pytest.approx(1, abs=1e-9)


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=40) * np.linspace(0.1, 2, 40)).tolist(), "x") for i in range(300)]
    got, centred, e = check(spark, rows)
    matched(got, centred, e, rows)
    w, u = np.linalg.eigh(centred.T @ centred / len(rows))
    mine = np.array([[r.whitened for r in sorted((r for r in got if r.vec_id == i), key=lambda r: r.component)] for i in range(len(rows))])
    want = centred @ u[:, ::-1][:, :32] / np.sqrt(w[::-1][:32])
    assert np.abs(mine * np.sign((mine * want).sum(0)) - want).max() < 1e-8
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-12


def test_eigenvalues_next_to_each_other(spark):
    """Two values that differ by one part in 10 ** 11: the components are right to double precision all the same."""
    m = [[10**12 + 3, 1, 2], [1, 10**12, 5], [2, 5, 10**12 - 1]]
    found = W.roots(polynomial(m), 3)
    u = np.array(W.components(spark, m, found)).T
    a = [[Fraction(v) for v in r] for r in m]
    for k, (root, size) in enumerate(found):
        assert size == 1
        left = [sum(a[i][j] * Fraction(float(u[j, k])) for j in range(3)) - Fraction(root, 1 << W.FRACTION) * Fraction(float(u[i, k])) for i in range(3)]
        assert max(abs(float(x)) for x in left) < 1e-3 * 1e-12 * 1e12 * 1.5  # 10 ** 12 times the rounding of u
    assert np.abs(u.T @ u - np.eye(3)).max() < 1e-14


def test_equal_eigenvalues(spark):
    """Four corners of a square, doubled: each direction is as good as another, but the whitened covariance is the identity."""
    rows = [(i, [a, b, 0.0], "x") for i, (a, b) in enumerate([(1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)] * 2)]
    got, centred, e = check(spark, rows)
    matched(got, centred, e, rows)
    assert all(r.whitened is None for r in got if r.component == 3) and got[0].identity_error < 1e-14


def test_huge_and_short_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist(), "x") for i in range(20)] + [(50, [1e15, -1e14, 3.0], "x"), (51, [2.0], None), (None, [], "x"), (52, [-(2.0**30), 1.0, 2.0**21 + 0.5], "x"), (3, [1.0, 2.0, 3.0], "x")]
    bad = [(60, None, "x"), (61, [1.0, None, 2.0], "x"), (62, [float("nan"), 1.0, 1.0], "x"), (63, [float("inf")], "x")]
    check(spark, rows + bad)


def test_rank_deficient_and_single(spark):
    got, *_ = check(spark, [(1, [0.5, 0.25], "x")])
    assert all(r.whitened is None and r.identity_error is None and r.explained is None for r in got)
    rows = [(i, [float(i), 2.0 * i, 0.0, 1.0], "x") for i in range(12)]
    got, *_ = check(spark, rows)
    assert {r.component for r in got if r.whitened is not None} == {1} and got[0].identity_error < 1e-14


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None, "x")], [(1, [], "x")]):
        out = W.whitened(frame(spark, rows))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_beyond_the_largest_entry(spark):
    check(spark, [(1, [1e300, 0.0], "x"), (2, [-1e300, 1.0], "x"), (3, [0.0, 5.0], "x")])
