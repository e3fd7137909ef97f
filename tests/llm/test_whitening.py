"""Whitening against plain exact and floating-point versions."""

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest

from quill.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n long, whitened string, v int"


def table(spark, vectors, parts=3):
    rows = [(i, v, 0, 1, "w", 2) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def usable(vectors, dim):
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]


def polynomial(a):
    """Faddeev-LeVerrier in fractions: coefficients of det(t I - a), constant first."""
    d = len(a)
    m = [[Fraction(0)] * d for _ in range(d)]
    c = [Fraction(1)]
    for k in range(1, d + 1):
        for i in range(d):
            m[i][i] += c[-1]
        m = [[sum(a[i][x] * m[x][j] for x in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(m[i][i] for i in range(d)) / k)
    return [int(v) for v in c[::-1]]


def psd(rng, d, rank, size):
    x = rng.integers(-size, size, (rank, d))
    return [[int(v) for v in row] for row in x.T.astype(object) @ x.astype(object)]


@pytest.mark.parametrize("d, rank, size", [(1, 1, 9), (2, 2, 5), (6, 9, 1000), (7, 3, 4), (9, 20, 10 ** 9)])
def test_characteristic_polynomial(spark, d, rank, size):
    a = psd(np.random.default_rng(d), d, rank, size)
    want = polynomial(a)
    assert W.characteristic_polynomial(spark, a) == want
    c = W.chinese_remainders({p: [v % p for v in want] for p in W.enough_primes(a)})
    assert c == want


def test_hessenberg_needs_pivots():
    a = [[0, 0, 0, 1], [0, 0, 1, 0], [0, 1, 0, 0], [1, 0, 0, 0]]
    p = next(W.primes_below(1 << 31))
    assert W.polynomials_mod(a, [p, 101]).tolist() == [[v % m for v in polynomial(a)] for m in (p, 101)]


def test_primes():
    small = [p for p in range(3, 2000) if all(p % q for q in range(2, p))]
    assert sorted(W.primes_below(2000)) == small


def test_roots_are_counted_with_their_multiplicity():
    # (t - 1)^2 (t - 3) (t - 10)
    c = [30, -73, 57, -15, 1]
    assert [W.roots_above(c, m, 0) for m in (0, 1, 2, 3, 9, 10)] == [4, 2, 2, 1, 1, 0]
    assert W.roots_above(c, 5, 1) == 2 and W.roots_above(c, 19, 1) == 1
    roots = [W.narrow(c, r) for r in W.isolate(c, 4)]
    assert [(r.first, r.count) for r in roots] == [(0, 1), (1, 1), (2, 2)]
    assert [round((r.low + r.high) / 2 ** (r.scale + 1), 12) for r in roots] == [10, 3, 1]


def test_vectors_of_close_and_equal_roots():
    a = [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 10 ** 12, 1], [0, 0, 1, 10 ** 12]]
    c = polynomial(a)
    with localcontext(prec=W.DIGITS):
        found = [W.null_space(a, W.narrow(c, r)) for r in W.isolate(c, 4)]
        assert [round(float(r), 6) for r, _ in found] == [10 ** 12 + 1, 10 ** 12 - 1, 5]
        vectors = [(r, v) for r, vs in found for v in vs]
        assert len(vectors) == 4
        for k, (r, v) in enumerate(vectors):
            residue = max(abs(sum(x * y for x, y in zip(row, v, strict=True)) - r * v[i]) for i, row in enumerate(a))
            assert residue < abs(r) * Decimal(10) ** -30
            for j, (_, u) in enumerate(vectors):
                assert abs(sum(x * y for x, y in zip(u, v, strict=True)) - (j == k)) < Decimal(10) ** -30


def vectors():
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(6, 6))
    out = [(i, [float(x) for x in np.float32(rng.normal(size=6) @ mix * 3)]) for i in range(300)]
    out += [(300 + i, out[5][1]) for i in range(100)] + [(5, out[5][1]), (None, out[6][1])]
    bad = [None, [], [1.0], [1.0] * 7, [None] + [1.0] * 5, [math.nan] + [1.0] * 5, [math.inf] + [1.0] * 5,
           [-math.inf] + [1.0] * 5, [None] * 6]
    return out + [(1000 + i, v) for i, v in enumerate(bad)]


def test_whitening_equals_numpy(spark):
    rows = vectors()
    got = W.whiten(table(spark, rows)).collect()
    x = usable(rows, 6)
    n, s = len(x), [sum(v[j] for _, v in x) for j in range(6)]
    c = np.array([[n * v[j] - s[j] for j in range(6)] for _, v in x], float) / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    white = c @ u / np.sqrt(e)
    assert len(got) == 6 * n and {r.component for r in got} == set(range(1, 7)) and {r.n for r in got} == {n}
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted(
        (str(i), sum((n * v[j] - s[j]) ** 2 for j in range(6))) for i, v in x)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    for k in range(6):
        one = [(by_id[i][k + 1].whitened, white[at, k]) for at, (i, _) in enumerate(x)]
        sign = 1 if max(one, key=lambda p: abs(p[1]))[0] * max(one, key=lambda p: abs(p[1]))[1] > 0 else -1
        assert max(abs(a - sign * b) for a, b in one) < 1e-9
        assert abs(by_id[0][k + 1].explained - e[k] / e.sum()) < 1e-12
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_moments_of_huge_entries_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 15)]) for i in range(50)]
    m = W.moments(W.vectors_of(table(spark, rows), "vec_id", "embedding"), 3)
    y = [[v - 1_000_000 for v in r] for _, r in usable(rows, 3)]
    assert m.n == 50 and m.sums == [sum(r[j] for r in y) for j in range(3)]
    assert m.products == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
    got = W.transform(table(spark, rows), W.fit(table(spark, rows))).collect()
    for r in got:
        own = y[r.vec_id]
        assert int(r.deviation_text) == sum((50 * own[j] - m.sums[j]) ** 2 for j in range(3))
        assert r.deviation == (int(r.deviation_text) if int(r.deviation_text) < 2 ** 63 else None)


def test_without_variance_and_equal_roots(spark):
    same = W.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert len(same) == 10 and all(r.whitened is None and r.explained == 0 and r.identity_error == 0 and r.deviation == 0
                                   for r in same)
    hot = [(i, [float(i % 4 == j) for j in range(4)]) for i in range(40)]
    got = W.whiten(table(spark, hot)).collect()
    assert len(got) == 160 and got[0].identity_error < 1e-12
    assert all((r.whitened is None) == (r.component == 4) for r in got)
    assert all(abs(r.explained - (r.component < 4) / 3) < 1e-12 for r in got)


def test_only_the_first_components(spark):
    got = W.whiten(table(spark, vectors()), most=2).collect()
    assert {r.component for r in got} == {1, 2}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [math.nan, 1.0])]])
def test_nothing_usable(spark, rows):
    out = W.whiten(table(spark, rows, 1))
    assert out.count() == 0
    assert out.schema.simpleString() == W.whiten(table(spark, [(1, [1.0])])).schema.simpleString()
