"""Embedding whitening through the exact characteristic polynomial.

1. Entries become integers; the integer sums and products of all vectors are
   added up exactly, a few thousand rows at a time in each task, then by
   matrix cell.  A = n * sum(x x') - S S' is n^2 times the covariance.
2. The coefficients of det(t I - A) are found modulo as many 31-bit primes as
   their bound asks for: each task reduces A to Hessenberg form for its primes
   at once, and the Chinese remainder theorem gives the integers.
3. All roots are real, so Descartes' rule counts those above any dyadic point
   exactly: intervals are halved until each holds one root.  A task narrows its
   root to 192 bits and takes the null space of A - t I by inverse iteration in
   100-digit arithmetic.  Roots that agree to 192 bits share one task, which
   returns an orthonormal basis.
4. Vectors are projected in blocks.

What reaches the driver, and goes to the tasks, is a matrix of the embedding's
dimensions, whatever the number of rows.

Defined cases: vectors that are null, or hold nulls, NaN, infinities or entries
whose integer is beyond 62 bits, are dropped; so are vectors of another length
than the most frequent one (the longer on a tie) and empty ones.  Repeated rows
count as often as they are there, null ids are kept.  A component without
variance has whitened null and explained 0 and is left out of identity_error.
``deviation`` is null where the exact sum is beyond a long; ``deviation_text``
always has its digits.  An empty table, or one without usable vectors, gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
ROOT_BITS, DIGITS = 192, 100
SMALL, BLOCK = 1 << 20, 1 << 12  # products of a block of such entries are exact in doubles
LIMB = 40


# ---- integer sums ----

def integers(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of usable vectors, floor(SCALE * entry) of each)."""
    right = pc.fill_null(pc.equal(pc.list_value_length(col), dim), False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = col.filter(right).flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(flat.astype(np.float64).reshape(-1, dim) * SCALE)
        good = (np.abs(y) < 2.0 ** 62).all(axis=1)
    return at[good], y[good].astype(np.int64)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y in Python integers; larger entries are taken apart in 20-bit digits."""
    out = np.zeros((y.shape[1],) * 2, object)
    for k in range(0, len(y), BLOCK):
        part = y[k:k + BLOCK]
        digits = []
        while int(part.max(initial=0)) >= SMALL or int(part.min(initial=0)) <= -SMALL:
            digits.append(part & (SMALL - 1))
            part = part >> 20
        digits.append(part)
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                out += (a.T.astype(np.float64) @ b.astype(np.float64)).astype(np.int64).astype(object) << 20 * (i + j)
    return out


def limbs(v: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a signed integer, digits below 2^LIMB."""
    sign, v, k = (-1 if v < 0 else 1), abs(v), 0
    while v:
        yield k, sign * (v & ((1 << LIMB) - 1))
        v, k = v >> LIMB, k + 1


class Moments(NamedTuple):
    """Number of vectors, sums and sums of products of the unshifted integers, exact."""

    n: int
    sums: list[int]
    products: list[list[int]]

    @property
    def scatter(self) -> list[list[int]]:
        """n^2 times the covariance, which the shift doesn't change."""
        d = range(len(self.sums))
        return [[self.n * self.products[i][j] - self.sums[i] * self.sums[j] for j in d] for i in d]


def moments(vectors: DataFrame, dim: int) -> Moments:
    """Exact moments of the column ``v`` of ``vectors``."""
    upper = [(i, j) for i in range(dim) for j in range(i, dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            _, y = integers(b.column(0), dim)
            n += len(y)
            for k in range(0, len(y), BLOCK):
                high, low = y[k:k + BLOCK] >> 20, y[k:k + BLOCK] & (SMALL - 1)
                s += (high.sum(axis=0).astype(object) << 20) + low.sum(axis=0).astype(object)
            m += exact_products(y)
        cells = [n, *s, *(m[i, j] for i, j in upper)]
        rows = [(c, k, digit) for c, v in enumerate(cells) for k, digit in limbs(int(v))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)],
                                             names=["cell", "place", "digit"])

    found = vectors.select("v").mapInArrow(run, "cell long, place long, digit long")
    total = [0] * (1 + dim + len(upper))
    for r in found.groupBy("cell", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit")).collect():
        total[r.cell] += int(r.digit) << LIMB * r.place
    products = [[0] * dim for _ in range(dim)]
    for (i, j), v in zip(upper, total[1 + dim:], strict=True):
        products[i][j] = products[j][i] = v
    return Moments(total[0], total[1:1 + dim], products)


# ---- characteristic polynomial ----

def primes_below(top: int) -> Iterator[int]:
    """Odd primes under ``top`` (at most 2^32), falling; Miller-Rabin is exact there with three bases."""
    for p in range(top - 1 - top % 2, 2, -2):
        s = ((p - 1) & -(p - 1)).bit_length() - 1
        for a in (2, 7, 61):
            if a % p == 0:
                continue
            x = pow(a, (p - 1) >> s, p)
            if x != 1 and all(pow(x, 1 << k, p) != p - 1 for k in range(s)):
                break
        else:
            yield p


def enough_primes(a: list[list[int]]) -> list[int]:
    """Primes whose product is above twice every coefficient: those are at most (1 + trace / d)^d."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    bits = 2 + d * (1 + -(-trace // d)).bit_length()
    out: list[int] = []
    for p in primes_below(1 << 31):
        out.append(p)
        bits -= p.bit_length() - 1
        if bits <= 0:
            return out
    raise ValueError("too many digits")


def polynomials_mod(a: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of det(t I - a), constant first, a row a prime: Hessenberg reduction for all primes at once."""
    d, p = len(a), np.array(primes, np.int64)
    q, pp = p[:, None], p[:, None, None]
    h = np.array([[[v % m for v in row] for row in a] for m in primes], np.int64)
    every = np.arange(len(p))
    for k in range(d - 2):
        pivot = (h[:, k + 1:, k] != 0).argmax(axis=1) + k + 1
        row = h[every, pivot].copy()
        h[every, pivot] = h[:, k + 1]
        h[:, k + 1] = row
        col = h[every, :, pivot].copy()
        h[every, :, pivot] = h[:, :, k + 1]
        h[:, :, k + 1] = col
        inverse = np.array([pow(int(x), m - 2, m) for x, m in zip(h[:, k + 1, k], primes, strict=True)], np.int64)
        f = h[:, k + 2:, k] * inverse[:, None] % q
        h[:, k + 2:] = (h[:, k + 2:] - f[:, :, None] * h[:, k + 1, None, :] % pp) % pp
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2:] * f[:, None, :] % pp).sum(axis=2)) % q
    poly = np.zeros((d + 1, len(p), d + 1), np.int64)
    poly[0, :, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros((len(p), d + 1), np.int64)
        new[:, 1:] = poly[k - 1, :, :-1]
        new -= h[:, k - 1, k - 1, None] * poly[k - 1] % q
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            new -= (below * h[:, i - 1, k - 1] % p)[:, None] * poly[i - 1] % q
        poly[k] = new % q
    return poly[d]


def characteristic_polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Integer coefficients, constant first; every task takes some of the primes."""
    primes = enough_primes(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [p for b in batches for p in b.column(0).to_pylist()]
        if own:
            found = polynomials_mod(a, own)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))],
                                             names=["p", "c"])

    tasks = max(1, min(len(primes) // 8, spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    residues = {r.p: r.c for r in table.mapInArrow(run, "p long, c array<long>").collect()}
    return chinese_remainders(residues)


def chinese_remainders(residues: dict[int, list[int]]) -> list[int]:
    """The integers of least size with these residues."""
    whole = math.prod(residues)
    parts = [(whole // p) * pow(whole // p, -1, p) for p in residues]
    out = []
    for column in zip(*residues.values(), strict=True):
        v = sum(r * w for r, w in zip(column, parts, strict=True)) % whole
        out.append(v - whole if 2 * v > whole else v)
    return out


# ---- roots ----

def roots_above(c: list[int], m: int, s: int) -> int:
    """Number of roots above m / 2^s of a polynomial with real roots only: sign changes after the shift."""
    d = len(c) - 1
    q = [v << s * (d - i) if s >= 0 else v << -s * i for i, v in enumerate(c)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            q[j] += m * q[j + 1]
    signs = [v > 0 for v in q if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def sign_at(c: list[int], m: int, s: int) -> int:
    d, v = len(c) - 1, 0
    for i in range(d, -1, -1):
        v = v * m + (c[i] << s * (d - i))
    return (v > 0) - (v < 0)


class Root(NamedTuple):
    """The interval (low, high] / 2^scale holds the roots number ``first`` to ``first + count - 1``, from the top."""

    first: int
    count: int
    low: int
    high: int
    scale: int


def isolate(c: list[int], most: int) -> list[Root]:
    """Intervals of the largest ``most`` positive roots, one root each, or more that agree to ROOT_BITS bits."""
    bound = 1 + max(0, -c[-2])  # all roots are at least zero, so none is above their sum
    todo, out = [(0, 1 << bound.bit_length(), 0, roots_above(c, 0, 0), 0)], []
    while todo:
        low, high, s, above_low, above_high = todo.pop()
        if above_low == above_high or above_high >= most:
            continue
        if above_low - above_high == 1 or (high - low) << ROOT_BITS <= low:
            out.append(Root(above_high, above_low - above_high, low, high, s))
            continue
        if (low + high) % 2:
            low, high, s = 2 * low, 2 * high, s + 1
        mid = (low + high) // 2
        n = roots_above(c, mid, s)
        todo += [(low, mid, s, above_low, n), (mid, high, s, n, above_high)]
    return sorted(out)


def narrow(c: list[int], r: Root) -> Root:
    """The interval of a single root, halved until it is ROOT_BITS bits narrower than the root."""
    low, high, s = r.low, r.high, r.scale
    if r.count > 1 or sign_at(c, high, s) == 0:
        return r._replace(low=high if r.count == 1 else low)
    right = sign_at(c, high, s)
    while (high - low) << ROOT_BITS > max(low, 1) or not low:
        if (low + high) % 2:
            low, high, s = 2 * low, 2 * high, s + 1
        mid = (low + high) // 2
        at = sign_at(c, mid, s)
        if at == 0:
            return r._replace(low=mid, high=mid, scale=s)
        low, high = (low, mid) if at == right else (mid, high)
    return r._replace(low=low, high=high, scale=s)


# ---- components ----

def null_space(a: list[list[int]], r: Root) -> tuple[Decimal, list[list[Decimal]]]:
    """(root, as many orthonormal vectors): inverse iteration on a - root I, in DIGITS-digit arithmetic."""
    d = len(a)
    root = Decimal(r.low + r.high) / Decimal(2) ** (r.scale + 1)
    lu = np.array([[Decimal(v) for v in row] for row in a], object)
    for i in range(d):
        lu[i, i] -= root
    tiny = (abs(root) + 1) * Decimal(10) ** -(DIGITS - 10)
    order = list(range(d))
    for k in range(d):
        p = max(range(k, d), key=lambda i: abs(lu[i, k]))
        if p != k:
            lu[[k, p]] = lu[[p, k]]
            order[k], order[p] = order[p], order[k]
        if abs(lu[k, k]) < tiny:
            lu[k, k] = tiny
        if k + 1 < d:
            lu[k + 1:, k] /= lu[k, k]
            lu[k + 1:, k + 1:] -= np.outer(lu[k + 1:, k], lu[k, k + 1:])

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for k in range(1, d):
            x[k] -= sum(lu[k, :k] * x[:k])
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] - (sum(lu[k, k + 1:] * x[k + 1:]) if k + 1 < d else 0)) / lu[k, k]
        return x

    vectors: list[np.ndarray] = []
    rng = np.random.default_rng(1)
    for _ in range(r.count):
        x = np.array([Decimal(int(v)) for v in rng.integers(-1000, 1000, d)], object)
        for _ in range(4):
            x = solve(x)
            for _ in range(2):
                for v in vectors:
                    x = x - v * sum(v * x)
                x = x / sum(x * x).sqrt()
        vectors.append(x)
    return root, [list(v) for v in vectors]


class Component(NamedTuple):
    root: Decimal
    vector: list[float]


def components(spark: SparkSession, a: list[list[int]], most: int = COMPONENTS) -> list[Component]:
    """Roots and unit vectors of the largest positive roots, one task a root; the entry of largest size is positive."""
    if not any(a[i][i] for i in range(len(a))):
        return []
    c = characteristic_polynomial(spark, a)
    roots = isolate(c, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for b in batches:
            for r in b.to_pylist():
                with localcontext(prec=DIGITS):
                    root, vectors = null_space(a, narrow(c, Root(r["first"], r["count"], int(r["low"]), int(r["high"]), r["scale"])))
                    for k, v in enumerate(vectors):
                        lead = max(v, key=abs)
                        out.append((r["first"] + k, str(root), [float(x if lead > 0 else -x) for x in v]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*out, strict=True), (pa.int64(), pa.string(), pa.list_(pa.float64())), strict=True)],
                names=["no", "root", "vector"])

    rows = [(r.first, r.count, str(r.low), str(r.high), r.scale) for r in roots]
    table = spark.createDataFrame(rows, "first long, count long, low string, high string, scale long")
    table = table.repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))
    found = table.mapInArrow(run, "no long, root string, vector array<double>").collect()
    return [Component(Decimal(r.root), r.vector) for r in sorted(found, key=lambda r: r.no) if r.no < most]


# ---- whitening ----

class Whitening(NamedTuple):
    """A fitted transform: exact moments, components by falling variance, how many were asked for."""

    moments: Moments
    components: list[Component]
    wanted: int

    @property
    def explained(self) -> list[float]:
        a = self.moments.scatter
        trace = sum(a[i][i] for i in range(len(a)))
        with localcontext(prec=DIGITS):
            return [float(c.root / trace) for c in self.components] + [0.0] * (self.wanted - len(self.components))


def dimension(vectors: DataFrame) -> int:
    """The most frequent length above zero of the column ``v``; 0 without any."""
    sizes = vectors.filter("size(v) > 0").groupBy(F.size("v").alias("d")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return first.d if first else 0


def vectors_of(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> Whitening | None:
    """Fitted on all usable vectors; None without any."""
    v = vectors_of(df, id_col, vec_col)
    dim = dimension(v)
    if not dim:
        return None
    m = moments(v, dim)
    if not m.n:
        return None
    return Whitening(m, components(df.sparkSession, m.scatter, most), min(most, dim))


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * y - sums, exact: in 64 bits where they hold it, else in Python integers."""
    size = max(int(y.max(initial=0)), -int(y.min(initial=0)), 1)
    if n * size + max(map(abs, sums)) < 1 << 62:
        return y * n - np.array(sums, np.int64)
    return y.astype(object) * n - np.array(sums, object)


def square_sums(z: np.ndarray) -> list[int]:
    """Exact sum of the squares of each row."""
    if z.dtype != object and z.size and z.shape[1] * int(np.abs(z).max()) ** 2 < 1 << 63:
        return (z * z).sum(axis=1).tolist()
    z = z.astype(object)
    return [int(v) for v in (z * z).sum(axis=1)] if z.size else []


WHITE = "vec_id long, n long, deviation long, deviation_text string, whitened array<double>"


def transform(df: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n, deviation and the whitened components of every usable vector."""
    n, sums, dim, wanted = model.moments.n, model.moments.sums, len(model.moments.sums), model.wanted
    with localcontext(prec=DIGITS):
        # x - S/n is (n y - sums) / n, and its scale sqrt(root) / n: both n cancel
        scaled = [[float(Decimal(x) / c.root.sqrt()) for x in c.vector] for c in model.components]
    project = np.array(scaled, np.float64).reshape(-1, dim).T
    have = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, y = integers(b.column(1), dim)
            for k in range(0, len(y), BLOCK):
                z = centred(y[k:k + BLOCK], n, sums)
                w = z.astype(np.float64) @ project
                full = np.full((len(w), wanted), np.nan)
                full[:, :have] = w
                flat = pa.array(full.ravel(), pa.float64(), mask=np.isnan(full.ravel()))
                offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * wanted)
                dev = square_sums(z)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(at[k:k + BLOCK])), pa.array([n] * len(w), pa.int64()),
                    pa.array([v if v < 1 << 63 else None for v in dev], pa.int64()), pa.array(map(str, dev), pa.string()),
                    pa.ListArray.from_arrays(offsets, flat)], names=["vec_id", "n", "deviation", "deviation_text", "whitened"])

    return vectors_of(df, id_col, vec_col).mapInArrow(run, WHITE)


def identity_error(white: DataFrame, have: int) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity.

    Each task centres its rows before it multiplies; the tasks' means join by the usual formula.
    """
    if not have:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(0)
            w = col.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)[:, :have]
            mean = w.mean(axis=0)
            own = (w - mean).T @ (w - mean) + len(w) * np.outer(mean, mean)
            v = np.concatenate([[len(w)], len(w) * mean, own.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], names=["cell", "v"])

    rows = white.select("whitened").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(1 + have + have * have)
    for r in rows:
        v[r.cell] = r.v
    n, mean = v[0], v[1:1 + have] / v[0]
    cov = v[1 + have:].reshape(have, have) / n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(have)).max())


def by_component(white: DataFrame, explained: list[float], error: float) -> DataFrame:
    """One row a vector and component, numbered from 1."""
    def lit(values: list[float]) -> Column:
        return F.array(*[F.lit(x) for x in values])

    d = white.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("_q_at", "whitened"))
    return d.select("vec_id", (F.col("_q_at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                    lit(explained)[F.col("_q_at")].alias("explained"), F.lit(error).alias("identity_error"))


EMPTY = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Fit on and transform all usable vectors of ``df``; a row a vector and component."""
    model = fit(df, id_col, vec_col, most)
    if model is None:
        return df.sparkSession.createDataFrame([], EMPTY)
    white = transform(df, model, id_col, vec_col)
    return by_component(white, model.explained, identity_error(white, len(model.components)))
