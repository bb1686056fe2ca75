"""PCA whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers (64 to the unit, rounded down), so the scatter n * sum(y y') - S S' is an exact integer matrix: n * n
times the covariance. Tasks add up products of their rows in limbs that float arithmetic holds exactly, Spark sums them.

The scatter's characteristic polynomial is worked out modulo primes of 31 bits, each image by reduction to Hessenberg form,
and put together by Chinese remaindering; the number of primes follows from a bound on the coefficients (the polynomial of a
positive semidefinite matrix of trace t has none above (1 + t / d) ** d). All its roots are real, so that Descartes' rule, which counts the
sign changes of p(x + a), gives the exact number of roots above a: roots are isolated by bisection and multiplicities
are known. Each root is refined to ``FRACTION`` bits behind the point by exact signs. A component is the null space at its root: inverse
iteration in ``DIGITS`` decimal digits, a block of vectors at once for a root of higher multiplicity.

Images by prime and components are Spark tasks. The driver holds what the dimension bounds: the scatter, the polynomial, the roots and
the components; nothing that grows with the rows.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are left out. Shorter vectors count as filled up with 0.
Entries beyond 2 ** 56 in size count as that. Null and repeated ids are rows like others. A component of eigenvalue 0 (constant or
dependent dimensions, one row) has no whitened value: it is null, and identity_error is over the others (null if there are none). Where
nothing varies at all, explained is null too. A deviation of more than 38 digits is null.
Equal eigenvalues have no components of their own: any orthonormal basis of their space is given, the same for all rows. Other
columns are ignored. Without rows, or with empty vectors only, there is no result row.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Bits of a root behind the binary point, decimal digits of inverse iteration, and its rounds.
FRACTION, DIGITS, ROUNDS = 128, 90, 3
#: An entry is 2 ** 56 at most; limbs of 20 bits, of which 2 ** 12 products add up exactly in float64.
_LARGEST, _LIMB, _ROWS = 2.0**56, 20, 1 << 12
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors that have only finite entries, as doubles."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * entry) of each vector, as int64 of shape (rows, dims)."""
    size = np.asarray(pc.list_value_length(column), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    out = np.zeros((len(size), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at] = np.floor(np.clip(flat, -_LARGEST, _LARGEST) * scale).astype(np.int64)
    return out


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Float arrays whose sum, the k-th times 2 ** (20 k), is ``y``; all but the last from 0 to 2 ** 20."""
    out = []
    while y.size and (y.min() < -(1 << _LIMB) or y.max() >= 1 << _LIMB):
        out.append((y & ((1 << _LIMB) - 1)).astype(np.float64))
        y = y >> _LIMB
    return [*out, y.astype(np.float64)]


def _scatter_batches(dims: int, scale: int):
    """One row (i, j, limb, s) for each sum of products of dimensions i <= j of a task; i = -1: of dimension j alone; both -1: rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        rows = 0
        for t in batches:
            y = integers(t.column("v"), dims, scale)
            rows += len(y)
            for a in range(0, len(y), _ROWS):
                part = _limbs(np.column_stack([np.ones(len(y[a : a + _ROWS]), np.int64), y[a : a + _ROWS]]))
                for p, left in enumerate(part):
                    for q, right in enumerate(part):
                        got = (left.T @ right).astype(np.int64).astype(object)  # exact: 2 ** 12 products of 2 ** 40
                        total[p + q] = total.get(p + q, 0) + got
        if not rows:
            return
        i, j = np.triu_indices(dims + 1)
        for limb, s in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(i - 1, pa.int32()), pa.array(j - 1, pa.int32()), pa.array(np.full(len(i), limb), pa.int32()), pa.array([Decimal(int(x)) for x in s[i, j]], pa.decimal128(38, 0))], ["i", "j", "limb", "s"]
            )

    return run


def scatter(rows: DataFrame, dims: int, scale: int = SCALE) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, M) of the integer vectors: their number, sums by dimension, and n * sum(y y') - S S', exactly."""
    parts = rows.select("v").mapInArrow(_scatter_batches(dims, scale), "i int, j int, limb int, s decimal(38,0)")
    sums: dict[tuple[int, int], int] = {}
    for i, j, limb, s in parts.groupBy("i", "j", "limb").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect():  # dims ** 2 rows a limb
        sums[i, j] = sums.get((i, j), 0) + (int(s) << (_LIMB * limb))
    n = sums.get((-1, -1), 0)
    total = [sums.get((-1, j), 0) for j in range(dims)]
    return n, total, [[n * sums.get((min(i, j), max(i, j)), 0) - total[i] * total[j] for j in range(dims)] for i in range(dims)]


def is_prime(n: int) -> bool:
    """Whether n, of at most 64 bits, is prime (Miller-Rabin with the bases that suffice there)."""
    bases = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    if n < 2 or any(n % b == 0 for b in bases):
        return n in bases
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for b in bases:
        x = pow(b, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2 ** 31 whose product has more than ``bits`` bits."""
    out, product, p = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def modular_polynomials(m: list[list[int]], p: np.ndarray) -> np.ndarray:
    """Coefficients, from the constant one up, of the characteristic polynomial of ``m`` modulo each prime of ``p``."""
    d, count = len(m), len(p)
    a = np.stack([(np.array(m, dtype=object) % int(q)).astype(np.int64) for q in p]) if d else np.zeros((count, 0, 0), np.int64)
    q1, q2 = p[:, None], p[:, None, None]
    each = np.arange(count)
    for k in range(1, d - 1):  # column k - 1 becomes zero below row k
        pivot = k + np.argmax(a[:, k:, k - 1] != 0, axis=1)
        a[each, k], a[each, pivot] = a[each, pivot], a[each, k].copy()
        a[each, :, k], a[each, :, pivot] = a[each, :, pivot], a[each, :, k].copy()
        inverse = np.array([pow(int(x), -1, int(q)) if x else 0 for x, q in zip(a[:, k, k - 1], p, strict=True)], np.int64)
        u = a[:, k + 1 :, k - 1] * inverse[:, None] % q1
        a[:, k + 1 :] = (a[:, k + 1 :] - u[:, :, None] * a[:, None, k] % q2) % q2
        a[:, :, k] = (a[:, :, k] + (a[:, :, k + 1 :] * u[:, None, :] % q2).sum(axis=2)) % q1
    polys = [np.ones((count, 1), np.int64)]
    for k in range(d):
        new = np.zeros((count, k + 2), np.int64)
        new[:, 1:] = polys[k]
        new[:, :-1] = (new[:, :-1] - a[:, k, k][:, None] * polys[k]) % q1
        below = np.ones(count, np.int64)
        for i in range(k - 1, -1, -1):
            below = below * a[:, i + 1, i] % p
            new[:, : i + 1] = (new[:, : i + 1] - (a[:, i, k] * below % p)[:, None] * polys[i]) % q1
        polys.append(new)
    return polys[d]


def remaindered(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The integers, positive and negative, that have these residues modulo each (prime, residues)."""
    product = 1
    for p, _ in residues:
        product *= p
    weights = [product // p * pow(product // p, -1, p) for p, _ in residues]
    out = []
    for column in zip(*(r for _, r in residues), strict=True):
        x = sum(w * c for w, c in zip(weights, column, strict=True)) % product
        out.append(x - product if 2 * x > product else x)
    return out


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients, from the constant one up, of the characteristic polynomial of a positive semidefinite integer matrix."""
    d = len(m)
    trace = sum(m[i][i] for i in range(d))
    bound = ((d + trace) ** d) // d**d + 1
    moduli = primes(bound.bit_length() + 2)

    def images(batches):
        for t in batches:
            p = t.column("p").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([t.column("p"), pa.array(modular_polynomials(m, p).tolist(), pa.list_(pa.int64()))], ["p", "r"])

    table = spark.createDataFrame([(q,) for q in moduli], "p long").repartition(max(1, len(moduli) // 16))
    return remaindered([(r.p, r.r) for r in table.mapInArrow(images, "p long, r array<long>").collect()])


def sign_changes(c: list[int]) -> int:
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def moved(c: list[int], a: int) -> list[int]:
    """Coefficients of p(x + a)."""
    c = list(c)
    for k in range(len(c) - 1):
        for i in range(len(c) - 2, k - 1, -1):
            c[i] += a * c[i + 1]
    return c


def value(c: list[int], x: int) -> int:
    out = 0
    for k in reversed(c):
        out = out * x + k
    return out


def roots(c: list[int], most: int, fraction: int = FRACTION) -> list[tuple[int, int]]:
    """(root times 2 ** fraction, multiplicity) of the largest ``most`` roots above 0 of a polynomial whose roots are all real, falling.

    Roots that are nearer to each other than 2 ** -fraction count as one of their multiplicities together.
    """
    zeros = next(k for k, x in enumerate(c) if x)
    c = c[zeros:]
    d = len(c) - 1
    c = [x << (fraction * (d - k)) for k, x in enumerate(c)]  # roots are now 2 ** fraction times as large
    top = 1
    while sign_changes(moved(c, top)):
        top *= 2
    out: list[tuple[int, int]] = []
    found = 0
    spans = [(0, top, d, 0)]  # (low, high, roots above low, roots above high), the highest last
    while spans and found < most:
        low, high, above, beyond = spans.pop()
        if above == beyond:
            continue
        if above - beyond == 1:
            falling = value(c, high) > 0  # the sign above the root; 0: it is the root
            while high - low > 1 and value(c, high):
                middle = (low + high) // 2
                at = value(c, middle)
                if not at:
                    low = high = middle
                elif (at > 0) == falling:
                    high = middle
                else:
                    low = middle
            out.append((high, 1))
            found += 1
        elif high - low == 1:
            out.append((high, above - beyond))
            found += above - beyond
        else:
            middle = (low + high) // 2
            within = sign_changes(moved(c, middle))
            spans += [(low, middle, above, within), (middle, high, within, beyond)]
    return out


def eliminated(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """LU factors of a matrix of Decimals, in one array, and the row swaps. A pivot of zero becomes a tiny number."""
    a, d, swaps = a.copy(), len(a), []
    tiny = max(abs(x) for x in a.flat).scaleb(-DIGITS + 5) or Decimal(1)
    for k in range(d):
        p = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, p]] = a[[p, k]]
        swaps.append(p)
        if not a[k, k]:
            a[k, k] = tiny
        a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, swaps


def solved(lu: np.ndarray, swaps: list[int], b: np.ndarray) -> np.ndarray:
    b, d = b.copy(), len(lu)
    for k, p in enumerate(swaps):
        b[[k, p]] = b[[p, k]]
    for k in range(d):
        b[k + 1 :] = b[k + 1 :] - np.outer(lu[k + 1 :, k], b[k])
    for k in range(d - 1, -1, -1):
        b[k] = b[k] / lu[k, k]
        b[:k] = b[:k] - np.outer(lu[:k, k], b[k])
    return b


def orthonormal(b: np.ndarray) -> np.ndarray:
    """Columns made orthonormal one after the other, twice over."""
    b = b.copy()
    for _ in range(2):
        for k in range(b.shape[1]):
            for j in range(k):
                b[:, k] = b[:, k] - b[:, j] * sum(b[:, j] * b[:, k])
            b[:, k] = b[:, k] / sum(b[:, k] * b[:, k]).sqrt()
    return b


def null_space(m: list[list[int]], root: int, fraction: int, size: int) -> np.ndarray:
    """``size`` orthonormal eigenvectors of ``m``, as columns of doubles, at the eigenvalue root / 2 ** fraction."""
    with localcontext() as context:
        context.prec = DIGITS
        d = len(m)
        a = np.array([[Decimal(x) for x in row] for row in m], dtype=object)
        at = Decimal(root) / Decimal(1 << fraction)
        for k in range(d):
            a[k, k] = a[k, k] - at
        lu, swaps = eliminated(a)
        start = np.random.default_rng(d).integers(-1000, 1000, (d, size)) * 2 + 1  # odd numbers: never zero
        b = orthonormal(np.array([[Decimal(int(x)) for x in row] for row in start], dtype=object))
        for _ in range(ROUNDS):
            b = orthonormal(solved(lu, swaps, b))
        out = b.astype(np.float64)
    signs = np.sign(out[np.argmax(np.abs(out), axis=0), np.arange(size)])
    return out * signs


def components(spark: SparkSession, m: list[list[int]], found: list[tuple[int, int]], fraction: int = FRACTION) -> list[list[float]]:
    """The eigenvectors at each of ``found``, in their order; each root is a Spark task."""

    def run(batches):
        for t in batches:
            for k, root, size in zip(*(t.column(c).to_pylist() for c in ("k", "root", "size")), strict=True):
                v = null_space(m, int(root), fraction, size)
                yield pa.RecordBatch.from_arrays([pa.array([k] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(v.T.tolist(), pa.list_(pa.float64()))], ["k", "i", "v"])

    rows = [(k, str(root), size) for k, (root, size) in enumerate(found)]
    table = spark.createDataFrame(rows, "k int, root string, size int").repartition(max(1, len(rows) // 2), "k")
    return [r.v for r in sorted(table.mapInArrow(run, "k int, i int, v array<double>").collect())]


class Whitening:
    """A fitted transformation. vectors: components as columns; values: their eigenvalues; explained: their shares of the trace."""

    def __init__(self, n: int, total: list[int], m: list[list[int]], found: list[tuple[int, int]], vectors: list[list[float]], most: int, scale: int, fraction: int = FRACTION):
        self.n, self.total, self.scale, self.dims = n, total, scale, len(m)
        self.count = min(most, len(m))
        trace = sum(m[i][i] for i in range(len(m)))
        each = [root for root, size in found for _ in range(size)][: self.count]
        self.explained = [ratio(root, trace << fraction) for root in each] + [0.0 if trace else None] * (self.count - len(each))
        self.values = [ratio(root, n * n << fraction) for root in each]
        self.spread = np.array([float(isqrt(root << fraction)) / 2.0**fraction / n for root in each])
        self.vectors = np.array(vectors[: len(each)], dtype=np.float64).reshape(len(each), len(m)).T
        #: the mean, split in whole numbers and what is left
        self.mean = np.array([t // n for t in total], dtype=np.int64)
        self.left = np.array([ratio(t % n, n) for t in total])

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (y - self.mean).astype(np.float64) - self.left

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y) @ self.vectors / self.spread

    def deviations(self, y: np.ndarray) -> list[int]:
        """sum((n * y - S) ** 2) of each row, exactly."""
        far = int(max(abs(y).max(initial=0), max(map(abs, self.mean.tolist()), default=0))) + 1
        if (2 * far * self.n) ** 2 * max(self.dims, 1) < 1 << 62:
            return ((y * self.n - np.array(self.total, np.int64)) ** 2).sum(axis=1).tolist()
        z = y.astype(object) * self.n - np.array(self.total, dtype=object)
        return [int(x) for x in (z * z).sum(axis=1)] if len(y) else []


def ratio(a: int, b: int) -> float:
    """a / b, correctly rounded however large both are."""
    return a / b if b else 0.0


def fit(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The whitening of all usable ``vectors``; None where there is nothing to fit."""
    rows, spark = usable(vectors), vectors.sparkSession
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not dims:
        return None
    n, total, m = scatter(rows, dims, scale)
    found = roots(characteristic_polynomial(spark, m), most) if any(m[i][i] for i in range(dims)) else []
    return Whitening(n, total, m, found, components(spark, m, found) if found else [], most, scale)


def identity_error(vectors: DataFrame, fitted: Whitening) -> float | None:
    """The largest entry, in size, of the covariance of whitened rows less the identity: measured on all rows."""
    k = fitted.spread.size
    if not k:
        return None

    def sums(batches):
        total, n = np.zeros((k + 1, k + 1)), 0
        for t in batches:
            w = fitted.whitened(integers(t.column("v"), fitted.dims, fitted.scale))
            w = np.column_stack([np.ones(len(w)), w])
            total += w.T @ w
            n += len(w)
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    out = np.zeros((k + 1, k + 1))
    for i, j, s in usable(vectors).select("v").mapInArrow(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # k ** 2 rows
        out[i, j] = out[j, i] = s / fitted.n
    mean = out[0, 1:]
    return float(np.abs(out[1:, 1:] - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and component."""
    spark, fitted = vectors.sparkSession, fit(vectors, most, scale)
    if fitted is None:
        return spark.createDataFrame([], OUT)
    error = identity_error(vectors, fitted)
    k, real = fitted.count, fitted.spread.size

    def run(batches):
        for t in batches:
            y = integers(t.column("v"), fitted.dims, fitted.scale)
            size = len(y)
            values = np.full((size, k), np.nan)
            values[:, :real] = fitted.whitened(y)
            ids = t.column("vec_id").take(pa.array(np.repeat(np.arange(size), k)))
            deviation = pa.array([Decimal(x) if x < 10**38 else None for x in fitted.deviations(y)], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(size), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, fitted.n, np.int64)), deviation, pa.array(values.ravel(), from_pandas=True),
                pa.array(fitted.explained * size, pa.float64()), pa.array([error] * (size * k), pa.float64()),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable(vectors).mapInArrow(run, OUT)
