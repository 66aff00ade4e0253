"""Whitening of vectors by the exact characteristic polynomial of their scatter.

Entries become integers, so the scatter n * sum(y y') - S S' is exact.  Its characteristic polynomial is taken modulo many
primes, by reduction to Hessenberg form, and put together by Chinese remainders; the greatest common divisor with its
derivative, taken the same way, leaves a polynomial with simple roots.  All roots are real, so Descartes' rule counts them
exactly: intervals are halved until each holds one root, and then to some 160 bits.  A component is the null space of
scatter minus root, by inverse iteration in fixed point; a root of multiplicity m gives m orthonormal vectors.

Scale: rows are read in place and summed in tasks; only sums of size (dimensions squared) are shuffled and reach the driver.
Primes and roots are dealt to tasks.  Cost of the fit: dimensions cubed for each prime, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sonorisk.llm.common import nested, small

SCALE = 64
LIMB = 40
BITS = 160


# ---- integers ---------------------------------------------------------------------------------


def integers(column: pa.ListArray, dim: int) -> np.ndarray:
    """``floor(64 c)`` of every entry: int64, or Python integers where one does not fit.

    The constant 1,000,000 is left out here; neither the scatter nor n * x - S depends on it.
    """
    c = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    if not c.size or np.abs(c).max() < 2.0**56:
        return np.floor(c * SCALE).astype(np.int64)
    return np.array([[int(v) * SCALE if abs(v) >= 2.0**56 else math.floor(v * SCALE) for v in row] for row in c], dtype=object)


def _limbs(v: int) -> Iterator[tuple[int, int]]:
    """A whole number in digits to the base 2**40, the last one signed; digits of several numbers can be summed."""
    k = 0
    while not -(1 << LIMB) < v < 1 << LIMB:
        yield k, v & ((1 << LIMB) - 1)
        v, k = v >> LIMB, k + 1
    yield k, v


def _scatter(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        for b in small(batches, 4096):
            y = integers(b.column("vec"), dim)
            if not len(y):
                continue
            if y.dtype != object and np.abs(y).max() <= 1 << 20:  # 4,096 products under 2**40 are exact in doubles
                f = y.astype(np.float64)
                more, own = (f.T @ f).astype(np.int64).astype(object), y.sum(axis=0).astype(object)
            else:
                y = y.astype(object)
                more, own = y.T.dot(y), y.sum(axis=0)
            n, sums, products = n + len(y), sums + own, products + more
        cells = [(-1, -1, n), *((-1, j, int(sums[j])) for j in range(dim)), *((i, j, int(products[i, j])) for i in range(dim) for j in range(i, dim))] if n else []
        rows = [(i, j, k, s) for i, j, v in cells for k, s in _limbs(v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "limb", "s"])

    return run


# ---- characteristic polynomial ----------------------------------------------------------------


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` greatest odd primes below ``top`` (at most 2**32), by Miller and Rabin's test with bases that settle it there."""
    out, p = [], top - 1 if top % 2 == 0 else top - 2
    while len(out) < count:
        d, s = p - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        if all(pow(a, d, p) in (1, p - 1) or any(pow(a, d << r, p) == p - 1 for r in range(1, s)) for a in (2, 3, 5, 7)):
            out.append(p)
        p -= 2
    return out


def hessenberg_mod(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo ``p`` that is zero below its first subdiagonal."""
    h = a.copy()
    for m in range(1, len(h) - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        h[[m, i]] = h[[i, m]]
        h[:, [m, i]] = h[:, [i, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    return h


def characteristic_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - a) modulo ``p``, constant first."""
    h, n = hessenberg_mod(a, p), len(a)
    polys = np.zeros((n + 1, n + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(1, n + 1):
        new = np.roll(polys[k - 1], 1) - h[k - 1, k - 1] * polys[k - 1] % p
        chain, factor = 1, np.zeros(k - 1, dtype=np.int64)
        for i in range(k - 2, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            factor[i] = chain * int(h[i, k - 1]) % p
        polys[k] = (new - (factor[:, None] * polys[: k - 1] % p).sum(axis=0)) % p
    return [int(c) for c in polys[n]]


def gcd_mod(f: Sequence[int], g: Sequence[int], p: int) -> list[int]:
    """Monic greatest common divisor modulo ``p``, constant first."""

    def trimmed(x: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(x)
        return x[: used[-1] + 1] if len(used) else x[:0]

    a, b = trimmed(np.array(f, dtype=np.int64) % p), trimmed(np.array(g, dtype=np.int64) % p)
    while len(b):
        b = b * pow(int(b[-1]), -1, p) % p
        while len(a) >= len(b):
            a = a.copy()
            a[len(a) - len(b) :] = (a[len(a) - len(b) :] - a[-1] * b) % p
            a = trimmed(a)
        a, b = b, a
    return [int(c) for c in a * pow(int(a[-1]), -1, p) % p]


def remainders(residues: Sequence[Sequence[int]], primes: Sequence[int]) -> list[int]:
    """The whole numbers of least size with these residues, by Chinese remainders."""
    product = math.prod(primes)
    parts = [product // p * pow(product // p, -1, p) for p in primes]
    out = [sum(r * x for r, x in zip(column, parts, strict=True)) % product for column in zip(*residues, strict=True)]
    return [v - product if 2 * v > product else v for v in out]


def _residues(matrix: list[list[int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["p"].tolist():
                poly = characteristic_mod(np.array([[v % p for v in row] for row in matrix], dtype=np.int64), p)
                rows.append((p, poly, gcd_mod(poly, [k * c for k, c in enumerate(poly)][1:], p)))
            yield pd.DataFrame(rows, columns=["p", "poly", "common"])

    return run


def divided(f: Sequence[int], g: Sequence[int]) -> list[int]:
    """Exact quotient by a monic polynomial."""
    rest, out = list(f), [0] * (len(f) - len(g) + 1)
    for k in range(len(out) - 1, -1, -1):
        out[k] = rest[k + len(g) - 1]
        for j, c in enumerate(g):
            rest[k + j] -= out[k] * c
    if any(rest):
        raise ArithmeticError("the divisor does not divide")
    return out


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> tuple[list[int], list[int]]:
    """det(x - matrix) of a positive semidefinite matrix of whole numbers, and the polynomial of its distinct roots."""
    dim, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(math.comb(dim, k) * trace**k // dim**k + 1 for k in range(dim + 1))  # elementary symmetric sums of the roots
    count = 2
    while True:
        primes = primes_below(1 << 31, count)
        if math.prod(primes) > 2 * bound:
            break
        count += 1 + count // 4
    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    got = table.mapInPandas(_residues(matrix), "p long, poly array<long>, common array<long>").collect()  # a row for each prime
    poly = remainders([r.poly for r in got], [r.p for r in got])
    least = min(len(r.common) for r in got)
    if least == 1:
        return poly, poly
    good = [r for r in got if len(r.common) == least]
    return poly, divided(poly, remainders([r.common for r in good], [r.p for r in good]))


# ---- roots ------------------------------------------------------------------------------------


def roots_above(poly: Sequence[int], num: int, shift: int) -> int:
    """How many roots, with multiplicity, are greater than num / 2**shift; all roots must be real.

    Descartes' rule is exact then: the sign changes of the polynomial about that point.
    """
    d = len(poly) - 1
    c = [v << shift * (d - k) for k, v in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += num * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(poly: Sequence[int], num: int, shift: int) -> int:
    value, power = 0, 0
    for c in reversed(poly):
        value = value * num + (c << power)
        power += shift
    return (value > 0) - (value < 0)


def greatest_roots(poly: Sequence[int], simple: Sequence[int], top: int, wanted: int, bits: int = BITS) -> list[tuple[int, int, int]]:
    """(num, shift, multiplicity): the greatest positive roots, falling, until ``wanted`` are counted; each to ``bits`` bits.

    ``simple`` has the roots of ``poly`` once each; all lie at or below ``top``.
    """
    found, taken = [], 0
    stack = [(0, top, 0, roots_above(simple, 0, 0), 0)]  # (low, high] / 2**shift, roots above each end
    while stack and taken < wanted:
        lo, hi, shift, above_lo, above_hi = stack.pop()
        if above_lo == above_hi:
            continue
        if above_lo - above_hi > 1 or lo == 0:
            if hi - lo == 1:
                lo, hi, shift = 2 * lo, 2 * hi, shift + 1
            mid = (lo + hi) // 2
            at = roots_above(simple, mid, shift)
            stack += [(lo, mid, shift, above_lo, at), (mid, hi, shift, at, above_hi)]
            continue
        many = roots_above(poly, lo, shift) - roots_above(poly, hi, shift)
        found.append((lo, hi, shift, many))
        taken += many
    near = [_refined(simple, lo, hi, shift, bits) for lo, hi, shift, _ in found]
    out = []
    for k, (lo, hi, shift, many) in enumerate(found):
        num, at = near[k]
        gaps = [abs((num << other_at) - (other << at)) << 64 >> other_at for j, (other, other_at) in enumerate(near) if abs(j - k) == 1]
        closer = max((num << 64).bit_length() - max(1, g).bit_length() for g in gaps) if gaps else 0
        out.append((*(near[k] if closer < 48 else _refined(simple, lo, hi, shift, bits + closer)), many))
    return out


def _refined(poly: Sequence[int], lo: int, hi: int, shift: int, bits: int) -> tuple[int, int]:
    """The one simple root in (lo, hi] / 2**shift, halved to a relative width of 2**-bits."""
    at_hi = _sign(poly, hi, shift)
    if not at_hi:
        return hi, shift
    while (hi - lo) << bits > lo:
        if hi - lo == 1:
            lo, hi, shift = 2 * lo, 2 * hi, shift + 1
        mid = (lo + hi) // 2
        s = _sign(poly, mid, shift)
        if not s:
            return mid, shift
        lo, hi = (lo, mid) if s == at_hi else (mid, hi)
    return hi, shift


# ---- null spaces ------------------------------------------------------------------------------


def null_vectors(matrix: list[list[int]], num: int, shift: int, many: int, bits: int) -> np.ndarray:
    """``many`` orthonormal vectors of the null space of matrix - num / 2**shift, by inverse iteration in fixed point."""
    dim, unit = len(matrix), bits + 96
    size = max(1, sum(matrix[i][i] for i in range(dim))).bit_length()
    to_unit = lambda v, have: v << unit - have if unit >= have else v >> have - unit
    a = np.array([[to_unit(v, size) for v in row] for row in matrix], dtype=object)
    for i in range(dim):
        a[i, i] -= to_unit(num, size + shift)
    order = list(range(dim))
    lower = np.zeros((dim, dim), dtype=object)
    for k in range(dim):
        best = max(range(k, dim), key=lambda i: abs(a[i, k]))
        a[[k, best]], lower[[k, best]] = a[[best, k]], lower[[best, k]]
        order[k], order[best] = order[best], order[k]
        if not a[k, k]:
            a[k, k] = 1  # the least step of the fixed point
        for i in range(k + 1, dim):
            if a[i, k]:
                f = (a[i, k] << unit) // a[k, k]
                lower[i, k] = f
                a[i, k:] -= (f * a[k, k:]) >> unit
                a[i, k] = 0

    def solved(b: list[int]) -> np.ndarray:
        x = np.array([b[i] for i in order], dtype=object)
        for k in range(dim):
            x[k + 1 :] -= (lower[k + 1 :, k] * x[k]) >> unit
        for k in range(dim - 1, -1, -1):
            x[k] = ((x[k] - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> unit)) << unit) // a[k, k]
        return x

    rng = np.random.default_rng(11)
    basis: list[np.ndarray] = []
    while len(basis) < many:
        x = np.array([int(v) << unit for v in rng.integers(1, 1 << 20, dim)], dtype=object)
        for _ in range(3):
            for v in basis:
                x = x - ((v * (int((v * x).sum()) >> unit)) >> unit)
            length = math.isqrt(int((x * x).sum()))
            x = np.array([(int(c) << unit) // max(1, length) for c in x], dtype=object)
            last, x = x, solved(list(x))
        for v in basis:
            x = x - ((v * (int((v * x).sum()) >> unit)) >> unit)
        length = math.isqrt(int((x * x).sum()))
        basis.append(np.array([(int(c) << unit) // max(1, length) for c in x], dtype=object))
    return np.array([[math.ldexp(float(c), -unit) for c in v] for v in basis])


def _null_spaces(matrix: list[list[int]], bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, num, shift, many in zip(pdf["k"], pdf["num"], pdf["shift"], pdf["many"], strict=True):
                vectors = null_vectors(matrix, int(num), int(shift), int(many), max(bits, len(num) * 4))
                yield pd.DataFrame({"k": [k] * many, "at": range(many), "v": [v.tolist() for v in vectors]})

    return run


# ---- the operator -----------------------------------------------------------------------------


class Whitening:
    """Count, sums, components (rows, unit length) with their eigenvalues, and shares of the total variance."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, shares: list[float]):
        self.n, self.sums, self.vectors, self.values, self.shares = n, sums, vectors, values, shares

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        most = self.n * (int(np.abs(y).max()) if y.size else 0) + max((abs(s) for s in self.sums), default=0)
        kind = object if y.dtype == object or most >= 1 << 62 else np.int64
        return y.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def projected(self, z: np.ndarray) -> np.ndarray:
        return (z.astype(np.float64) @ self.vectors.T) / np.sqrt(self.values)


def fit(spark: SparkSession, vectors: DataFrame, dim: int, components: int = 32) -> Whitening:
    """Fit on all rows of ``vectors`` (``vec``, all of length ``dim``)."""
    cells = vectors.select("vec").mapInArrow(_scatter(dim), "i int, j int, limb int, s long").groupBy("i", "j", "limb").agg(F.sum("s").alias("s"))
    total: dict[tuple[int, int], int] = {}
    for r in cells.collect():  # (dimensions squared) sums, whatever the number of rows
        total[r.i, r.j] = total.get((r.i, r.j), 0) + (r.s << LIMB * r.limb)
    n = total.get((-1, -1), 0)
    sums = [total.get((-1, j), 0) for j in range(dim)]
    matrix = [[n * total.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    trace = sum(matrix[i][i] for i in range(dim))
    if not trace:
        return Whitening(n, sums, np.zeros((0, dim)), np.zeros(0), [])
    poly, simple = characteristic_polynomial(spark, matrix)
    roots = greatest_roots(poly, simple, trace, components)
    table = spark.createDataFrame([(k, str(num), shift, many) for k, (num, shift, many) in enumerate(roots)], "k int, num string, shift int, many int")
    got = table.repartition(len(roots), "k").mapInPandas(_null_spaces(matrix, BITS), "k int, at int, v array<double>").collect()
    kept = sorted(got, key=lambda r: (r.k, r.at))[:components]
    values = np.array([roots[r.k][0] / (1 << roots[r.k][1]) for r in kept])
    return Whitening(n, sums, np.array([r.v for r in kept]), values, [roots[r.k][0] / (trace << roots[r.k][1]) for r in kept])


def _covariance(model: Whitening, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(model.values)
        sums, products = np.zeros(m), np.zeros((m, m))
        for b in small(batches, 4096):
            w = model.projected(model.deviations(integers(b.column("vec"), dim)))
            sums, products = sums + w.sum(axis=0), products + w.T @ w
        rows = [(-1, j, sums[j]) for j in range(m)] + [(i, j, products[i, j]) for i in range(m) for j in range(i, m)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "s"])

    return run


def identity_error(vectors: DataFrame, model: Whitening, dim: int) -> float:
    """Largest entry, in size, of the covariance of the whitened rows minus the identity; measured on all rows.

    The projected deviations are centred up to rounding; what is left of their mean is taken out as well.
    """
    got = {(r.i, r.j): r.s for r in vectors.select("vec").mapInArrow(_covariance(model, dim), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    mean = lambda j: got[-1, j] / model.n
    return max((abs(s / model.n - mean(i) * mean(j) - (i == j)) for (i, j), s in got.items() if i >= 0), default=0.0)


def whiten(table: DataFrame, keep: Sequence[str] | None = ("vec_id",), vector: str = "embedding", components: int = 32) -> DataFrame:
    """``doc`` (kept columns), ``component, n, deviation, whitened, explained, identity_error`` for each row and component.

    Rows whose vector is NULL or holds NULL, NaN or infinite entries are dropped, and so are rows whose length is not the
    commonest one (of equally common ones the greatest).  Entries count as floor(64 c) + 1,000,000, of any size.
    ``deviation`` is NULL where it exceeds a long.  Components are those of positive eigenvalue, ``components`` at most: a
    table without rows, of one row or of equal rows has none and gives no rows.  Repeated rows count each time; equal
    eigenvalues get orthonormal vectors in some order.
    """
    spark = table.sparkSession
    rows = nested(table, keep, vec=vector)
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("vec").isNotNull() & (F.size("vec") > 0)).filter(finite)
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = lengths.dim if lengths else 0
    rows = rows.filter(F.size("vec") == dim)
    model = fit(spark, rows, dim, components) if dim else Whitening(0, [], np.zeros((0, 0)), np.zeros(0), [])
    error = identity_error(rows, model, dim) if len(model.values) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1024):
            z = model.deviations(integers(b.column("vec"), dim))
            big = z.dtype == object or z.size and int(np.abs(z).max()) ** 2 * dim >= 1 << 63
            squares = [sum(int(v) ** 2 for v in row) for row in z] if big else (z * z).sum(axis=1).tolist()
            w = model.projected(z)
            yield pa.RecordBatch.from_arrays([
                b.column("doc"), pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel())),
            ], names=["doc", "deviation", "w"])

    out = T.StructType([rows.schema["doc"], T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    each = rows.mapInArrow(run, out).select("doc", "deviation", F.posexplode("w").alias("at", "whitened"))
    shares = F.array(*[F.lit(s) for s in model.shares]).cast("array<double>")
    return each.select("doc", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
