"""Whitening of vectors by the exact characteristic polynomial of their integer scatter.

A component c of a vector counts as the integer x = floor(1024 * c) + 100000. Tasks add up exact products, so the
scatter M = n * sum(x x') - S S' is an integer matrix whatever the order of the rows; M / n^2 is the covariance. Its
characteristic polynomial is computed modulo many primes, one reduction to Hessenberg form each, as Spark tasks, and
put together by Chinese remainders below a proven bound of its coefficients. All roots of a symmetric matrix are real,
so the sign changes of the polynomial moved to a point count the roots above it, copies included: that isolates the
largest roots to ``ROOT_BITS`` relative bits. Each component then comes from inverse iteration on M - root * I in
decimal arithmetic; roots that agree share one iteration, whose vectors are made orthogonal.

What comes to the driver are sums of dimensions^2 integers and one polynomial per prime, not rows.

Defined cases: rows whose vector is null, or holds a null, an infinite or not-a-number entry, or one whose integer is
no long, are left out. Vectors count by their most frequent length (of equally frequent ones the longest), those of
other lengths, and empty ones, are left out too. Repeated rows and null ids count and come out like all others. A
component of variance 0 has ``whitened`` null, and ``explained`` is null where the trace is 0; ``identity_error`` looks
at components of variance above 0 and is null without any. An empty table gives no rows. ``deviation`` has 38 decimal
digits. Further columns may bear any name.
"""

from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrace.llm.tables import Work

SCALE, SHIFT = 1024, 100_000
ROOT_BITS = 200
DIGITS = 150  # of the decimal arithmetic of inverse iteration
LIMB = 1 << 16


@dataclass(frozen=True)
class Whitening:
    """Sums of the fit list, the exact polynomial and the leading components."""

    n: int
    sums: list[int]          # per dimension, of x - SHIFT
    trace: int               # of the integer scatter
    polynomial: list[int]    # of the integer scatter, constant term first
    eigenvalues: list[float]  # of the covariance, falling
    explained: list[float | None]
    components: np.ndarray   # one unit vector per row


def _integers(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of x - SHIFT."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(vectors), size)
    return np.floor(flat * SCALE).astype(np.int64)


def _products(y: np.ndarray) -> np.ndarray:
    """Exact y'y as Python integers: limbs of 16 bits, so that sums of float products stay whole numbers."""
    limbs, rest = [], y
    while np.abs(rest).max() >= LIMB:
        limbs.append((rest & (LIMB - 1)).astype(float))
        rest = rest >> 16
    limbs.append(rest.astype(float))
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), 1 << 20):
        part = [limb[at:at + (1 << 20)] for limb in limbs]
        for i, a in enumerate(part):
            for j, b in enumerate(part):
                total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << (16 * (i + j)))
    return total


def _usable(vector: str) -> Column:
    return F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < float(1 << 62)))


def vectors_of(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vector) of the usable rows and their dimension."""
    good = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(
        F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(F.coalesce(_usable("vector"), F.lit(False)))
    lengths = good.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    size = first["d"] if first else 0
    return good.filter(F.size("vector") == size), size


def _sums(vectors: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """Row count, sums and sums of products over all rows, exact, of x - SHIFT."""

    def add(batches):
        n, total, cross = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            y = _integers(batch.column(0), size)
            if len(y):
                n += len(y)
                small = int(np.abs(y).max()) * len(y) < 1 << 62
                total = total + (y if small else y.astype(object)).sum(axis=0).astype(object)
                cross = cross + _products(y)
        if n:
            i, j = np.triu_indices(size)
            yield pa.record_batch([
                pa.array(np.concatenate([[-1], np.full(size, -1), i]), pa.int32()),
                pa.array(np.concatenate([[-1], np.arange(size), j]), pa.int32()),
                pa.array([Decimal(int(v)) for v in (n, *total, *cross[i, j])], pa.decimal128(38, 0))], names=["i", "j", "v"])

    parts = vectors.select("vector").mapInArrow(add, "i int, j int, v decimal(38,0)")
    found = {(r["i"], r["j"]): int(r["v"]) for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    cross = [[found[min(i, j), max(i, j)] for j in range(size)] for i in range(size)]
    return found[-1, -1], [found[-1, j] for j in range(size)], cross


def primes(count: int) -> list[int]:
    """The largest primes below 2^31, falling."""
    small = [p for p in range(2, isqrt(1 << 31) + 1) if all(p % q for q in range(2, isqrt(p) + 1))]
    found, at = [], (1 << 31) - 1
    while len(found) < count:
        block = np.arange(at, max(at - (1 << 16), 2), -1)
        whole = np.ones(len(block), bool)
        for q in small:
            whole[block % q == 0] = False
        found += block[whole].tolist()
        at -= 1 << 16
    return found[:count]


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Characteristic polynomial modulo a prime below 2^31, constant term first, by reduction to Hessenberg form."""
    h, d = matrix.copy() % p, len(matrix)
    for k in range(d - 2):
        rows = np.flatnonzero(h[k + 1:, k])
        if not len(rows):
            continue
        pivot = k + 1 + rows[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factors[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factors % p).sum(axis=1)) % p
    found = [np.array([1], np.int64)]
    for k in range(d):
        now = np.zeros(k + 2, np.int64)
        now[1:] = found[k]
        now[:-1] = (now[:-1] - h[k, k] * found[k]) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            now[:i + 1] = (now[:i + 1] - (int(h[i, k]) * below % p) * found[i]) % p
        found.append(now)
    return found[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, constant term first, of a symmetric integer matrix without negative roots.

    With roots of one sign the k-th coefficient is at most C(d, k) * (trace / d)^k, so as many primes as exceed twice
    that fix it. A task per group of primes reduces the matrix modulo each; the residues are joined on the driver.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = 2 * max(comb(d, k) * (-(-trace ** k // d ** k)) for k in range(d + 1)) + 1
    listed = primes(bound.bit_length() // 30 + 1)

    def reduce(batches):
        for batch in batches:
            got = [polynomial_modulo(np.array([[v % p for v in row] for row in matrix], np.int64), p)
                   for p in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([g.tolist() for g in got], pa.list_(pa.int64()))],
                                  names=["p", "residues"])

    rows = spark.createDataFrame([(p,) for p in listed], "p long").repartition(min(len(listed), 16)).mapInArrow(
        reduce, "p long, residues array<long>").collect()
    product = 1
    for r in rows:
        product *= r["p"]
    total = [0] * (d + 1)
    for r in rows:
        others = product // r["p"]
        base = others * pow(others, -1, r["p"])
        total = [t + v * base for t, v in zip(total, r["residues"])]
    total = [t % product for t in total]
    return [t - product if t > product // 2 else t for t in total]


def _signs(values: list[int]) -> int:
    """Sign changes, zeros left out."""
    signs = [v > 0 for v in values if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def roots_above(polynomial: list[int], numerator: int, bits: int) -> int:
    """How many roots, copies counted, lie above numerator / 2^bits; all roots are real."""
    d = len(polynomial) - 1
    moved = [c << (bits * (d - k)) for k, c in enumerate(polynomial)]  # of 2^(bits * d) * p(z / 2^bits)
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            moved[k] += numerator * moved[k + 1]
    return _signs(moved)


def _sign_at(polynomial: list[int], numerator: int, bits: int) -> int:
    value, power = 0, 0
    for c in reversed(polynomial):
        value = value * numerator + (c << (bits * power))
        power += 1
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], count: int) -> list[tuple[int, int]]:
    """The largest roots as (numerator, bits), falling, copies counted; each to ``ROOT_BITS`` bits of its value.

    Counting splits intervals, open below, until one holds a single root, whose sign change then halves it; an interval
    of several roots that never parts is one value that occurs several times.
    """
    high = 1 << (-polynomial[-2]).bit_length()  # no root is negative: their sum is above each
    found: list[tuple[int, int]] = []
    stack = [(0, high, 0, roots_above(polynomial, 0, 0), 0)]  # low, top, bits, roots above low, roots above top
    while stack and len(found) < count:
        low, top, bits, above_low, above_top = stack.pop()
        inside = above_low - above_top
        if not inside:
            continue
        narrow = top - low <= 1
        if narrow and top.bit_length() > ROOT_BITS:
            found += [(low + top, bits + 1)] * inside
            continue
        if inside == 1 and low > 0 and _sign_at(polynomial, low, bits) * _sign_at(polynomial, top, bits) < 0:
            found.append(_halved(polynomial, low, top, bits))
            continue
        if narrow:
            low, top, bits = 2 * low, 2 * top, bits + 1
        middle = (low + top) // 2
        above = roots_above(polynomial, middle, bits)
        stack += [(low, middle, bits, above_low, above), (middle, top, bits, above, above_top)]
    return found[:count]


def _halved(polynomial: list[int], low: int, top: int, bits: int) -> tuple[int, int]:
    """The root of an interval whose ends have opposite signs."""
    at_top = _sign_at(polynomial, top, bits)
    while top.bit_length() <= ROOT_BITS or top - low > 1:
        if top - low <= 1:
            low, top, bits = 2 * low, 2 * top, bits + 1
        middle = (low + top) // 2
        sign = _sign_at(polynomial, middle, bits)
        if sign == 0:
            return middle, bits
        low, top = (low, middle) if sign == at_top else (middle, top)
    return low + top, bits + 1


def null_vectors(matrix: list[list[int]], root: tuple[int, int], count: int) -> list[list[Decimal]]:
    """``count`` orthonormal vectors that M - root * I maps closest to 0, by inverse iteration in decimals."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        value = Decimal(root[0]) / Decimal(1 << root[1])
        size = max(value, Decimal(1))
        a = np.array([[(Decimal(v) - (value if i == j else 0)) / size for j, v in enumerate(row)]
                      for i, row in enumerate(matrix)], object)
        order, tiny = np.arange(d), Decimal(10) ** (-DIGITS // 2)
        for k in range(d):  # elimination with row exchange; the factors stay below the diagonal
            pivot = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            for r in range(k + 1, d):
                a[r, k] /= a[k, k]
                a[r, k + 1:] -= a[r, k] * a[k, k + 1:]
        found: list[np.ndarray] = []
        start = 0
        while len(found) < count:
            x = np.array([Decimal(1 + (start * 7 + i * (2 * start + 3)) % 11) for i in range(d)], object)
            start += 1
            for _ in range(4):
                y = x[order].copy()
                for k in range(1, d):
                    y[k] -= a[k, :k] @ y[:k]
                for k in range(d - 1, -1, -1):
                    y[k] = (y[k] - (a[k, k + 1:] @ y[k + 1:] if k + 1 < d else 0)) / a[k, k]
                x = y / (y @ y).sqrt()
                for other in found:
                    x = x - (x @ other) * other
                length = (x @ x).sqrt()
                if length < Decimal("1e-30"):
                    break
                x = x / length
            else:
                found.append(x)
        return [list(v) for v in found]


def fit(vectors: DataFrame, size: int, components: int = 8) -> Whitening:
    """Exact sums, polynomial, roots and components of all rows of ``vectors``; they must not be empty."""
    n, sums, cross = _sums(vectors, size)
    matrix = [[n * cross[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    trace = sum(matrix[i][i] for i in range(size))
    polynomial = characteristic_polynomial(vectors.sparkSession, matrix)
    wanted = min(components, size)
    roots = largest_roots(polynomial, wanted)
    rows: list[list[Decimal]] = []
    for at, root in enumerate(roots):
        if at and root == roots[at - 1]:
            continue
        rows += null_vectors(matrix, root, roots.count(root))
    units = np.zeros((wanted, size))
    for at, row in enumerate(rows):
        unit = np.array([float(v) for v in row])
        units[at] = unit * (1 if unit[np.abs(unit).argmax()] > 0 else -1)
    values = [(num / (1 << bits) if num.bit_length() < 900 else float(num >> bits)) for num, bits in roots]
    values += [0.0] * (wanted - len(values))
    return Whitening(n, sums, trace, polynomial, [v / n / n for v in values],
                     [v / trace if trace else None for v in values], units)


def whiten(rows: DataFrame, work: Work, id_col: str = "id", vector_col: str = "vector", components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per usable row and component."""
    spark = rows.sparkSession
    kind = "id " + rows.schema[id_col].dataType.simpleString()
    vectors, size = vectors_of(rows, id_col, vector_col)
    shape = f"{kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not size:
        return spark.createDataFrame([], shape)
    model = fit(vectors, size, components)
    positive = [k for k, e in enumerate(model.eigenvalues) if e > 0]
    placed = work.store(vectors.mapInArrow(_projector(model, size, positive), f"{kind}, deviation decimal(38,0), w array<double>"))
    item = [F.get("w", F.lit(k)) for k in range(len(positive))]
    measured = placed.agg(*[F.abs(F.covar_pop(item[i], item[j]) - (1.0 if i == j else 0.0)).alias(f"{i}_{j}")
                            for i in range(len(item)) for j in range(i, len(item))]).first() if item else None
    error = max(measured) if measured else None
    known = {k: at for at, k in enumerate(positive)}
    listed = F.array(*[F.struct(
        F.lit(k + 1).alias("component"),
        (item[known[k]] if k in known else F.lit(None).cast("double")).alias("whitened"),
        F.lit(model.explained[k]).cast("double").alias("explained")) for k in range(len(model.eigenvalues))])
    return placed.select("id", "deviation", F.inline(listed)).select(
        "id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).cast("double").alias("identity_error"))


def _projector(model: Whitening, size: int, positive: list[int]):
    """Per row the exact deviation and the whitened values of the components of variance above 0."""
    roots = np.array([model.eigenvalues[k] for k in positive]) ** 0.5
    units, n = model.components[positive], model.n
    means = np.array([s / n for s in model.sums])
    sums = np.array(model.sums, object)

    def project(batches):
        for batch in batches:
            y = _integers(batch.column(1), size)
            largest = n * max(int(np.abs(y).max(initial=0)), 1) + max(abs(s) for s in model.sums)
            if largest * largest * size < 1 << 62:
                apart = n * y - sums.astype(np.int64)
                deviation = pa.array((apart * apart).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                apart = n * y.astype(object) - sums
                deviation = pa.array([Decimal(int(v)) for v in (apart * apart).sum(axis=1)], pa.decimal128(38, 0))
            w = (y - means) @ units.T / roots if positive else np.zeros((len(y), 0))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(positive), pa.int32()), pa.array(w.ravel()))
            yield pa.record_batch([batch.column(0), deviation, listed], names=["id", "deviation", "w"])

    return project
