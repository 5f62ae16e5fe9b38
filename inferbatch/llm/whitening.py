"""Whitening of embeddings by an exact characteristic polynomial.

Entries become integers x = floor(1024 c) + 100000. Two passes over the table gather exact integers: the
count and the sums, then the products of y = x - centre, where centre is the rounded mean, so entries are
centred before they are multiplied. Every task returns its sums cut into 31-bit limbs, and Spark adds the
limbs. From them follows the scatter matrix

    M = n sum(y y') - sum(y) sum(y)' = n^2 V

without any rounding. Its characteristic polynomial is computed modulo primes, one Spark row per prime: M is
reduced to Hessenberg form modulo the prime, and the coefficients follow from a recurrence. M has no negative
eigenvalue, so its k-th coefficient lies between 0 and C(d, k) (trace / d)^k up to its sign; with primes beyond
twice that, Chinese remaindering gives the integer coefficients.

All roots are real, so the sign changes of the polynomial moved to a point count the roots beyond it exactly,
repeated ones included (Descartes' rule). Bisection by that count separates the largest roots; a root
that stands alone is then refined by the sign of the polynomial in integer arithmetic, to `ROOT_BITS` bits.
Roots not separated by then are one root of that multiplicity. Components are the null space of M - root I, by
inverse iteration on as many fixed vectors as the root counts, with `DIGITS` decimal digits, made orthonormal.

Rows are whitened from the model, written once, and the covariance of what was written is measured by Spark's
covariance aggregates.

Defined results: rows whose vector is null or empty or holds a null or non-finite entry are left out. The
dimension is the most frequent length, the greater one of equals; vectors of other length are left out too.
Components of eigenvalue 0 cannot be scaled to variance 1 and are left out, so fewer than `most`
components may come back, and none for a single vector or equal ones. Integers beyond 2^62 count as 2^62. A
deviation of more than 38 digits is null. A component's entry of greatest size is positive. Null and repeated
ids and rows are rows like any others. An empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferbatch.session import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
ROOT_BITS = 240
DIGITS = 60
LIMB = 31
LIMBS = 6
MOST = 2**62
# Modular arithmetic multiplies two residues within 62 bits.
PRIME_BITS = 31


# --- exact sums -------------------------------------------------------------------


def integers(entries: np.ndarray, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """floor(scale * entry) + shift as 64-bit integers."""
    with np.errstate(over="ignore"):
        whole = np.floor(entries.astype(np.float64) * scale)
    return np.clip(whole, -MOST, MOST - 512).astype(np.int64) + shift


def products(y: np.ndarray) -> np.ndarray:
    """y' y in exact integers, as 64-bit numbers or, where these are too small, as Python's."""
    most = max(abs(int(y.min())), abs(int(y.max()))) ** 2 * len(y) if y.size else 0
    if most < 2**53:
        return (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return y.T @ y
    wide = y.astype(object)
    return wide.T @ wide


def matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """Entries of the vectors of each batch, one line a vector."""
    for batch in batches:
        flat = batch.column(batch.num_columns - 1).flatten()
        yield flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def _limbs(value: int) -> list[int]:
    sign, value = (-1 if value < 0 else 1), abs(value)
    return [sign * (value >> LIMB * k & (1 << LIMB) - 1) for k in range(LIMBS)]


def _total(rows: DataFrame, partial, cells: int) -> list[int]:
    """Add up, over all tasks, one exact integer per cell. `partial` maps batches to a vector of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [int(v) for v in partial(batches)]
        columns = [pa.array(c, pa.int64()) for c in zip(*(_limbs(v) for v in values))]
        yield pa.RecordBatch.from_arrays([pa.array(range(cells), pa.int64()), *columns], names=names)

    names = ["cell", *(f"l{k}" for k in range(LIMBS))]
    parts = rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    added = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect()
    out = [0] * cells
    for r in added:
        out[r["cell"]] = sum(r[f"l{k}"] << LIMB * k for k in range(LIMBS))
    return out


@dataclass(frozen=True)
class Moments:
    """Count, sums, centre and sums of centred products of the integer vectors."""

    n: int
    sums: list[int]
    centre: list[int]
    scatter: list[list[int]]  # n^2 V


def moments(rows: DataFrame, dim: int, scale: int = SCALE, shift: int = SHIFT) -> Moments:
    """Exact moments of the usable rows, whose only or last column is the vector."""

    def first(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(dim + 1, object)
        for m in matrices(batches, dim):
            x = integers(m, scale, shift)
            safe = x if np.abs(x).max(initial=0) < 2**40 else x.astype(object)
            total += np.append(safe.sum(0), len(x)).astype(object)
        return total

    *sums, n = _total(rows, first, dim + 1)
    centre = [(2 * s + n) // (2 * n) if n else 0 for s in sums]
    upper = np.triu_indices(dim)
    around = np.array(centre, object)

    def second(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(len(upper[0]) + dim, object)
        for m in matrices(batches, dim):
            y = centred(integers(m, scale, shift), around)
            ones = y.sum(0) if y.dtype == object or np.abs(y).max(initial=0) < 2**40 else y.astype(object).sum(0)
            total += np.append(products(y)[upper], ones).astype(object)
        return total

    found = _total(rows, second, len(upper[0]) + dim)
    first_moment = found[len(upper[0]) :]
    scatter = [[0] * dim for _ in range(dim)]
    for a, b, value in zip(*upper, found):
        scatter[a][b] = scatter[b][a] = n * value - first_moment[a] * first_moment[b]
    return Moments(n, sums, centre, scatter)


def centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """x - centre, in 64 bits if it fits."""
    if np.abs(x).max(initial=0) < 2**61 and all(abs(int(c)) < 2**61 for c in centre):
        return x - centre.astype(np.int64)
    return x.astype(object) - centre


# --- characteristic polynomial ----------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number of 32 bits."""
    if n < 2 or n % 2 == 0:
        return n == 2
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if n == a or x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes(most: int) -> list[int]:
    """The largest primes of `PRIME_BITS` bits whose product exceeds `most`."""
    found, product, p = [], 1, 1 << PRIME_BITS
    while product <= most:
        p -= 1
        if is_prime(p):
            found.append(p)
            product *= p
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - matrix) modulo p, lowest first; matrix holds residues."""
    h, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        pivots = np.flatnonzero(h[k + 1 :, k])
        if not len(pivots):
            continue
        i = k + 1 + pivots[0]
        if i != k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        # The same change of basis from the left and from the right.
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        below = 1
        weights = np.zeros(k, np.int64)
        weights[k - 1] = h[k - 1, k - 1]
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            weights[i - 1] = int(h[i - 1, k - 1]) * below % p
        polys[k] = (polys[k] - (polys[:k] * weights[:, None] % p).sum(0)) % p
    return polys[d]


def characteristic_polynomial(spark, scatter: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x I - scatter), lowest first, of a matrix without negative eigenvalues.

    The primes are rows of a Spark table; their number follows from the bits of the coefficients.
    """
    d, trace = len(scatter), sum(scatter[k][k] for k in range(len(scatter)))
    most = max(math.comb(d, k) * trace**k // d**k for k in range(d + 1)) + 1
    chosen = primes(2 * most + 1)
    flat = [v for row in scatter for v in row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column(0).to_pylist()
            found = [polynomial_modulo(np.array([v % p for v in flat], np.int64).reshape(d, d), p).tolist() for p in ps]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    table = spark.createDataFrame([(p,) for p in chosen], "p bigint").repartition("p")
    residues = {r["p"]: r["c"] for r in table.mapInArrow(run, "p bigint, c array<bigint>").collect()}
    return remaindered([residues[p] for p in chosen], chosen)


def remaindered(residues: list[list[int]], moduli: list[int]) -> list[int]:
    """The integers of least size with the given residues."""
    product = math.prod(moduli)
    parts = [product // p * pow(product // p, -1, p) for p in moduli]
    out = []
    for column in zip(*residues):
        value = sum(c * part for c, part in zip(column, parts)) % product
        out.append(value - product if 2 * value > product else value)
    return out


# --- roots ------------------------------------------------------------------------


def roots_beyond(poly: list[int], num: int, bits: int) -> int:
    """How many roots (all real) are greater than num / 2^bits, each as often as it is repeated."""
    d = len(poly) - 1
    # q(t) = 2^(bits d) poly((t + num) / 2^bits): integer coefficients, roots moved to the point.
    q = [c << bits * (d - k) for k, c in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            q[k] += num * q[k + 1]
    signs = [c > 0 for c in q if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(poly: list[int], num: int, bits: int) -> int:
    """Sign of the polynomial at num / 2^bits."""
    value, step = 0, 0
    for c in reversed(poly):
        value = value * num + (c << step)
        step += bits
    return (value > 0) - (value < 0)


@dataclass(frozen=True)
class Root:
    """A root below or at (num + 1) / 2^bits and above num / 2^bits, with the times it is repeated."""

    num: int
    bits: int
    times: int


def middle(root: Root) -> Decimal:
    """The middle of a root's interval, to the precision in force: close to the root, and no root itself as a rule."""
    twice = Decimal(2 * root.num + 1) / 2
    return twice * 2**-root.bits if root.bits < 0 else twice / 2**root.bits


def largest_roots(poly: list[int], most: int, root_bits: int = ROOT_BITS) -> list[Root]:
    """The largest positive roots of a polynomial with real, non-negative roots, falling; `most` at least
    when each is counted as often as it is repeated, if there are as many."""
    d = len(poly) - 1
    zeros = next(k for k, c in enumerate(poly) if c)
    poly, d = poly[zeros:], d - zeros
    if not d or not most:
        return []
    # No root exceeds the sum of all.
    top = (-poly[d - 1]).bit_length()
    out, counted = [], 0
    # Intervals (num, num + 1] / 2^bits, negative bits for whole powers, with the roots beyond either end.
    todo = [(0, -top, d, 0)]
    while todo and counted < most:
        num, bits, beyond_low, beyond_high = todo.pop()
        times = beyond_low - beyond_high
        if not times or beyond_high >= most:
            continue
        size = num.bit_length()
        if times == 1 and num:
            root = _refined(poly, num, bits, root_bits)
        elif size >= root_bits:
            root = Root(num, bits, times)
        else:
            beyond = roots_beyond(*_scaled(poly, 2 * num + 1, bits + 1))
            # The upper half is looked at first.
            todo.append((2 * num, bits + 1, beyond_low, beyond))
            todo.append((2 * num + 1, bits + 1, beyond, beyond_high))
            continue
        out.append(root)
        counted += times
    return out


def _scaled(poly: list[int], num: int, bits: int) -> tuple[list[int], int, int]:
    return (poly, num, bits) if bits >= 0 else (poly, num << -bits, 0)


def _refined(poly: list[int], num: int, bits: int, root_bits: int) -> Root:
    """Halve an interval that holds one simple root until its number has enough bits."""
    # The sign between the lower end and the root; none where the root is the upper end.
    low = -sign_at(*_scaled(poly, num + 1, bits))
    while num.bit_length() < root_bits:
        num, bits = 2 * num, bits + 1
        sign = sign_at(*_scaled(poly, num + 1, bits))
        # The root is in the upper half unless the polynomial has changed its sign, or is zero, at the middle.
        if not low or sign == low:
            num += 1
    return Root(num, bits, 1)


# --- components -------------------------------------------------------------------


def null_space(scatter: list[list[int]], root: Root, digits: int = DIGITS) -> list[list[Decimal]]:
    """Orthonormal vectors of the null space of scatter - root I, as many as the root is repeated."""
    ctx = Context(prec=digits + 20, Emax=10**9, Emin=-(10**9))
    d = len(scatter)
    with localcontext(ctx):
        value = middle(root)
        m = np.array([[+Decimal(v) for v in row] for row in scatter], object)
        size = max(abs(x) for x in m.flat)
        for k in range(d):
            m[k, k] -= value
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(m[i, k]))
            if best != k:
                m[[k, best]] = m[[best, k]]
                order[k], order[best] = order[best], order[k]
            if not m[k, k]:
                # Exactly singular: a pivot below everything else takes its place.
                m[k, k] = size * Decimal(10) ** -(2 * digits)
            if k + 1 < d:
                m[k + 1 :, k] = m[k + 1 :, k] / m[k, k]
                m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
        start = np.random.default_rng(d).integers(1, 1000, (d, root.times))
        vectors = [np.array([Decimal(int(x)) for x in start[:, j]], object) for j in range(root.times)]
        for _ in range(4):
            vectors = _orthonormal([_solved(m, v[order]) for v in vectors])
    return [list(v) for v in vectors]


def _solved(lu: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, d = b.copy(), len(b)
    for k in range(1, d):
        x[k] -= lu[k, :k] @ x[:k]
    for k in range(d - 1, -1, -1):
        x[k] = (x[k] - (lu[k, k + 1 :] @ x[k + 1 :] if k + 1 < d else 0)) / lu[k, k]
    return x


def _orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for v in vectors:
        v = v / max(abs(x) for x in v)
        for _ in range(2):
            for u in out:
                v = v - u * (u @ v)
        out.append(v / (v @ v).sqrt())
    return out


# --- whitening --------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """What whitening needs; `components` has a line per component, falling by eigenvalue of V."""

    n: int
    sums: list[int]
    centre: list[int]
    components: np.ndarray
    eigenvalues: list[float]
    explained: list[float]
    scale: int = SCALE
    shift: int = SHIFT

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) projected on each component, over the square root of its eigenvalue."""
        y = centred(x, np.array(self.centre, object))
        rest = [float(Decimal(s - self.n * c) / self.n) for s, c in zip(self.sums, self.centre)]
        out = np.zeros((len(x), len(self.components)))
        # One column after the other: a row's result does not depend on the rows beside it.
        for j in range(len(self.centre)):
            out += (y[:, j].astype(np.float64) - rest[j])[:, None] * self.components[:, j]
        return out / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - sum)^2."""
        y = centred(x, np.array(self.centre, object))
        rest = [s - self.n * c for s, c in zip(self.sums, self.centre)]
        most = max(1, int(np.abs(y).max(initial=0)))
        fits = most**2 * len(rest) < 2**63 and most * max((abs(r) for r in rest), default=0) * len(rest) < 2**63
        wide = y if fits else y.astype(object)
        squares = (wide * wide).sum(1).tolist()
        cross = (wide * np.array(rest, np.int64 if fits else object)).sum(1).tolist()
        constant = sum(r * r for r in rest)
        return [self.n * self.n * s - 2 * self.n * c + constant for s, c in zip(squares, cross)]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v) with finite entries."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter((F.size("v") > 0) & ~bad)


def common_dimension(rows: DataFrame) -> int:
    """The most frequent length of the vectors, 0 without any."""
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return common["dim"] if common else 0


def fit(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS,
    scale: int = SCALE, shift: int = SHIFT,
) -> Model | None:
    """Components of the covariance of all usable rows, or None where no row is usable."""
    rows = usable(vectors, id_col, vector_col)
    dim = common_dimension(rows)
    if not dim:
        return None
    found = moments(rows.filter(F.size("v") == dim).select("v"), dim, scale, shift)
    trace = sum(found.scatter[k][k] for k in range(dim))
    poly = characteristic_polynomial(vectors.sparkSession, found.scatter) if trace else [0] * dim + [1]
    lines, values, shares = [], [], []
    for root in largest_roots(poly, most):
        value = middle(root)
        for v in null_space(found.scatter, root):
            top = max(range(dim), key=lambda k: abs(round(float(v[k]), 12)))
            lines.append([float(x) if v[top] > 0 else float(-x) for x in v])
            values.append(float(value / found.n / found.n))
            shares.append(float(value / trace))
    lines = np.array(lines[:most], float).reshape(-1, dim)
    return Model(found.n, found.sums, found.centre, lines, values[:most], shares[:most], scale, shift)


def transformed(vectors: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, deviation (decimal) and whitened (array of double) of every usable row of the model's dimension."""
    dim = len(model.centre)
    rows = usable(vectors, id_col, vector_col).filter(F.size("v") == dim)
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(next(matrices(iter([batch]), dim)), model.scale, model.shift)
            far = [Decimal(v) if v < 10**38 else None for v in model.deviations(x)]
            columns = [batch.column(0), pa.array(far, pa.decimal128(38, 0)), pa.array(list(model.whitened(x)), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "deviation", "whitened"])

    return rows.mapInArrow(run, f"id {kind.simpleString()}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    cells = [(a, b) for a in range(components) for b in range(a + 1)]
    if not cells:
        return 0.0
    w = [F.col("whitened")[k] for k in range(components)]
    row = whitened.agg(*[F.covar_pop(w[a], w[b]).alias(f"c{a}_{b}") for a, b in cells]).first()
    return max(abs((row[f"c{a}_{b}"] or 0.0) - (a == b)) for a, b in cells)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, id_col, vector_col, most)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double"
    )
    if model is None or not len(model.components):
        return vectors.sparkSession.createDataFrame([], schema)
    rows = materialize(transformed(vectors, model, id_col, vector_col), "whitened")
    error = identity_error(rows, len(model.components))
    shares = F.array(*[F.lit(s) for s in model.explained])
    return rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
