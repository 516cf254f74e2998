"""Whitening of embeddings by an exact characteristic polynomial.

Entries become whole numbers (floor of ``SCALE`` times the entry). Over the distinct vectors, Spark sums
their entries and products exactly; n times the products less the product of the sums is n² times
their covariance, an integer matrix M. Its characteristic polynomial is found modulo as many 31-bit
primes as its coefficients need, one prime a row of a Spark job: Hessenberg form, then the
recurrence of its leading minors. Chinese remaindering gives the whole coefficients. All roots
are real, so the sign changes of the shifted polynomial count the roots above a point exactly, and
bisection isolates each of the largest to a relative width of 2**-ROOT_BITS. Each component is the
null space of M less its root, found by inverse iteration in fixed-point numbers of WORK_BITS bits.

The driver holds d² sums, d coefficients a prime and the components, for vectors of d entries:
nothing that grows with the number of rows.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are dropped, and
so are vectors of another length than the commonest (of equally common ones the longest); entries
beyond 64 bits count as the nearest 64-bit number; a deviation beyond 64 bits is null; repeated rows
are fitted once and returned each, those without an id as well; equal roots give any orthonormal
vectors of their space; there are as many components as positive roots, at most ``components``, so
none for a single distinct vector, and then no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioquant.llm.common import cut_lineage, map_arrow, read_table

SCALE = 256
COMPONENTS = 4
ROOT_BITS = 160
WORK_BITS = 640
_LIMB = 20  # bits of the parts whose products double precision sums exactly
_LIMB_ROWS = 4096
_PARTS, _PART_BITS = 6, 32  # exact sums travel as parts of 32 bits


def scaled_vectors(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """key, dim and x: the whole numbers of each usable row, packed in as few bytes an entry as they need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = np.diff(ends)
            kept, dims, packed = [], [], []
            for dim in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == dim)
                entries = values[ends[rows][:, None] + np.arange(dim)]
                usable = np.isfinite(entries).all(axis=1)
                rows, entries = rows[usable], np.floor(entries[usable] * scale)
                whole = np.where(
                    entries >= 2.0**63, np.iinfo(np.int64).max, np.clip(entries, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
                )
                reach = np.maximum(whole.max(axis=1, initial=0), -1 - whole.min(axis=1, initial=0))
                width = np.where(reach < 1 << 15, 2, np.where(reach < 1 << 31, 4, 8))
                for w in np.unique(width):
                    data = whole[width == w].astype(f"<i{w}")
                    packed += [r.tobytes() for r in data]
                    kept += rows[width == w].tolist()
                    dims += [int(dim)] * len(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], [key, "dim", "x"]
            )

    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("dim", T.IntegerType()), T.StructField("x", T.BinaryType())])
    return map_arrow(vectors.select(key, F.col(vector).cast("array<double>")), run, schema)


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    """The packed vectors as a matrix of 64-bit numbers, in their order."""
    values = column.to_pylist()
    out = np.empty((len(values), dim), np.int64)
    widths = np.array([len(v) for v in values]) // dim
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        out[rows] = np.frombuffer(b"".join(values[i] for i in rows), f"<i{w}").reshape(-1, dim)
    return out


def exact_products(x: np.ndarray) -> list[list[int]]:
    """Sums of products of the columns of 64-bit numbers, as Python integers.

    Numbers are cut into limbs of 20 bits; products of limbs are summed exactly in double precision
    over at most 4096 rows.
    """
    limbs, rest = [], x
    while True:
        low = rest & ((1 << _LIMB) - 1)
        rest = rest >> _LIMB
        if ((rest == 0) | (rest == -1)).all():  # the last limb has the sign
            limbs.append((low + (rest << _LIMB)).astype(np.float64))
            break
        limbs.append(low.astype(np.float64))
    d = x.shape[1]
    total = np.zeros((d, d), object)
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs):
            part = np.zeros((d, d), np.int64)
            for at in range(0, len(x), _LIMB_ROWS):
                part += (left[at : at + _LIMB_ROWS].T @ right[at : at + _LIMB_ROWS]).astype(np.int64)
            total += part.astype(object) << (_LIMB * (a + b))
    return total.tolist()


def _parts_of(value: int) -> list[int]:
    """value as parts of 32 bits, the last with the sign."""
    return [(value >> (_PART_BITS * k)) & ((1 << _PART_BITS) - 1) for k in range(_PARTS - 1)] + [value >> (_PART_BITS * (_PARTS - 1))]


def scatter(fit: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, products) of the distinct vectors, exact. Each task sends one row an entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, [0] * dim, [[0] * dim for _ in range(dim)]
        for batch in batches:
            x = _unpack(batch.column(0), dim)
            n += len(x)
            limbs = (x & ((1 << 32) - 1), x >> 32)
            low, high = (part.sum(axis=0).tolist() for part in limbs)
            sums = [s + a + (b << 32) for s, a, b in zip(sums, low, high)]
            for row, more in zip(products, exact_products(x)):
                row[:] = [a + b for a, b in zip(row, more)]
        if not n:
            return
        entries = [(-2, 0, n)] + [(-1, j, s) for j, s in enumerate(sums)]
        entries += [(i, j, products[i][j]) for i in range(dim) for j in range(i + 1)]
        columns = list(zip(*[(i, j, *_parts_of(v)) for i, j, v in entries]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.int64()) for k, c in enumerate(columns)], names)

    names = ["i", "j"] + [f"p{k}" for k in range(_PARTS)]
    rows = map_arrow(fit.select("x"), run, "i int, j int, " + ", ".join(f"p{k} long" for k in range(_PARTS)))
    total = rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect()
    n, sums, products = 0, [0] * dim, [[0] * dim for _ in range(dim)]
    for i, j, *parts in total:
        value = sum(int(p) << (_PART_BITS * k) for k, p in enumerate(parts))
        if i == -2:
            n = value
        elif i == -1:
            sums[j] = value
        else:
            products[i][j] = products[j][i] = value
    return n, sums, products


# The characteristic polynomial.


def _is_prime(n: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):  # enough below 3.2 billion
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """31-bit primes, from the largest, whose product exceeds bound."""
    found, product, candidate = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(candidate):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def polynomial_modulo(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients, from the constant one, of the characteristic polynomial modulo a 31-bit prime."""
    a = np.array([[v % p for v in row] for row in matrix], np.int64)
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            a[[k + 1, pivot]] = a[[pivot, k + 1]]
            a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        factors = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factors[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factors % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(d):
        weights, down = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            down = down * int(a[i + 1, i]) % p
            weights[i] = int(a[i, k]) * down % p
        following = np.roll(minors[k], 1)
        following = (following - a[k, k] * minors[k] % p - (weights[:, None] * minors[:k] % p).sum(axis=0)) % p
        minors[k + 1] = following
    return minors[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients from the constant one; matrix is symmetric and has no negative root."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # The k-th symmetric function of d numbers of that sum that are not negative is largest for equal ones.
    bound = max(math.comb(d, k) * (Fraction(trace, d) ** k).__ceil__() for k in range(d + 1))
    primes = primes_beyond(2 * bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ps, pa.int64()), pa.array([polynomial_modulo(matrix, p) for p in ps], pa.list_(pa.int64()))], ["p", "residues"]
            )

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 32))
    coefficients, modulus = [0] * (d + 1), 1
    for p, residues in map_arrow(rows, run, "p long, residues array<long>").collect():
        inverse = pow(modulus, -1, p)
        coefficients = [c + modulus * ((r - c) * inverse % p) for c, r in zip(coefficients, residues)]
        modulus *= p
    return [c - modulus if 2 * c > modulus else c for c in coefficients]


def roots_above(coefficients: list[int], point: int, shift: int) -> int:
    """How many roots, counted as often as they occur, exceed point / 2**shift (all roots are real)."""
    d = len(coefficients) - 1
    c = [v << (shift * (d - k)) for k, v in enumerate(coefficients)]
    for start in range(d):  # the Taylor coefficients at the point
        for k in range(d - 1, start - 1, -1):
            c[k] += point * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


@dataclass
class Root:
    """A root between low and high (over 2**shift) and how often it occurs there."""

    low: int
    high: int
    shift: int
    times: int

    @property
    def value(self) -> Fraction:
        return Fraction(self.low + self.high, 1 << (self.shift + 1))


def largest_roots(coefficients: list[int], count: int, bits: int = ROOT_BITS) -> list[Root]:
    """The largest positive roots, falling; together they occur at least ``count`` times if so many are positive."""
    top = 1 << max(sum(abs(c) for c in coefficients[-2:-1]).bit_length(), 1)  # beyond the sum of all roots
    wanted = min(count, roots_above(coefficients, 0, 0))
    found: list[Root] = []
    done = 0
    while done < wanted:
        low, high, shift, above = 0, top, 0, done
        while low == 0 or (high - low) << bits > low:
            if high - low == 1:
                low, high, shift = 2 * low, 2 * high, shift + 1
            middle = (low + high) // 2
            n = roots_above(coefficients, middle, shift)
            if n > done:
                low = middle
            else:
                high = middle
        above = roots_above(coefficients, low, shift)
        found.append(Root(low, high, shift, above - done))
        done = above
    return found


def _fixed_lu(matrix: list[list[int]], value: Fraction, trace: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """LU of (matrix - value) / trace in fixed-point numbers, with the order of its rows."""
    d = len(matrix)
    one = 1 << bits
    a = np.array([[(v << bits) // trace for v in row] for row in matrix], object)
    a[np.arange(d), np.arange(d)] -= int(value * one / trace)
    order = np.arange(d)
    for k in range(d):
        pivot = k + int(np.argmax([abs(v) for v in a[k:, k]]))
        a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            factors = np.array([(v << bits) // a[k, k] for v in a[k + 1 :, k]], object)
            a[k + 1 :, k] = factors
            a[k + 1 :, k + 1 :] -= (factors[:, None] * a[k, k + 1 :]) >> bits
    return a, order


def _fixed_solve(lu: np.ndarray, order: np.ndarray, v: np.ndarray, bits: int) -> np.ndarray:
    x = v[order].copy()
    d = len(x)
    for k in range(d):
        x[k + 1 :] -= (lu[k + 1 :, k] * x[k]) >> bits
    for k in range(d - 1, -1, -1):
        x[k] = (x[k] << bits) // lu[k, k]
        x[:k] -= (lu[:k, k] * x[k]) >> bits
    return x


def _fixed_unit(v: np.ndarray, bits: int) -> np.ndarray:
    norm = math.isqrt(int((v * v).sum()))
    return np.array([(int(x) << bits) // norm for x in v], object)


def null_vectors(matrix: list[list[int]], root: Root, count: int, bits: int = WORK_BITS) -> np.ndarray:
    """count orthonormal vectors of the root's space, in double precision, by inverse iteration."""
    d = len(matrix)
    lu, order = _fixed_lu(matrix, root.value, sum(matrix[i][i] for i in range(d)), bits)
    found: list[np.ndarray] = []
    for k in range(count):
        start = np.random.default_rng(k + 1).integers(-(1 << 30), 1 << 30, d)
        v = _fixed_unit(np.array([int(x) << (bits - 30) for x in start], object), bits)
        for _ in range(3):
            v = _fixed_unit(_fixed_solve(lu, order, v, bits), bits)
            for u in found:
                v = v - ((u * (int((u * v).sum()) >> bits)) >> bits)
            v = _fixed_unit(v, bits)
        found.append(v)
    return np.array([[float(Fraction(int(x), 1 << bits)) for x in v] for v in found])


@dataclass
class Whitening:
    """Fitted on n distinct vectors of one length; components are rows, by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: list[float]
    explained: list[float]

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([float(Fraction(s, self.n)) for s in self.sums])
        return (x.astype(np.float64) - mean) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n x - sums)², exact; null beyond 64 bits."""
        reach = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums))
        if x.shape[1] * reach * reach < 1 << 63:
            away = self.n * x - np.array(self.sums, np.int64)
            return (away * away).sum(axis=1).tolist()
        away = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (away * away).sum(axis=1)]


def fit_whitening(spark: SparkSession, fit: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """From distinct packed vectors (column x); None where there are none."""
    n, sums, products = scatter(fit, dim)
    if not n:
        return None
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    trace = sum(matrix[i][i] for i in range(dim))
    vectors, values, shares = [], [], []
    if trace:
        for root in largest_roots(characteristic_polynomial(spark, matrix), components):
            for v in null_vectors(matrix, root, min(root.times, components - len(vectors))):
                vectors.append(v)
                values.append(float(root.value / (n * n)))
                shares.append(float(root.value / trace))
    return Whitening(n, sums, np.array(vectors).reshape(len(vectors), dim), values, shares)


def identity_error(fit: DataFrame, dim: int, model: Whitening) -> float:
    """Largest entry of the whitened covariance over the fit list less the identity; one pass, one row a task."""
    k = len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.project(_unpack(batch.column(0), dim))
            sums += w.sum(axis=0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k)), pa.array([*sums, *products.ravel()])], ["at", "value"])

    rows = map_arrow(fit.select("x"), run, "at long, value double").groupBy("at").agg(F.sum("value")).collect()
    flat = np.zeros(k + k * k)
    for at, value in rows:
        flat[at] = value / model.n
    mean, second = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row per usable row of vectors and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    schema = T.StructType([
        T.StructField(key, vectors.schema[key].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ])
    rows = scaled_vectors(vectors, key, vector, scale)
    commonest = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if commonest is None:
        return spark.createDataFrame([], schema)
    dim = commonest["dim"]
    rows = rows.where(F.col("dim") == dim)
    fit = cut_lineage(rows.select("x").distinct())
    model = fit_whitening(spark, fit, dim, components)
    if not len(model.components):
        return spark.createDataFrame([], schema)
    error = identity_error(fit, dim, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.components)
        for batch in batches:
            x = _unpack(batch.column(1), dim)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(each), error)),
                ],
                schema.names,
            )

    return map_arrow(rows.select(key, "x"), run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the four largest components."""
    return whiten(read_table(spark, sf_dir, "embeddings"))
