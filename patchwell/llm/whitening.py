"""Whitening of embeddings by an exact characteristic polynomial.

Vectors become whole numbers, so their scatter matrix is exact. Its characteristic polynomial is
computed modulo many primes, each in a task of its own (Hessenberg form by similarity, then the
recurrence of its minors), and put together by Chinese remaindering. All roots of a scatter matrix
are real, so the sign changes of the polynomial shifted to a say exactly how many roots exceed a:
bisection isolates each root to any precision, multiple ones included. A component spans the null
space of the matrix less its root, found by inverse iteration in wide fixed point.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchwell.llm.common import mix, written

SCALE, SHIFT = 64, 1_000_000
#: Entries whose scaled value is beyond this have no whole number of 64 bits.
MOST = float(2**62)
COMPONENTS = 16
#: Whole numbers travel in parts of so many bits, so that Spark can add them up.
LIMB_BITS = 56
#: Bits behind the point of a root, relative to the unit of the scatter matrix; and of the
#: inverse iteration.
ROOT_BITS, WORK_BITS = 160, 360


@dataclass(frozen=True)
class Fit:
    """What the distinct vectors of one length say; d by d numbers at most."""

    size: int
    n: int
    sums: list[int]
    trace: int
    #: (root of the scatter matrix, unit vector), by falling root; positive roots alone
    components: list[tuple[float, list[float]]]


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, x``: entries as whole numbers less ``SHIFT``, which no covariance notices.

    Rows whose vector is null or empty, or holds null or non-finite entries, are left out; so are
    those with an entry too large for a long."""
    given = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) * SCALE < MOST))
    fit = given.where(F.col("v").isNotNull() & (F.size("v") > 0) & good)
    return fit.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _exact_product(a: np.ndarray, most: int) -> np.ndarray:
    """a' a in whole numbers; by floating point or 64 bits where these are exact."""
    bound = most * most * len(a)
    if bound < 2**53:
        f = a.astype(float)
        return (f.T @ f).astype(np.int64)
    return (x := a if bound < 2**63 else a.astype(object)).T @ x


def _limbs(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB_BITS) - 1)))
        value >>= LIMB_BITS
    return out


def _moments(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of products, sums and counts, as limbs at their place."""
    total = np.zeros((size + 1, size + 1), object)
    for batch in batches:
        x = _matrix(batch.column("x"), size)
        one = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
        total = total + _exact_product(one, max(1, int(x.max(initial=0)), -int(x.min(initial=0))))
    rows = [
        (i * (size + 1) + j, k, part)
        for i in range(size + 1)
        for j in range(i, size + 1)
        for k, part in enumerate(_limbs(int(total[i, j])))
    ]
    places, limbs, parts = zip(*rows) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(places, pa.int64()), pa.array(limbs, pa.int32()), pa.array(parts, pa.int64())],
        ["place", "limb", "part"],
    )


def scatter(vectors: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """Count n, sums S and n X'X - S S' of vectors of one length; (size + 1)^2 numbers."""
    moments = vectors.select("x").mapInArrow(lambda b: _moments(b, size), "place long, limb int, part long")
    added = moments.groupBy("place", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    product = [[0] * (size + 1) for _ in range(size + 1)]
    for place, limb, total in added.collect():  # (size + 1)^2 places of a few limbs
        i, j = divmod(place, size + 1)
        product[i][j] += int(total) << (LIMB_BITS * limb)
        product[j][i] = product[i][j]
    n, sums = product[size][size], product[size][:size]
    return n, sums, [[n * product[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]


# The characteristic polynomial


def _is_prime(n: int) -> bool:
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):  # enough below 3,215,031,751
        if a % n == 0:
            continue
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes below 2^31, from above, whose product has more than ``bits`` bits."""
    found, have, p = [], 0.0, 2**31 - 1
    while have <= bits:
        if _is_prime(p):
            found.append(p)
            have += math.log2(p)
        p -= 2
    return found


def coefficient_bits(trace: int, size: int) -> int:
    """Bits of the largest coefficient: symmetric means fall (Maclaurin), so that the k-th is at
    most binomial(size, k) (trace / size)^k."""
    if trace == 0:
        return 1
    mean = math.log2(trace) - math.log2(size)
    return math.ceil(max(math.log2(math.comb(size, k)) + k * mean for k in range(size + 1))) + 2


def polynomial_modulo(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(xI - matrix) modulo a prime below 2^31, the highest first."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    size = len(h)
    for k in range(size - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    minors = np.zeros((size + 1, size + 1), np.int64)  # of leading parts, lowest coefficient first
    minors[0, 0] = 1
    for k in range(1, size + 1):
        new = np.zeros(size + 1, np.int64)
        new[1:] = minors[k - 1, :-1]
        new = (new - h[k - 1, k - 1] * minors[k - 1]) % p
        along = 1
        for i in range(k - 2, -1, -1):
            along = along * int(h[i + 1, i]) % p
            if not along:
                break
            new = (new - int(h[i, k - 1]) * along % p * minors[i]) % p
        minors[k] = new
    return [int(c) for c in minors[size][::-1]]


def _residues(batches: Iterable[pa.RecordBatch], matrix: list[list[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for p in batch.column("prime").to_pylist():
            rows += [(k, p, r) for k, r in enumerate(polynomial_modulo(matrix, p))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["k", "prime", "residue"])


def remaindered(primes: list[int], residues: list[int]) -> int:
    """The whole number nearest zero with these residues."""
    value, modulus = 0, 1
    for p, r in zip(primes, residues):
        value += modulus * ((r - value) * pow(modulus, -1, p) % p)
        modulus *= p
    return value - modulus if 2 * value > modulus else value


def _combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ks, values = [], []
        for k, pairs in zip(batch.column("k").to_pylist(), batch.column("pairs").to_pylist()):
            ks.append(k)
            values.append(str(remaindered([x["prime"] for x in pairs], [x["residue"] for x in pairs])))
        if ks:
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(values)], ["k", "value"])


def _dealt(spark: SparkSession, values: list[int], name: str) -> DataFrame:
    tasks = min(len(values), int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = spark.range(len(values), numPartitions=max(1, tasks))
    return first.select(F.array(*[F.lit(v).cast("long") for v in values])[F.col("id").cast("int")].alias(name))


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(xI - matrix) of a scatter matrix, the highest first."""
    size = len(matrix)
    trace = sum(matrix[i][i] for i in range(size))
    primes = _dealt(spark, primes_for(coefficient_bits(trace, size)), "prime")
    residues = primes.mapInArrow(lambda b: _residues(b, matrix), "k long, prime long, residue long")
    pairs = F.sort_array(F.collect_list(F.struct("prime", "residue"))).alias("pairs")  # one for each prime
    found = residues.groupBy("k").agg(pairs).mapInArrow(_combined, "k long, value string").collect()
    return [int(value) for _, value in sorted((k, v) for k, v in found)]


# Roots


def _shifted(poly: list[int], a: int) -> list[int]:
    """Coefficients of poly(x + a), the highest first."""
    c = list(poly)
    for end in range(len(c), 1, -1):
        for i in range(1, end):
            c[i] += a * c[i - 1]
    return c


def roots_above(poly: list[int], a: int) -> int:
    """How many roots, each as often as it occurs, exceed ``a``, if all roots are real: the sign
    changes of poly(x + a)."""
    signs = [c > 0 for c in _shifted(poly, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(poly: list[int], a: int) -> int:
    total = 0
    for c in poly:
        total = total * a + c
    return total


def root(poly: list[int], trace: int, number: int, bits: int = ROOT_BITS) -> tuple[int, int, int]:
    """``(low, first, count)`` of the root that is ``number``-th from above: the root lies in
    (low, low + 1] / 2^bits, which holds ``count`` roots, the first of them number ``first``.

    Bisection by counts until the root is alone, then by signs. The first steps work with few bits
    behind the point, later ones with all."""
    low, high, digits = -1, trace, 0  # (low, high] / 2^digits has all roots
    above_low, above_high = len(poly) - 1, 0
    scaled = poly
    while digits < bits or high - low > 1:
        if high - low == 1:
            step = min(32, bits - digits)
            digits += step
            low, high = low << step, high << step
            scaled = [c << (k * digits) for k, c in enumerate(poly)]
        middle = (low + high) // 2
        if above_low - above_high == 1:
            # signs at both ends differ unless the root is at the upper end
            value = _value(scaled, middle)
            above = above_low if value and (value > 0) == (above_low % 2 == 0) else above_high
        else:
            above = roots_above(scaled, middle)
        if above >= number:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    return low, above_high + 1, above_low - above_high


# Components


def _solve(matrix: list[list[int]], low: int, root_bits: int, sides: np.ndarray, bits: int) -> np.ndarray:
    """Solutions of (matrix - root) y = side in fixed point of ``bits`` bits behind the point.

    Elimination with row pivoting; a pivot that vanishes counts as the smallest number, which is
    what makes the null space stand out."""
    size = len(matrix)
    shift = (2 * low + 1) << (bits - root_bits - 1)
    a = np.array(matrix, object) << bits
    for i in range(size):
        a[i, i] -= shift
    b = sides.copy()
    for k in range(size):
        at = k + max(range(size - k), key=lambda i: abs(a[k + i, k]))
        if at != k:
            a[[k, at]], b[[k, at]] = a[[at, k]], b[[at, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < size:
            factors = np.array([(int(v) << bits) // int(a[k, k]) for v in a[k + 1 :, k]], object)
            a[k + 1 :, k:] -= (factors[:, None] * a[k, k:]) >> bits
            b[k + 1 :] -= (factors[:, None] * b[k]) >> bits
    for k in range(size - 1, -1, -1):
        rest = b[k] - (((a[k, k + 1 :, None] * b[k + 1 :]).sum(axis=0) >> bits) if k + 1 < size else 0)
        b[k] = np.array([(int(v) << bits) // int(a[k, k]) for v in np.atleast_1d(rest)], object)
    return b


def _orthonormal(vectors: np.ndarray, bits: int) -> np.ndarray:
    """Columns made orthogonal and of length one, in fixed point; twice, for full precision."""
    out = vectors.copy()
    for _ in range(2):
        for j in range(out.shape[1]):
            for i in range(j):
                out[:, j] -= (out[:, i] * ((out[:, i] * out[:, j]).sum() >> bits)) >> bits
            length = math.isqrt(int((out[:, j] * out[:, j]).sum()))
            out[:, j] = np.array([(int(v) << bits) // max(1, length) for v in out[:, j]], object)
    return out


def null_space(matrix: list[list[int]], low: int, count: int, root_bits: int = ROOT_BITS, bits: int = WORK_BITS) -> np.ndarray:
    """``count`` orthonormal vectors, as columns of doubles, that belong to the roots in
    (low, low + 1] / 2^root_bits."""
    size = len(matrix)
    start = mix(np.arange(1, size * count + 1, dtype=np.uint64)).astype(np.int64)
    block = np.array([int(v) for v in start], object).reshape(size, count) << (bits - 64)
    for _ in range(2):
        found = _solve(matrix, low, root_bits, block, bits)
        # solutions are huge along the null space: bring them to about one before their lengths
        most = max(1, max(abs(int(v)) for v in found.reshape(-1)))
        found = np.array([(int(v) << bits) // most for v in found.reshape(-1)], object).reshape(size, count)
        block = _orthonormal(found, bits)
    return np.array([[int(v) / (1 << bits) for v in row] for row in block])


def _solved(batches: Iterable[pa.RecordBatch], poly: list[int], matrix: list[list[int]]) -> Iterator[pa.RecordBatch]:
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    for batch in batches:
        for number in batch.column("number").to_pylist():
            low, first, count = root(poly, trace, number)
            if low < 0:  # the root is zero: nothing varies along it
                continue
            vector = null_space(matrix, low, count)[:, number - first]
            value = (2 * low + 1) / (1 << (ROOT_BITS + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([value]), pa.array([vector.tolist()])], ["number", "root", "vector"]
            )


def fit(vectors: DataFrame, size: int, components: int) -> Fit:
    """Components of distinct vectors ``x`` of one length. The driver holds the scatter matrix and
    its polynomial, whose sizes depend on the length alone; primes and roots are solved in tasks."""
    n, sums, matrix = scatter(vectors, size)
    trace = sum(matrix[i][i] for i in range(size))
    if trace == 0:
        return Fit(size, n, sums, trace, [])
    spark = vectors.sparkSession
    poly = characteristic_polynomial(spark, matrix)
    numbers = _dealt(spark, list(range(1, min(components, size) + 1)), "number")
    schema = "number long, root double, vector array<double>"
    found = sorted(numbers.mapInArrow(lambda b: _solved(b, poly, matrix), schema).collect())
    return Fit(size, n, sums, trace, [(r, list(v)) for _, r, v in found])


# Rows


def _projected(x: np.ndarray, f: Fit) -> tuple[np.ndarray, list[int]]:
    """Whitened values, and the exact sums of (n x - S)^2."""
    most = max(f.n * max(1, int(x.max(initial=0)), -int(x.min(initial=0))), max(map(abs, f.sums)))
    wide = 4 * most * most * f.size >= 2**63
    centred = (x.astype(object) if wide else x) * f.n - np.array(f.sums, object if wide else np.int64)
    deviation = [int(v) for v in (centred * centred).sum(axis=1)]
    along = np.array([v for _, v in f.components], float).reshape(len(f.components), f.size)
    # e = root / n^2, so that the scatter's own scale cancels
    lengths = np.sqrt([r for r, _ in f.components])
    return centred.astype(float) @ along.T / lengths, deviation


def _whitened(batches: Iterable[pa.RecordBatch], f: Fit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        values, _ = _projected(_matrix(batch.column("x"), f.size), f)
        yield pa.RecordBatch.from_arrays([pa.array(values.tolist(), pa.list_(pa.float64()))], ["w"])


def _products(batches: Iterable[pa.RecordBatch], means: list[float]) -> Iterator[pa.RecordBatch]:
    k = len(means)
    total = np.zeros((k, k))
    for batch in batches:
        w = _matrix(batch.column("w"), k) - np.array(means)
        total += w.T @ w
    yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int64()), pa.array(total.reshape(-1))], ["place", "part"])


def identity_error(vectors: DataFrame, f: Fit) -> float:
    """Largest absolute entry of the covariance of the fit list's whitened values, less one on the
    diagonal; centred before multiplying."""
    k = len(f.components)
    white = vectors.select("x").mapInArrow(lambda b: _whitened(b, f), "w array<double>")
    means = list(white.agg(*[F.avg(F.col("w")[i]) for i in range(k)]).first())
    parts = white.mapInArrow(lambda b: _products(b, means), "place long, part double")
    covariance = np.zeros(k * k)
    for place, total in parts.groupBy("place").agg(F.sum("part")).collect():  # k^2 numbers
        covariance[place] = total / f.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double, deviation_exact string"
)


def _rows(batches: Iterable[pa.RecordBatch], f: Fit, error: float) -> Iterator[pa.RecordBatch]:
    k = len(f.components)
    explained = np.array([float(Decimal(r) / Decimal(f.trace)) for r, _ in f.components])
    names = [x.strip().split(" ")[0] for x in RESULT.split(",")]
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            values, deviation = _projected(_matrix(part.column("x"), f.size), f)
            rows = len(part)
            each = np.repeat(np.arange(rows), k)
            fits = pa.array([v if v < 2**63 else None for v in deviation], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, f.n, np.int64)),
                    fits.take(pa.array(each)),
                    pa.array(values.reshape(-1)),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                    pa.array([str(v) for v in deviation]).take(pa.array(each)),
                ],
                names,
            )


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every row with
    a usable vector and every component up to ``components``.

    Vectors that are null or empty, or hold null or non-finite entries, are left out, as are those
    with an entry beyond 2^62 / 64, which has no long. Components along which nothing varies have
    no whitened values and no rows: of n distinct vectors there are n - 1 components at most, and
    none of equal vectors. Repeated vectors count once in the fit and each have rows; null and
    repeated ids are kept. Vectors of different lengths are different spaces, each fitted by
    itself. A deviation beyond a long is null there and whole in ``deviation_exact``. An empty table
    gives no rows; columns other than ``vec_id`` and ``embedding`` are ignored."""
    spark = rows.sparkSession
    vectors = written(whole_vectors(rows).withColumn("_size", F.size("x")), "vectors")
    distinct = written(vectors.select("_size", "x").distinct(), "fit")
    found = []
    for (size,) in distinct.select("_size").distinct().sort("_size").collect():  # one length, as a rule
        own = distinct.where(F.col("_size") == size)
        f = fit(own, size, components)
        if f.components:
            error = identity_error(own, f)
            of_size = vectors.where(F.col("_size") == size).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
            found.append(of_size.mapInArrow(lambda b, f=f, error=error: _rows(b, f, error), RESULT))
    result = spark.createDataFrame([], RESULT)
    for part in found:
        result = result.union(part) if len(found) > 1 else part
    return result
