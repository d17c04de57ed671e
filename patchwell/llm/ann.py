"""Nearest neighbours by inner product through randomly rotated one-bit codes.

Each vector is stored as the signs of its rotated unit vector, its length and one correction
scalar. Counting the bits that a code has in common with a query's bit planes estimates an inner
product without bias, with an error bound; a vector is compared exactly only if its bound reaches the
k-th score among the best estimates of its block.

Stated results: vectors of any finite size take part. Scores are sums in doubles; a sum that overflows
is infinite with the sign of the inner product, products too small are zero, and equal scores, also
infinite ones, go to the smaller id. An inner product of two overflowing sums that cancel has no
better answer than its scaled one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchwell.llm.common import written

#: Standard deviations of the estimate's error that a bound allows for.
SIGMAS = 4.0
#: Vectors met by a block of queries at once; fewer where that would leave tasks without work.
VECTOR_BLOCK = 32_768
LEAST_BLOCK = 1_024
QUERY_BLOCK = 16_384
#: Best estimates compared first, for each neighbour asked for.
FIRST = 8
#: Bits of a query's components in an estimate.
QUERY_BITS = 8


def rotation(size: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix, uniform over all."""
    gauss = np.random.default_rng([seed, size]).standard_normal((size, size))
    q, r = np.linalg.qr(gauss)
    return q * np.sign(np.diag(r))


def unit_and_length(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 and the lengths, by way of the largest component: no square overflows or
    vanishes at any size of finite components. A length beyond all doubles is infinite."""
    largest = np.abs(vectors).max(axis=1)
    # two steps, as the inverse of a subnormal number overflows
    even = np.ldexp(vectors, -np.frexp(largest)[1][:, None])
    size = np.sqrt((even * even).sum(axis=1))
    with np.errstate(over="ignore"):
        return even / size[:, None], np.ldexp(size, np.frexp(largest)[1])


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths and corrections (inner product of the unit vector and its code)."""
    unit, length = unit_and_length(vectors)
    turned = unit @ turn.T
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


CODED = "vec_id long, dim int, embedding array<double>, code binary, length double, correction double"


def index(vectors: DataFrame, seed: int = 0) -> DataFrame:
    """``vec_id, dim, embedding, code, length, correction`` of every vector that takes part: not
    null, not empty, not zero, all components finite, with an id."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable & nonzero)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                matrix = own.column("embedding").flatten().to_numpy().reshape(-1, size)
                code, length, correction = encode(matrix, rotation(int(size), seed))
                columns = [
                    own.column("vec_id"),
                    pa.array(np.full(len(matrix), size, np.int32)),
                    own.column("embedding"),
                    pa.array([x.tobytes() for x in code], pa.binary()),
                    pa.array(length),
                    pa.array(correction),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.strip().split(" ")[0] for x in CODED.split(",")])

    return rows.mapInArrow(run, CODED)


def _words(code: np.ndarray) -> np.ndarray:
    """Packed codes as columns of 64-bit words, filled up with zeros."""
    padded = np.zeros((len(code), -(-code.shape[1] // 8) * 8), np.uint8)
    padded[:, : code.shape[1]] = code
    return np.ascontiguousarray(padded.view(np.uint64).T)


def _planes(turned: np.ndarray) -> tuple[np.ndarray, float, float]:
    """A turned query in steps of one 255th of its range: the bits of its steps as packed planes,
    the least value and the step."""
    least = float(turned.min())
    step = max((float(turned.max()) - least) / (2**QUERY_BITS - 1), 1e-300)
    steps = np.rint((turned - least) / step).astype(np.uint64)
    planes = [np.packbits((steps >> np.uint64(j) & np.uint64(1)).astype(bool)) for j in range(QUERY_BITS)]
    return _words(np.stack(planes)).T, least, step


def estimates(words: np.ndarray, ones: np.ndarray, turned: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Inner products of a turned query with the codes (components of one over the root of ``size``),
    by counting common bits of the codes and the query's planes, and how far rounding can be off."""
    planes, least, step = _planes(turned)
    total = np.zeros(words.shape[1], np.int64)
    for j, plane in enumerate(planes):
        common = np.bitwise_count(words[0] & plane[0]).astype(np.int64)
        for w in range(1, len(words)):
            common += np.bitwise_count(words[w] & plane[w])
        total += common << j
    root = np.sqrt(size)
    return (2 * (step * total + least * ones) - turned.sum()) / root, step * size / root


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in doubles; where products overflow, those of the scaled vectors, which have
    a sign and may be infinite."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = (vectors * query).sum(axis=1)
        odd = np.flatnonzero(~np.isfinite(score))
        if len(odd):
            unit, length = unit_and_length(vectors[odd])
            own, size = unit_and_length(query[None, :])
            cosine = (unit * own[0]).sum(axis=1)
            score[odd] = np.where(cosine == 0, 0.0, cosine * length * size[0])
    return score


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, code: np.ndarray, length: np.ndarray, correction: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids and scores of each query's ``k`` nearest, without itself.

    The best estimates are compared exactly first; their k-th score is the bar that the bound of
    every other vector must reach. All is measured for queries of length 1, so that no size of
    components matters; what overflows or vanishes in doubles is compared exactly."""
    size = vectors.shape[1]
    words, ones = _words(code), np.bitwise_count(code).sum(axis=1).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = length / correction
        spread = scale * (SIGMAS * np.sqrt(np.maximum(0, 1 - correction**2) / max(1, size - 1)) + 1e-9)
    units, norms = unit_and_length(queries)
    turned = units @ turn.T
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, own in enumerate(query_ids):
        estimate, off = estimates(words, ones, turned[q], size)
        with np.errstate(over="ignore", invalid="ignore"):
            estimate, error = estimate * scale, spread + off * scale
            # products too small for doubles are zero, and scores beyond them equal
            error = error + size * 2.0**-1074 / norms[q]
            beyond = min(np.finfo(float).max / norms[q], np.finfo(float).max) / 2
            high = estimate + error
        high[np.isnan(high)] = np.inf
        high[ids == own] = -np.inf
        others = np.flatnonzero(high > -np.inf)
        if len(others) > k:
            some = min(FIRST * k, len(others)) - 1
            first = others[np.argpartition(-np.nan_to_num(estimate[others]), some)[: some + 1]]
            with np.errstate(over="ignore"):
                bar = -np.partition(-_exact(vectors[first], queries[q]), k - 1)[k - 1] / norms[q]
            bar = beyond if bar > beyond else -np.inf if bar < -beyond else bar - abs(bar) * 1e-9
            others = others[high[others] >= bar]
        score = _exact(vectors[others], queries[q])
        if len(score) > k:  # sort those alone that reach the k-th
            top = score >= -np.partition(-score, k - 1)[k - 1]
            others, score = others[top], score[top]
        best = np.lexsort((ids[others], -score))[:k]
        out.append((np.full(len(best), own), ids[others][best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("embedding").combine_chunks().flatten().to_numpy()
    return flat.reshape(table.num_rows, -1)


def search(coded: DataFrame, is_query: F.Column, k: int, seed: int = 0, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: of every row of ``coded`` (an :func:`index`) that is a
    query its ``k`` nearest among all others of its dimension, by inner product, ties to the
    smaller id; all if fewer. Rows that share the query's id are left out as its own.

    Queries and vectors are cut into blocks by id, and every block of queries meets every block
    of vectors in a task of a bounded size. With few queries, blocks of vectors are met once."""
    counts = coded.agg(F.count("*"), F.count_if(is_query)).first()
    tasks = coded.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-counts[0] // vector_block), min(tasks, counts[0] // LEAST_BLOCK))
    query_blocks = max(1, -(-counts[1] // query_block))

    def block(n: int) -> F.Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    vectors = coded.withColumn("_v", block(blocks)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = coded.where(is_query).select("vec_id", "dim", "embedding").withColumn("_q", block(query_blocks))
    asked = asked.withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        matrix, asked = _matrix(vectors), _matrix(queries)
        code = np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint8).reshape(len(matrix), -1)
        ids, length, correction = (vectors.column(c).to_numpy() for c in ("vec_id", "length", "correction"))
        turn = rotation(matrix.shape[1], seed)
        found = nearest_in_block(asked, queries.column("vec_id").to_numpy(), matrix, ids, code, length, correction, turn, k)
        return pa.table(list(found), schema=schema)

    keys = ["dim", "_v", "_q"]
    found = vectors.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, seed: int = 0) -> DataFrame:
    """Builds the index, stores it and searches it."""
    return search(written(index(vectors, seed), "codes"), is_query, k, seed)
