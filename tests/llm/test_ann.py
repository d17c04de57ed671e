from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchwell.llm import ann

SCHEMA = "vec_id long, embedding array<float>, code string, rank int"


def _rows(ids, matrix) -> list[tuple]:
    return [(int(i), [float(x) for x in v], "x", 1) for i, v in zip(ids, matrix)]


def _brute(ids, matrix, k) -> dict:
    out = {}
    for i, v in zip(ids, matrix):
        if i % 20 == 0:
            own = (matrix.astype(float) * v.astype(float)).sum(axis=1)
            other = [(-s, j) for s, j in zip(own, ids) if j != i]
            out[int(i)] = [(int(j), -s) for s, j in sorted(other)[:k]]
    return out


def _found(df, k=20) -> dict:
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        assert r["rank"] == len(own) + 1 <= k
        own.append((r.vec_id, r.score))
    return out


def test_recall_in_one_block_and_in_many(frame):
    rng = np.random.default_rng(4)
    matrix = (rng.standard_normal((600, 48)) + rng.standard_normal((6, 48))[rng.integers(0, 6, 600)]).astype(np.float32)
    ids = rng.permutation(5000)[:600]
    coded = ann.index(frame(_rows(ids, matrix), SCHEMA))
    want = _brute(ids, matrix, 20)
    for blocks in ((32_768, 16_384), (100, 7)):
        got = _found(ann.search(coded, F.col("vec_id") % 20 == 0, 20, vector_block=blocks[0], query_block=blocks[1]))
        assert set(got) == set(want)
        hits = sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want)
        assert hits >= 0.99 * 20 * len(want)
        exact = {(int(i), int(j)): float((u.astype(float) * v.astype(float)).sum()) for i, u in zip(ids, matrix) if i % 20 == 0 for j, v in zip(ids, matrix)}
        assert all(s == exact[q, j] for q in got for j, s in got[q])
        assert all([(-s, j) for j, s in got[q]] == sorted((-s, j) for j, s in got[q]) for q in got)


def test_estimates_are_within_their_bounds():
    rng = np.random.default_rng(0)
    vectors, query = rng.standard_normal((2000, 64)), rng.standard_normal(64)
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    code, length, correction = ann.encode(vectors, turn)
    signs = np.unpackbits(code, axis=1, count=64) * 2.0 - 1
    estimate = length / correction * (signs @ (turn @ query)) / 8
    error = length * np.sqrt(1 - correction**2) / correction / np.sqrt(63) * np.linalg.norm(query)
    assert (np.abs(estimate - vectors @ query) <= ann.SIGMAS * error).mean() > 0.999
    assert abs((estimate - vectors @ query).mean()) < 0.2


def test_bit_counts_are_the_inner_products_of_codes():
    rng = np.random.default_rng(1)
    for size in (3, 64, 70, 200):
        code = np.packbits(rng.random((50, size)) > 0.5, axis=1)
        query = rng.standard_normal(size)
        signs = np.unpackbits(code, axis=1, count=size) * 2.0 - 1
        got, off = ann.estimates(ann._words(code), np.bitwise_count(code).sum(axis=1).astype(float), query, size)
        assert (np.abs(got - signs @ query / np.sqrt(size)) <= off).all() and off < 0.03 * np.sqrt(size)


@pytest.mark.parametrize("scales", [(1e-170,), (1e20,), (1e160,), (1e200,), (5e-324,), (1e307,), (1e-170, 1.0, 1e160), (1e-5, 1.0, 1e5)])
def test_components_of_any_size(scales):
    rng = np.random.default_rng(8)
    matrix = rng.standard_normal((300, 24)) * rng.choice(scales, 300)[:, None]
    if scales == (5e-324,):
        matrix = rng.integers(-3, 4, (300, 24)) * 5e-324
    ids = rng.permutation(900)[:300]
    turn = ann.rotation(24)
    code, length, correction = ann.encode(matrix, turn)
    assert (correction > 0).all() and (length > 0).all()
    queries = matrix[:20]
    got = ann.nearest_in_block(queries, ids[:20], matrix, ids, code, length, correction, turn, 10)
    hits = 0
    for q in range(20):
        with np.errstate(over="ignore", invalid="ignore"):
            score = (matrix * queries[q]).sum(axis=1)
        # sums in longer numbers say the sign of what overflows
        long = (matrix.astype(np.longdouble) * queries[q].astype(np.longdouble)).sum(axis=1)
        score = np.where(np.isfinite(score), score, long.astype(float))
        order = [k for k in np.lexsort((ids, -score)) if k != q][:10]
        mine = got[0] == ids[q]
        assert mine.sum() == 10
        hits += len(set(got[1][mine]) & set(ids[order]))
        by_id = dict(zip(ids, score))
        assert all(s == by_id[j] for j, s in zip(got[1][mine], got[2][mine]))
    assert hits >= 0.99 * 200


def test_ties_odd_vectors_and_small_tables(frame):
    rows = [(k, [1.0, 2.0], "x", 1) for k in (0, 7, 3, 9, 5)]
    odd = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (None, [1.0, 1.0]), (120, [float("inf"), 1.0])]
    rows += [(k, v, "x", 1) for k, v in odd] + [(140, [5.0], "x", 1), (141, [2.0], "x", 1), (142, [-1.0], "x", 1)]
    got = _found(ann.nearest(frame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 3), 3)
    assert got == {0: [(3, 5.0), (5, 5.0), (7, 5.0)], 140: [(141, 10.0), (142, -5.0)]}
    assert ann.nearest(frame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
