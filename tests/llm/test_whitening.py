"""Whitening against floating-point eigenvectors and exact plain sums."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchwell.llm import whitening as w

VECTORS = "vec_id long, embedding array<float>, label int"


def rows_of(vectors) -> list[tuple]:
    return [(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in enumerate(vectors)]


def plain(vectors, components=16):
    """The fit by numpy: whole vectors, n, sums, eigenvalues and the covariance."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / len(fit)
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    return x, fit, values[order], vecs[:, order], cov


def check(df, vectors, ids=None, components=16):
    x, fit, values, vecs, cov = plain(vectors)
    found = w.whiten(df, components).collect()
    k = min(components, int((values > 1e-9 * max(values[0], 1)).sum()))
    assert len(found) == k * len(x)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    dev = {}
    table = np.zeros((len(x), k))
    position = {v: i for i, v in enumerate(ids if ids is not None else range(len(x)))}
    for r in found:
        i = position[r.vec_id]
        table[i, r.component - 1] = r.whitened
        dev[i] = r.deviation
        assert r.n == n
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-6)
        assert r.identity_error <= 1e-4
    for i, row in enumerate(x):
        assert dev[i] == sum((n * int(c) - s) ** 2 for c, s in zip(row, sums))
    for c in range(k):
        want = (x - fit.mean(axis=0)) @ vecs[:, c] / math.sqrt(values[c])
        gaps = [abs(values[c] - v) for j, v in enumerate(values) if j != c]
        if min(gaps, default=1) > 1e-3 * values[0]:  # else numpy's own vectors are any of the space
            sign = np.sign(want @ table[:, c])
            assert np.allclose(table[:, c], sign * want, atol=1e-6)
    return found


def test_random_vectors(frame):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 20)) @ np.diag(np.linspace(3, 0.3, 20))
    check(frame(rows_of(vectors), VECTORS), vectors)


def test_repeated_and_unusable_vectors(frame):
    rng = np.random.default_rng(2)
    vectors = list(rng.normal(size=(60, 5)))
    vectors += [vectors[0]] * 40
    rows = rows_of(vectors)
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [3e38] * 5]
    df = frame(rows + [(1000 + i, v, None) for i, v in enumerate(bad)], VECTORS)
    clash = {c: F.lit(1) for c in ("x", "v", "_size", "component", "n", "a-b")}
    check(df.withColumns(clash), vectors)


def test_degenerate_tables(frame):
    assert w.whiten(frame([], VECTORS)).collect() == []
    same = [(i, [1.0, 2.0], 0) for i in range(5)]
    assert w.whiten(frame(same, VECTORS)).collect() == []
    line = [[float(i), 2.0 * i, 0.0] for i in range(10)]  # one component varies
    found = check(frame(rows_of(line), VECTORS), line)
    assert {r.component for r in found} == {1}
    null_ids = [(None, [float(i), float(i * i)], 0) for i in range(4)]
    assert len(w.whiten(frame(null_ids, VECTORS)).collect()) == 8


def test_equal_eigenvalues(frame):
    vectors = np.concatenate([np.eye(6), -np.eye(6)])  # every direction varies alike
    found = w.whiten(frame(rows_of(vectors), VECTORS)).collect()
    table = np.zeros((12, 6))
    for r in found:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(1 / 6)
    assert np.allclose(table.T @ table / 12, np.eye(6), atol=1e-12)


def test_lengths_are_spaces_of_their_own(frame):
    rng = np.random.default_rng(3)
    two, three = rng.normal(size=(20, 2)), rng.normal(size=(30, 3))
    rows = rows_of(two) + [(100 + i, v, l) for i, v, l in rows_of(three)]
    found = w.whiten(frame(rows, VECTORS)).collect()
    assert sorted({r.n for r in found}) == [20, 30]
    assert len(found) == 20 * 2 + 30 * 3


def test_wide_entries_stay_exact(frame):
    vectors = [[1e12, 1.0], [-1e12, 2.0], [3e12, -5.0], [0.0, 1e9]]
    found = w.whiten(frame(rows_of(vectors), VECTORS)).collect()
    x = [[math.floor(64 * float(np.float32(c))) for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    for r in found:
        want = sum((4 * c - s) ** 2 for c, s in zip(x[r.vec_id], sums))
        assert int(r.deviation_exact) == want and r.deviation == (want if want < 2**63 else None)


def test_polynomial_and_roots():
    rng = np.random.default_rng(4)
    a = rng.integers(-9, 9, size=(7, 7))
    m = (a.T @ a).tolist()
    bits = w.coefficient_bits(sum(m[i][i] for i in range(7)), 7)
    primes = w.primes_for(bits)
    poly = [w.remaindered(primes, list(r)) for r in zip(*[w.polynomial_modulo(m, p) for p in primes])]
    assert np.allclose([float(c) for c in poly], np.poly(np.array(m, float)), rtol=1e-8)
    values = sorted(np.linalg.eigvalsh(np.array(m, float)))[::-1]
    for i, v in enumerate(values):
        low, first, count = w.root(poly, sum(m[j][j] for j in range(7)), i + 1)
        assert low / 2**w.ROOT_BITS == pytest.approx(v, rel=1e-9, abs=1e-6) and (first, count) == (i + 1, 1)
    double = [1, -5, 8, -4]  # (x - 1)(x - 2)^2
    assert [w.roots_above(double, a) for a in (-1, 0, 1, 2)] == [3, 3, 2, 0]
    assert w.root(double, 5, 1)[1:] == (1, 2) and w.root(double, 5, 2)[1:] == (1, 2) and w.root(double, 5, 3)[1:] == (3, 1)


def test_whole_table(spark, frame):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    given = df.select("vec_id", "embedding").collect()
    check(df, [r.embedding for r in given], [r.vec_id for r in given])
