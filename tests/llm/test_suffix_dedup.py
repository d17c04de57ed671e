from __future__ import annotations

import random

import numpy as np
import pytest

from patchwell.llm import suffix_dedup as s
from patchwell.llm.common import table
from tests.llm import brute
from tests.llm.conftest import SF


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array_and_common_prefixes(letters):
    rng = np.random.default_rng(letters)
    text = rng.integers(20, 20 + letters, 700).astype(np.uint8)
    text[400:600] = text[:200]
    raw = text.tobytes()
    sa = s.suffix_array(text)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lanes = np.arange(0, 700, 70)
    shared = s.common_prefixes(text, sa, lanes, np.full(10, 70), 40)
    for a, b in zip(sa, sa[1:]):
        want = next((k for k in range(700) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1]), 0)
        assert shared[b] == want or shared[b] >= 40 <= want


def _texts(length: int) -> list:
    rnd = random.Random(length)
    piece = lambda n, abc="abcdefghij é": "".join(rnd.choice(abc) for _ in range(n))
    common = [piece(rnd.randint(length // 2, 3 * length)) for _ in range(6)]
    texts = ["".join(piece(rnd.randint(0, 2 * length)) + rnd.choice(common) * rnd.randint(0, 1) for _ in range(4)) for _ in range(120)]
    return [*texts, *texts[:9], "", None, "a" * 3 * length, "ab" * length, "x"]


@pytest.mark.parametrize(("length", "array_bytes", "block_bytes"), [(20, 1 << 20, 1 << 20), (20, 400, 3000), (8, 200, 500), (200, 5000, 20_000)])
def test_equals_brute_force(frame, length, array_bytes, block_bytes):
    """Small arrays spread frequent anchors over several shards, which are merged."""
    texts = _texts(length)
    df = frame(list(enumerate(texts)), "doc_id long, text string")
    rows = s.repeats(df, length, array_bytes, block_bytes).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in rows] == brute.repeats([(t or "").encode() for t in texts], length)


def test_given_documents_equal_brute_force(spark):
    docs = table(spark, SF, "documents").orderBy("doc_id")
    rows = s.repeats(docs).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in rows] == brute.repeats([r.text.encode() for r in docs.collect()], 200)


def test_odd_rows_and_whole_characters(docs, odd_rows):
    given = docs(odd_rows)
    assert s.repeats(given).count() == len(odd_rows)
    assert s.repeats(docs([])).count() == 0 and s.without_repeats(docs([])).count() == 0
    kept = s.without_repeats(given, 20)
    assert kept.columns == given.columns
    texts = {(r.doc_id, r.text) for r in kept.collect()}
    assert {(1, None), (2, ""), (5, ""), (6, ""), (7, ""), (8, "one")} <= texts
