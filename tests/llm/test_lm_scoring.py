from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest

from patchwell.llm import lm_scoring as lm
from patchwell.llm.common import table
from tests.llm import brute
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def known():
    return lm.vocabulary(lm.vocabulary_path())


def test_marginals_equal_the_sum_over_all_segmentations(known):
    lattice, scores = lm.Lattice([p for p, _ in known]), np.array([x for _, x in known])
    words = ["the", "théa", "internationalization", "x", "ß", "thtion,", "日本語", "a" * 60, "zzzz"]
    words = [w.encode() for w in words]
    got = lattice.marginals(words, scores)
    assert np.allclose(got, [brute.marginal(w, dict(known)) for w in words], rtol=1e-9)


def test_expected_counts_spell_the_words(known):
    pieces = [p for p, _ in known]
    words, counts = [b"nation", b"thethe", "été".encode()], np.array([3, 1, 2])
    found = lm.Lattice(pieces).expected(words, counts, np.array([x for _, x in known]))
    bytes_spelt = sum(n * len(p) for n, p in zip(found, pieces))
    assert math.isclose(bytes_spelt, sum(c * (len(w) + 1) for w, c in zip(words, counts)), rel_tol=1e-9)


def test_pieces_and_end_are_one_distribution(spark):
    docs = table(spark, SF, "documents").selectExpr("encode(text, 'utf-8') as _utf8")
    model = lm.train(lm.count_words(docs, 3), docs.count(), lm.vocabulary_path(), rounds=1)
    assert math.isclose(np.exp(model.scores).sum() + math.exp(model.end_score), 1, rel_tol=1e-6)


def test_base_score_and_counts_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: lm.words_of(r.text.encode()) for r in docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in rows}
    counts = collections.Counter(w for k, words in rows.items() if not held[k] for w in [*words, None])
    n, v = sum(counts.values()), len(counts)
    got = lm.score(docs, rounds=1, block_bytes=100_000).collect()
    assert {r.doc_id for r in got} == set(rows)
    for r in got:
        tokens = [*rows[r.doc_id], None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(tokens), n)
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_training_helps_held_out_texts(spark):
    docs = table(spark, SF, "documents")
    untrained, trained = (
        {r.doc_id: r.score for r in lm.score(docs, rounds=k).where("held_out").collect()} for k in (0, 4)
    )
    assert sum(trained.values()) > 0.9 * sum(untrained.values())


def test_odd_rows(docs, odd_rows):
    rows = lm.score(docs(odd_rows), rounds=1).collect()
    assert len(rows) == len(odd_rows)
    empty = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {r.n_tokens for r in empty} == {1} and len({r.score for r in empty}) == 1
    assert lm.score(docs([]), rounds=1).count() == 0
    alone = lm.score(docs([(4, "x")]), rounds=1).collect()  # crc32("4") mod 5 is not 1
    assert all(math.isfinite(r.score) for r in [*rows, *alone])
