from __future__ import annotations

import random

import numpy as np
import pytest

from patchwell.llm import simhash as s
from patchwell.llm.common import table
from patchwell.llm.components import components
from tests.llm import brute
from tests.llm.conftest import SF


def _clustered(n: int) -> np.ndarray:
    rng = np.random.default_rng(5)
    out = set()
    for base in rng.integers(0, 2**63, n, dtype=np.uint64).tolist():
        for _ in range(6):
            x = base
            for _ in range(int(rng.integers(0, 5))):
                x ^= 1 << int(rng.integers(0, 64))
            out.add(x)
    return np.array(sorted(out), np.uint64)


def _near(fps: np.ndarray, budget: int) -> set:
    values = fps.tolist()
    return {(b, a) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= budget}


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
@pytest.mark.parametrize("depth", [1, 2])
def test_trie_pairs_are_all_pairs_within_the_budget_once(budget, depth):
    fps = _clustered(60)
    paths = [(b,) for b in range(budget + 1)]
    if depth == 2:
        paths = [(*p, b) for p in paths for b in range(budget + 1)]
    got = []
    for path in paths:
        a, b = s._partition_pairs(path, s._key(fps, path, budget), fps, budget)
        got += [(min(x), max(x)) for x in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got))
    assert set(got) == _near(fps, budget)


def test_links_with_large_groups_dealt_again(frame):
    fps = _clustered(40)
    df = frame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for group_rows in (50_000, 2):
        rows = s.links(df, group_rows=group_rows).collect()
        got = {tuple(sorted(np.array([r.a, r.b]).view(np.uint64).tolist())) for r in rows}
        assert len(rows) == len(got)
        assert got == _near(fps, 2)


def test_components_of_chains_stars_and_loops(frame):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, x) for x in range(300, 400)]
    rows = components(frame([*chain, *star, (5, 5), (None, 1), (900, 800), (800, 900)], "a long, b long")).collect()
    want = {**{x: 100 for x in range(100, 141)}, **{x: 7 for x in [7, *range(300, 400)]}, 800: 800, 900: 800}
    assert {r.node: r.root for r in rows} == want and len(rows) == len(want)
    assert components(frame([], "a long, b long")).count() == 0


def test_fingerprints_equal_brute_force(spark, frame):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    rnd = random.Random(2)
    odd = ["A b", "one", "", "x  y\tz w \x0b q", "É é Ä", " ".join(rnd.choice("abc") for _ in range(9000))]
    for text in [r.text for r in rows[:40]] + odd:
        assert s.fingerprint(text.encode()) == brute.fingerprint(text)


def test_documents_equal_brute_force(spark, frame):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = sorted(map(tuple, s.near_duplicates(frame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(brute.near_duplicates(rows))


def test_odd_rows(docs, odd_rows):
    rows = s.near_duplicates(docs(odd_rows)).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, rows), key=key) == sorted(brute.near_duplicates(odd_rows), key=key)
    given = docs(odd_rows)
    kept = s.keep_one(given)
    assert kept.columns == given.columns
    # 1, 2, 3 have no words; 5 and 6 are copies; rows without an id stay
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 7, 8]
    assert s.near_duplicates(docs([])).count() == 0 and s.keep_one(docs([])).count() == 0
