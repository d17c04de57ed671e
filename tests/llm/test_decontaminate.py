from __future__ import annotations

import random

from patchwell.llm import decontaminate as d
from tests.llm import brute

ITEMS = "item_id long, text string"


def _random(seed: int) -> tuple[list, list]:
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Ab", "cd", "é", "x1", "the", "ZZ"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 12, 13, 14, 30])))) for i in range(12)]
    docs = [(i, ", ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    for i in range(20):
        docs.append((100 + i, f"{docs[i][1]} {rnd.choice(items)[1].upper()}! {docs[i + 1][1]}"))
    return docs, [*items, (98, None), (99, "--- !"), (None, "cd é x1"), (3, items[3][1])]


def _got(df) -> dict:
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_equals_brute_force_in_one_pass_and_in_slices(frame, docs):
    rows, items = _random(1)
    benchmark = frame(items, ITEMS)
    want = brute.contamination(rows, items)
    assert _got(d.report(docs(rows), benchmark)) == want
    found = d.scan(docs(rows).select("doc_id", "text"), benchmark, slice_bytes=200)
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in found.collect()}
    assert got == {k: v[:3] for k, v in want.items()}


def test_odd_rows_and_empty_tables(frame, docs, odd_rows):
    benchmark = frame([(1, "the same text twice over")], ITEMS)
    rows = d.report(docs(odd_rows), benchmark).collect()
    assert len(rows) == len(odd_rows)
    assert sum(r.contaminated for r in rows) == 3
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert d.report(docs([]), benchmark).count() == 0
    assert not any(r.n_hit for r in d.report(docs(odd_rows), frame([], ITEMS)).collect())


def test_documents_or_spans_go(frame, docs):
    benchmark = frame([(1, "secret answer here")], ITEMS)
    given = docs([(1, "before SECRET, answer; here after"), (2, "clean words only"), (3, None)])
    kept = d.decontaminate(given, benchmark)
    assert kept.columns == given.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    cut = d.decontaminate(given, benchmark, remove="spans")
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "before  after", 2: "clean words only", 3: None}
