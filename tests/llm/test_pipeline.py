from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from patchwell.llm.common import table
from tests.llm import brute
from tests.llm.conftest import SF


def test_stages_keep_columns_and_what_is_clean(spark):
    docs = table(spark, SF, "documents")
    given = {r.doc_id: r.text for r in docs.collect()}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    stages = dict(pipeline.STAGES)
    kept = docs
    for name in ("language", "near_duplicates", "repeated_passages", "benchmark"):
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stages[name](spark, kept, SF)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        after = {r.doc_id: r for r in kept.collect()}
        if name == "language":
            assert set(after) == set(given)
        elif name == "near_duplicates":
            classes = brute.near_duplicates(list(before.items()))
            assert set(after) == {c for _, _, c in classes}
        elif name == "repeated_passages":
            removed = brute.repeats([before[k].encode() for k in sorted(before)], 200)
            assert set(after) == set(before)
            for k, (size, gone, _, _) in zip(sorted(before), removed):
                assert size - gone - 6 <= len(after[k].text.encode()) <= size - gone
                assert after[k].n_chars == len(after[k].text)
        else:
            dirty = brute.contamination(list(before.items()), items)
            assert set(after) == {k for k, v in dirty.items() if not v[-1]}
    pieces = stages["packing"](spark, kept, SF).collect()
    assert {r.doc_id for r in pieces} == set(after)


def test_run_is_its_stages(spark):
    rows = pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns)
    assert rows.count() > 0


ENGLISH = "The people of the town have built a house of stone near the river and they live in it with their children."
OTHER = "When the winter comes they carry wood and water from the forest and the lake, for the nights are long and cold."


def stage(spark, docs, name):
    return dict(pipeline.STAGES)[name](spark, docs, SF)


def made(frame, rows):
    docs = frame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("crawl-date", "a b", "x.y", "_null", "_row", "c0", "row", "doc", "n_hit", "items", "quo`te")
    return docs.withColumns({c: F.lit(c) for c in names})


def test_rows_decide_about_language(spark, frame):
    docs = made(frame, [(1, ENGLISH), (1, ""), (None, OTHER), (None, None), (2, OTHER), (2, OTHER)])
    kept = stage(spark, docs, "language")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, ENGLISH), (None, OTHER), (2, OTHER), (2, OTHER)], key=repr)


def test_one_row_of_each_group_stays(spark, frame):
    rows = [(5, OTHER), (5, ENGLISH), (3, ENGLISH), (3, ENGLISH), (None, ENGLISH), (None, OTHER + " Or so."), (None, OTHER + " Or so.")]
    docs = made(frame, rows)
    kept = stage(spark, docs, "near_duplicates")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(5, OTHER), (3, ENGLISH), (None, OTHER + " Or so.")], key=repr)


def test_any_columns_and_empty_tables(spark, frame):
    rows = [(1, ENGLISH), (None, None), (2, ENGLISH + OTHER), (3, ""), (3, OTHER * 3)]
    for given in (rows, []):
        docs = made(frame, given)
        for name, _ in pipeline.STAGES[:-1]:
            kept = stage(spark, docs, name)
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
            assert kept.count() <= len(given) and (name == "near_duplicates" or not given or kept.count() > 0)
        assert stage(spark, docs, "packing").count() >= len(given)
