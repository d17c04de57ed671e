"""Readers and derived inputs."""

from __future__ import annotations

import os

import pytest

from patchwell.operators import diff
from patchwell.sources import derived
from patchwell.plans.review import ReviewInputs, run_review
from patchwell.sources.tables import REVIEWS, read_diff_texts, scratch_folder
from tests.tables import added, raw_diffs, rows, snapshots

SF = "/root/testdata/sf0.001"


def test_diff_files_by_folder(spark, tmp_path):
    for repo, review, channel in (("my repo", "r1", "staged"), ("other", "r1", "unstaged")):
        folder = tmp_path / repo / review
        os.makedirs(folder)
        (folder / f"{channel}.diff").write_text(added("a.ts", "x"), encoding="utf-8")
    table = read_diff_texts(spark, f"{tmp_path}/*/*/*.diff")
    assert rows(table, "repo", "review_id", "channel", "raw_diff") == [
        ("my repo", "my repo/r1", "staged", added("a.ts", "x")),
        ("other", "other/r1", "unstaged", added("a.ts", "x")),
    ]


def test_derived_hunk_headers_state_true_counts(spark):
    hunks = diff.diff_hunks(diff.file_sections(derived.raw_diffs(spark, SF)))
    lines = diff.diff_lines(hunks)
    counted = lines.groupBy("src_ord", "review_id", "hunk_idx", "new_count", "old_count").agg(
        {"line_type": "collect_list"}
    )
    for r in counted.withColumnRenamed("collect_list(line_type)", "kinds").collect():
        assert r.new_count == sum(k != "removed" for k in r.kinds)
        assert r.old_count == sum(k != "added" for k in r.kinds)


def test_scratch_folder_is_one_that_executors_share(spark):
    shared = (spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir"))
    assert scratch_folder(spark) in (*shared, spark.sparkContext.getCheckpointDir())


def test_two_repositories_may_not_share_a_review_id(spark, tmp_path):
    reviews = spark.createDataFrame([("a", "r", None), ("b", "r", None)], REVIEWS)
    given = ReviewInputs(raw_diffs(spark), snapshots(spark), reviews)
    with pytest.raises(ValueError, match="belongs to a and to b"):
        run_review(given, str(tmp_path))
