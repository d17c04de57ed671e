"""What the plans may and may not contain."""

from __future__ import annotations

import re

import pytest

from patchwell.operators import diff, findings
from patchwell.operators.merge import changed_files
from patchwell.plans.queries import QUERIES
from patchwell.plans.review import ReviewInputs, review_rows
from patchwell.sources.tables import RAW_DIFFS, REVIEWS, SNAPSHOTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Inputs as stored tables, so that plans show the operators alone."""
    root = str(tmp_path_factory.mktemp("tables"))
    for name, schema in (("raw", RAW_DIFFS), ("snap", SNAPSHOTS), ("reviews", REVIEWS)):
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
    return ReviewInputs(*(spark.read.parquet(f"{root}/{n}") for n in ("raw", "snap", "reviews")))


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_and_findings_are_narrow(stored):
    lines = diff.diff_lines(diff.diff_hunks(diff.file_sections(stored.raw_diffs)))
    found = findings.static_findings(
        findings.reviewable_lines(stored.raw_diffs, stored.snapshots)
    )
    for plan in (physical(lines), physical(found)):
        for word in ("Exchange", "Window", "Sort", "EvalPython", "Join", "Cartesian"):
            assert word not in plan, word


def test_one_review_reads_the_diffs_once(stored):
    plan = physical(review_rows(stored))
    assert len(re.findall(r"FileScan parquet \[[^]]*raw_diff#", plan)) == 1
    assert "Window" not in plan and "EvalPython" not in plan


def test_merge_shuffles_once_and_not_the_text(stored):
    plan = physical(changed_files(stored.raw_diffs, stored.snapshots))
    assert plan.count("Exchange hashpartitioning") == 1
    exchanged = plan[: plan.index("Exchange")]
    assert "section#" not in exchanged and "raw_diff#" not in exchanged


def test_scan_code_stays_small_enough_to_compile(spark, stored):
    found = findings.static_findings(
        findings.reviewable_lines(stored.raw_diffs, stored.snapshots)
    )
    text = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    # HotSpot does not compile methods of more than 8000 bytes
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("name", ["context_ranges", "history_summary", "review_prompts", "fix_edits"])
def test_no_cross_joins_or_python(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert word not in plan, word


def test_recent_history_is_limited_before_the_shuffle(spark):
    plan = physical(QUERIES["history_last50"](spark, SF))
    assert plan.count("WindowGroupLimit") == 2
