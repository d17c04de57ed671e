"""A job that publishes twice scans its diffs once."""

from __future__ import annotations

from patchwell.plans import publish as plan
from patchwell.plans import queries


def test_findings_are_computed_once_for_all_publications(spark, monkeypatch):
    plans = []

    def note(spark, out, run_id, reviews, hits, findings):
        plans.extend(d._jdf.queryExecution().executedPlan().toString() for d in (reviews, findings))

    monkeypatch.setattr(plan, "publish", note)
    assert queries.published_findings(spark, "/root/testdata/sf0.001").count() == 0  # nothing was published
    assert len(plans) == 4 and all("InMemoryTableScan" in p for p in plans)
