"""Published tables and day summaries against the history as a whole."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from patchwell.operators import history, summaries
from patchwell.operators.ordered import null_safe_join
from patchwell.plans import publish as plan
from patchwell.sources.published import Publication, read_published
from patchwell.sources.tables import HISTORY, RULE_HITS
from tests.tables import rows

START = datetime.datetime(2024, 1, 1)


def some(repo: str, start: int, n: int, seed: int, per_day: int = 4):
    rng = random.Random(seed)
    out = []
    for i in range(start, start + n):
        ts = START + datetime.timedelta(hours=i * 24 / per_day)
        out.append((repo, f"{repo}/{i:04}", ts, rng.choice((95, 90, 85, 80, 40)), 1, 0, 1, 0, 2))
    return out


def table(spark, given):
    return spark.createDataFrame(given, HISTORY)


def hits_of(spark, given):
    kinds = ("todos", "secrets", "debugger")
    found = [(r[0], r[1], r[2], kinds[(len(r[1]) + r[3] + i) % 3], i) for r in given for i in range(r[3] % 4)]
    return spark.createDataFrame(found, RULE_HITS)


def put(spark, out, run, given):
    plan.publish(spark, out, run, table(spark, given), hits_of(spark, given))


SUMMARY = ("repo", "reviews", "last_score", "streak", "most_common_analyzer", "top_hits")


def check(spark, out, given):
    past = table(spark, given)
    want = history.history_summary(past, hits_of(spark, given), past.select("repo"))
    got = summaries.summary(plan.read_days(spark, out), plan.read_day_hits(spark, out), past.select("repo"))
    assert rows(got, *SUMMARY) == rows(want, *SUMMARY)
    latest = history.score_changes(past).groupBy("repo").agg(F.max_by("score_change", F.struct("ts", "review_id")).alias("score_change"))
    assert rows(got, "repo", "score_change") == rows(latest, "repo", "score_change")
    assert rows(plan.read_history(spark, out), "review_id") == rows(past, "review_id")


@pytest.mark.parametrize("seed", range(3))
def test_days_add_up(spark, seed):
    rng = random.Random(seed)
    given = [r for repo in "abc" for r in some(repo, 0, rng.randint(1, 40), seed, rng.choice((1, 3, 50)))]
    past = table(spark, given)
    got = summaries.merged_days(summaries.day_summaries(past))
    want = history.history_summary(past, hits_of(spark, given), past.select("repo"))
    assert rows(got, "repo", "reviews", "last_score", "streak") == rows(want, "repo", "reviews", "last_score", "streak")


def test_runs_add_to_days_and_replace_what_they_wrote(spark, tmp_path):
    out = str(tmp_path)
    a, b = some("a", 0, 9, 1), some("b", 0, 5, 2)
    put(spark, out, "1", a[:5] + b)
    check(spark, out, a[:5] + b)
    put(spark, out, "2", a[5:])  # goes on within a day that run 1 began
    check(spark, out, a + b)
    put(spark, out, "1", a[2:5])  # run 1 again, without two reviews and without repository b
    check(spark, out, a[2:])


def test_late_days(spark, tmp_path):
    given = some("a", 0, 12, 3)
    put(spark, str(tmp_path), "1", given[8:])
    put(spark, str(tmp_path), "2", given[:4])
    put(spark, str(tmp_path), "3", given[4:8])
    check(spark, str(tmp_path), given)


def test_trends_since_a_day_read_that_day_on(spark, tmp_path):
    given = some("a", 0, 21, 5) + some("b", 2, 9, 6) + some("c", 20, 3, 7)
    put(spark, str(tmp_path), "1", given)
    day = datetime.date(2024, 1, 4)
    got = plan.trends_since(spark, str(tmp_path), day)
    past = table(spark, given)
    streaks, changes = history.clean_streaks(past), history.score_changes(past)
    both = streaks.join(changes.select("review_id", "score_change"), "review_id").where(F.col("ts") >= F.lit(day))
    columns = ("repo", "review_id", "streak", "score_change")
    assert rows(got, *columns) == rows(both, *columns)
    plan_text = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan_text and "review_date" in plan_text


def test_nothing_shows_before_the_commit(spark, tmp_path):
    out = str(tmp_path)
    put(spark, out, "1", some("a", 0, 3, 1))
    half = Publication(spark, out, "2")
    half.write("history", table(spark, some("b", 0, 3, 1)))
    again = Publication(spark, out, "1")
    again.write("history", table(spark, some("a", 0, 9, 1)))
    assert plan.read_history(spark, out).count() == 3
    again.commit()
    assert plan.read_history(spark, out).count() == 9


def test_readers_prune_days(spark, tmp_path):
    out = str(tmp_path)
    put(spark, out, "1", some("a", 0, 12, 1))
    day = datetime.date(2024, 1, 2)
    one = plan.read_history(spark, out, day, day)
    assert {r.ts.date() for r in one.collect()} == {day}
    files = read_published(spark, out, "history", HISTORY, day, day).inputFiles()
    assert files  # listed lazily; the filter is on the partition
    assert "PartitionFilters: [isnotnull(review_date" in one._jdf.queryExecution().executedPlan().toString()


def test_odd_rows(spark, tmp_path):
    assert plan.read_history(spark, str(tmp_path)).count() == 0
    assert plan.read_days(spark, str(tmp_path)).count() == 0
    given = [(None, "x", START, 90, 0, 0, 0, 0, 0), ("a", "y", None, 85, 0, 0, 0, 0, 0), ("a", "z", START, None, 0, 0, 0, 0, 0)]
    put(spark, str(tmp_path), "1", [])
    plan.publish(spark, str(tmp_path), "2", table(spark, given), spark.createDataFrame([], RULE_HITS))
    merged = summaries.merged_days(plan.read_days(spark, str(tmp_path)))
    assert rows(merged, "repo", "reviews", "streak", "last_score") == [("a", 2, 2, None), (None, 1, 1, 90)]


def test_own_rows_are_not_looked_up(spark, tmp_path, monkeypatch):
    looked_up = []

    def join(left, right, on):
        looked_up.append(left.count())
        return null_safe_join(left, right, on)

    monkeypatch.setattr(plan, "null_safe_join", join)
    put(spark, str(tmp_path), "1", some("a", 0, 9, 1))
    assert looked_up == [0, 0]
    put(spark, str(tmp_path), "2", some("b", 0, 9, 1))
    assert looked_up[2] == 9
