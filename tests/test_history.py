"""Trends over review history."""

from __future__ import annotations

import datetime

from patchwell.operators import history
from patchwell.settings import ReviewSettings
from patchwell.sources.tables import HISTORY, RULE_HITS, read_or_empty
from tests.tables import rows

START = datetime.datetime(2024, 1, 1)


def past(spark, scores, repo="repo", step=datetime.timedelta(hours=5)):
    return spark.createDataFrame(
        [
            (repo, f"r{i:04d}", START + i * step, s, 0, 0, 0, 0, 0)
            for i, s in enumerate(scores)
        ],
        HISTORY,
    )


def test_streak_and_changes(spark):
    table = past(spark, [90, 85, 70, 80])
    assert rows(history.clean_streaks(table), "review_id", "streak") == [
        ("r0000", 1),
        ("r0001", 2),
        ("r0002", 0),
        ("r0003", 1),
    ]
    assert rows(history.score_changes(table), "review_id", "score_change") == [
        ("r0000", None),
        ("r0001", -5),
        ("r0002", -15),
        ("r0003", 10),
    ]
    assert rows(history.current_streaks(table), "repo", "streak") == [("repo", 1)]


def test_streak_counts_all_history_not_the_last_reviews(spark):
    table = past(spark, [10] + [100] * 120)
    assert rows(history.current_streaks(table), "streak") == [(120,)]
    recent = history.last_reviews(table)
    assert recent.count() == 50
    newest = rows(recent.filter("recency <= 2"), "recency", "review_id")
    assert newest == [(1, "r0120"), (2, "r0119")]
    assert history.last_reviews(table, ReviewSettings(keep_reviews=3)).count() == 3


def test_many_reviews_at_one_time(spark):
    table = past(spark, [80, 10, 90, 95] * 50, step=datetime.timedelta(0))
    streaks = {r.review_id: r.streak for r in history.clean_streaks(table).collect()}
    expected, n = {}, 0
    for i, s in enumerate([80, 10, 90, 95] * 50):
        n = n + 1 if s >= 80 else 0
        expected[f"r{i:04d}"] = n
    assert streaks == expected


def test_top_rule_and_counts(spark):
    hits = [("a", "todos", 2), ("a", "secrets", 1), ("a", "secrets", 3), ("a", "todos", 4)]
    hits += [("b", "x", 1), ("b", "y", 2), ("b", "y", 3)]
    table = spark.createDataFrame(
        [(repo, "r", START + datetime.timedelta(n), rule, n) for repo, rule, n in hits], RULE_HITS
    )
    assert rows(history.top_rule(table), "repo", "analyzer", "hits") == [
        ("a", "secrets", 2),
        ("b", "y", 2),
    ]
    maps = {r.repo: r.hit_counts for r in history.rule_hit_map(table).collect()}
    assert maps == {"a": {"secrets": 2, "todos": 2}, "b": {"x": 1, "y": 2}}


def test_defaults_without_history(spark, tmp_path):
    none = read_or_empty(spark, f"{tmp_path}/none", HISTORY)
    hits = spark.createDataFrame([], RULE_HITS)
    repos = spark.createDataFrame([("new",)], "repo string")
    assert [tuple(r) for r in history.history_summary(none, hits, repos).collect()] == [
        ("new", 0, None, 0, "", 0)
    ]
