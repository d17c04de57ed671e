"""Keyed state of repositories against the batch operators on the same rows."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from patchwell.operators import history
from patchwell.settings import ReviewSettings
from patchwell.sources.tables import RULE_HITS
from patchwell.streaming import running
from tests.tables import rows

REVIEWS = "repo string, review_id string, ts timestamp_ntz, score bigint, hits array<struct<analyzer:string,hits:bigint,seq:bigint>>"
SETTINGS = ReviewSettings(keep_reviews=5)


@pytest.fixture
def store(spark):
    before = spark.conf.get(running.PROVIDER)
    spark.conf.set(running.PROVIDER, running.ROCKS)
    yield
    spark.conf.set(running.PROVIDER, before)


def review(repo: str, n: int, score: int | None, *hits: tuple):
    return (repo, f"{repo}/{n:04}", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n), score, list(hits))


def arrive(spark, tmp_path, *batches, settings=SETTINGS):
    """Each batch arrives in a run of its own, so every run starts from the state on disk."""
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for batch in batches:
        spark.createDataFrame(batch, REVIEWS).coalesce(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(REVIEWS).parquet(folder)
        query = running.keep_running(stream, out, state, settings).trigger(availableNow=True).start()
        query.awaitTermination()
    return running.read_running(spark, out)


def expected(spark, given, settings=SETTINGS):
    past = spark.createDataFrame(given, REVIEWS).dropDuplicates(["review_id"]).drop("hits")
    hits = [(g[0], g[1], g[2], a, s) for g in {x[1]: x for x in given}.values() for a, n, s in g[4] for _ in range(n)]
    changes = history.score_changes(past).select("review_id", "score_change")
    newest = history.last_reviews(history.clean_streaks(past, settings), settings).join(changes, "review_id")
    summary = history.history_summary(past, spark.createDataFrame(hits, RULE_HITS), past.select("repo"), settings)
    return newest, summary


RECENT = ("repo", "review_id", "recency", "score", "streak", "score_change")
SUMMARY = ("repo", "reviews", "last_score", "streak", "most_common_analyzer", "top_hits")


def check(spark, got, given, settings=SETTINGS):
    newest, summary = expected(spark, given, settings)
    assert rows(running.current_reviews(got), *RECENT) == rows(newest, *RECENT)
    assert rows(running.current_summary(got, newest.select("repo")), *SUMMARY) == rows(summary, *SUMMARY)


def some(repo: str, start: int, n: int, seed: int):
    rng = random.Random(seed)
    kinds = ["todos", "secrets", "debugger"]
    return [
        review(repo, i, rng.choice((95, 90, 85, 80, 79)), (rng.choice(kinds), rng.randint(1, 3), rng.randint(0, 9)))
        for i in range(start, start + n)
    ]


def test_batches_give_what_the_table_gives_after_restarts(spark, tmp_path, store):
    one, two, three = some("a", 0, 12, 1) + some("b", 0, 3, 2), some("a", 12, 1, 3), some("a", 13, 7, 4) + some("c", 0, 2, 5)
    got = arrive(spark, tmp_path, one, two, three)
    check(spark, got, one + two + three)
    streaks = history.clean_streaks(spark.createDataFrame(one + two + three, REVIEWS).drop("hits"), SETTINGS)
    assert rows(got, "review_id", "streak") == rows(streaks, "review_id", "streak")  # at every review


def test_what_arrives_again_counts_once(spark, tmp_path, store):
    one = some("a", 0, 4, 1)
    got = arrive(spark, tmp_path, one + one[:2], one[2:] + some("a", 4, 2, 2), one[3:])
    check(spark, got, one + some("a", 4, 2, 2))
    assert got.count() == 6


def test_late_reviews_take_their_place_among_the_kept(spark, tmp_path, store):
    given = [review("a", i, 90, ("todos", 1, 0)) for i in range(10)]
    late = given.pop(7)
    got = arrive(spark, tmp_path, given, [late[:3] + (10,) + late[4:]])
    check(spark, got, given + [late[:3] + (10,) + late[4:]])


def test_reviews_older_than_all_kept_are_counted_and_told(spark, tmp_path, store):
    given = [review("a", i, 90, ("todos", 1, 0)) for i in range(10)]
    old = review("a", -1, 10, ("secrets", 12, 0))
    now = running.current_state(arrive(spark, tmp_path, given, [old])).first()
    assert (now.reviews, now.unplaced, now.analyzer, now.top_hits) == (11, 1, "secrets", 12)
    assert now.recent[0].streak == 10


def test_odd_rows(spark, tmp_path, store):
    nameless = (None, "x", datetime.datetime(2024, 1, 1), 50, None)
    undated = ("a", "y", None, 50, None)
    given = [review("a", 0, None), review("a", 1, 95), nameless]
    got = arrive(spark, tmp_path, [*given, undated], [])
    assert rows(running.current_state(got), "repo", "streak", "score_change", "reviews", "analyzer") == [
        ("a", 2, None, 2, ""),
        (None, 0, None, 1, ""),
    ]


def test_state_is_bounded(spark, tmp_path, store):
    got = arrive(spark, tmp_path, some("a", 0, 200, 1), some("a", 200, 100, 2))
    now = running.current_state(got).first()
    assert len(now.recent) == SETTINGS.keep_reviews and len(now.hit_counts) == 3 and now.reviews == 300


def test_needs_its_store(spark):
    stream = spark.readStream.schema(REVIEWS).parquet("/root/testdata/sf0.001")
    if spark.conf.get(running.PROVIDER) != running.ROCKS:
        with pytest.raises(ValueError):
            running.keep_running(stream, "out", "state")


def test_hits_come_from_findings(spark):
    ts = datetime.datetime(2024, 1, 1)
    past = spark.createDataFrame([("a", "r", ts, 5), ("a", "q", ts, 6)], "repo string, review_id string, ts timestamp_ntz, score bigint")
    hits = spark.createDataFrame([("a", "r", ts, "todos", 3), ("a", "r", ts, "todos", 1)], RULE_HITS)
    got = {r.review_id: r.hits for r in running.reviews_with_hits(past, hits).collect()}
    assert got["q"] is None and [tuple(x) for x in got["r"]] == [("todos", 2, 1)]
