"""Trends over the review history of each repository.

A repository's history has no size limit, so nothing here windows over one: the
cap on recent reviews is a limit that Spark applies before the shuffle, counts
are partial aggregates, and streaks and score changes are running totals in time
buckets (see ``ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchwell.operators.findings import FINDING_ORDER
from patchwell.operators.ordered import TIME_SHIFTS, Running, running, since_last
from patchwell.operators.scoring import score_band
from patchwell.settings import DEFAULTS, ReviewSettings

#: orders reviews that share a time
TIE = "review_id"


def _micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def snapshots_of(reviews: DataFrame) -> DataFrame:
    """The columns of a review that its history keeps."""
    return reviews.select(
        "repo",
        "review_id",
        "ts",
        "score",
        "total_issues",
        "errors",
        "warnings",
        "infos",
        "file_count",
    )


def last_reviews(history: DataFrame, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """The most recent reviews of each repository, newest first."""
    newest = Window.partitionBy("repo").orderBy(F.desc("ts"), F.desc(TIE))
    ranked = history.withColumn("recency", F.row_number().over(newest).cast("bigint"))
    return ranked.filter(F.col("recency") <= settings.keep_reviews)


def clean_streaks(history: DataFrame, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """Consecutive clean reviews up to and including each review.

    The number of reviews since the latest one that broke it.
    """
    broken = F.coalesce(F.col("score") < settings.good_score, F.lit(False))
    return since_last(history, ["repo"], _micros(), [F.col(TIE)], broken, "streak")


def current_streaks(history: DataFrame, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """The streak of each repository now: the one at its latest review."""
    latest = F.max_by("streak", F.struct("ts", TIE))
    return clean_streaks(history, settings).groupBy("repo").agg(latest.alias("streak"))


def score_changes(history: DataFrame) -> DataFrame:
    """Score minus the previous score of the repository, null at the first.

    The previous review is the running maximum of (time, id, score) before a row.
    """
    latest = F.struct(F.col("ts"), F.col(TIE), F.col("score"))
    previous = Running("previous", latest, "max", inclusive=False)
    traced = running(history, ["repo"], _micros(), [F.col(TIE)], [previous], TIME_SHIFTS)
    return traced.withColumn("previous_score", F.col("previous.score")).withColumn(
        "score_change", F.col("score") - F.col("previous_score")
    ).drop("previous")


def banded(reviews: DataFrame, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    return reviews.withColumn("band", score_band(F.col("score"), settings))


def rule_hits_of(found: DataFrame, positions: DataFrame, reviews: DataFrame) -> DataFrame:
    """One hit for each finding, at the time of its review.

    ``seq`` and ``within`` order a review's hits as the review lists them: by the
    place of the file in risk order, then within the file.
    """
    placed = positions.select("review_id", "path", F.col("position").alias("seq"))
    dated = reviews.select("review_id", "ts")
    within = F.struct(*[F.col(c) for c in FINDING_ORDER])
    return (
        found.join(placed, ["review_id", "path"])
        .join(dated, "review_id", "left")
        .select("repo", "review_id", "ts", "analyzer", "seq", within.alias("within"))
    )


def rule_hit_counts(hits: DataFrame) -> DataFrame:
    """Hits per repository and analyzer, with the place of the first."""
    place = ["ts", "seq"] if "within" not in hits.columns else ["ts", "review_id", "seq", "within"]
    return hits.groupBy("repo", "analyzer").agg(
        F.count(F.lit(1)).alias("hits"), F.min(F.struct(*place)).alias("first_seen")
    )


def rule_hit_map(hits: DataFrame) -> DataFrame:
    """The counts as one map per repository (one entry per analyzer)."""
    counts = rule_hit_counts(hits)
    entries = F.array_sort(F.collect_list(F.struct("analyzer", "hits")))
    return counts.groupBy("repo").agg(F.map_from_entries(entries).alias("hit_counts"))


def top_rule(hits: DataFrame) -> DataFrame:
    """Analyzer with most hits; among equals the one seen first."""
    rank = F.struct((-F.col("hits")).alias("fewer"), F.col("first_seen"))
    return (
        rule_hit_counts(hits)
        .groupBy("repo")
        .agg(F.min_by("analyzer", rank).alias("analyzer"), F.max("hits").alias("hits"))
    )


def history_summary(
    history: DataFrame, hits: DataFrame, repos: DataFrame, settings: ReviewSettings = DEFAULTS
) -> DataFrame:
    """State of every repository, with defaults for those without history."""
    latest = history.groupBy("repo").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.max_by("score", F.struct("ts", TIE)).alias("last_score"),
    )
    summary = (
        repos.select("repo")
        .distinct()
        .join(latest, "repo", "left")
        .join(current_streaks(history, settings), "repo", "left")
        .join(top_rule(hits).withColumnRenamed("hits", "top_hits"), "repo", "left")
    )
    return summary.select(
        "repo",
        F.coalesce("reviews", F.lit(0).cast("bigint")).alias("reviews"),
        "last_score",
        F.coalesce("streak", F.lit(0).cast("bigint")).alias("streak"),
        F.coalesce("analyzer", F.lit("")).alias("most_common_analyzer"),
        F.coalesce("top_hits", F.lit(0).cast("bigint")).alias("top_hits"),
    )
