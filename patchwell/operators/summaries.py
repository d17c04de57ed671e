"""Trends from one small row per repository and day.

A summary says how many reviews a day had, how many clean ones ended it, whether all were clean,
and its last two scores; hits are counted per day and analyzer. Summaries of days add up in the
order of days, so streaks, counts and score changes of a whole history come from as many rows as
it has days, and those of a range of days from the range's reviews and the summaries before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchwell.operators.history import TIE, _micros
from patchwell.operators.ordered import TIME_SHIFTS, Running, null_safe_join, running, since_last
from patchwell.settings import DEFAULTS, ReviewSettings

LAST = "struct<ts:timestamp_ntz,review_id:string,score:bigint>"
DAYS = f"repo string, day date, reviews bigint, clean_end bigint, all_clean boolean, last {LAST}, previous {LAST}"
DAY_HITS = "repo string, day date, analyzer string, hits bigint, first_seen struct<ts:timestamp_ntz,seq:bigint>"


def _place() -> Column:
    return F.struct(F.col("ts"), F.col(TIE).alias("review_id"), F.col("score").cast("bigint").alias("score"))


def _is_broken(settings: ReviewSettings) -> Column:
    return F.coalesce(F.col("score") < settings.good_score, F.lit(False))


def day_summaries(history: DataFrame, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """One row per repository and day of a history. Two partial aggregates, so that a day with
    very many reviews spreads over tasks; reviews without time have a null day, the first."""
    rows = history.select("repo", F.to_date("ts").alias("day"), _place().alias("at"), _is_broken(settings).alias("broken"))
    breaks = rows.groupBy("repo", "day").agg(
        F.max("at").alias("last"), F.max(F.when(F.col("broken"), F.col("at"))).alias("break")
    )
    after = F.col("break").isNull() | (F.col("at") > F.col("break"))
    return (
        null_safe_join(rows, breaks, ["repo", "day"])
        .groupBy("repo", "day")
        .agg(
            F.count(F.lit(1)).alias("reviews"),
            F.count_if(after).alias("clean_end"),
            F.max("break").isNull().alias("all_clean"),
            F.max("last").alias("last"),
            F.max(F.when(F.col("at") < F.col("last"), F.col("at"))).alias("previous"),
        )
    )


def day_hits(hits: DataFrame) -> DataFrame:
    """Hits per repository, day and analyzer, with the place of the first."""
    return hits.groupBy("repo", F.to_date("ts").alias("day"), "analyzer").agg(
        F.count(F.lit(1)).alias("hits"), F.min(F.struct("ts", "seq")).alias("first_seen")
    )


def merged_days(days: DataFrame) -> DataFrame:
    """The state of each repository after all its days: reviews, streak, last and previous score.

    The streak is the clean end of the last day that broke one, and all reviews since."""
    order = F.coalesce("day", F.to_date(F.lit("0001-01-01")))
    placed = days.where("reviews > 0").withColumn("_order", order)
    ends = placed.groupBy("repo").agg(
        F.max(F.when(~F.col("all_clean"), F.col("_order"))).alias("_broken"), F.max("last").alias("_last")
    )
    joined = null_safe_join(placed, ends, ["repo"])
    counted = F.when(F.col("_broken").isNull() | (F.col("_order") > F.col("_broken")), F.col("reviews")).when(
        F.col("_order") == F.col("_broken"), F.col("clean_end")
    )
    earlier = F.greatest("previous", F.when(F.col("last") < F.col("_last"), F.col("last")))
    return joined.groupBy("repo").agg(
        F.sum("reviews").alias("reviews"),
        F.coalesce(F.sum(counted), F.lit(0)).alias("streak"),
        F.max("_last")["score"].alias("last_score"),
        F.max(earlier)["score"].alias("previous_score"),
    )


def merged_hits(days: DataFrame) -> DataFrame:
    """Hits per repository and analyzer over all days, with the place of the first."""
    return days.groupBy("repo", "analyzer").agg(
        F.sum("hits").alias("hits"), F.min("first_seen").alias("first_seen")
    )


def summary(days: DataFrame, hits: DataFrame, repos: DataFrame) -> DataFrame:
    """``history.history_summary`` from summaries alone, and the last score change."""
    rank = F.struct((-F.col("hits")).alias("fewer"), F.col("first_seen"))
    tops = merged_hits(hits).groupBy("repo").agg(F.min_by("analyzer", rank).alias("analyzer"), F.max("hits").alias("top_hits"))
    zero = F.lit(0).cast("bigint")
    return (
        repos.select("repo").distinct().join(merged_days(days), "repo", "left").join(tops, "repo", "left").select(
            "repo",
            F.coalesce("reviews", zero).alias("reviews"),
            "last_score",
            F.coalesce("streak", zero).alias("streak"),
            (F.col("last_score") - F.col("previous_score")).alias("score_change"),
            F.coalesce("analyzer", F.lit("")).alias("most_common_analyzer"),
            F.coalesce("top_hits", zero).alias("top_hits"),
        )
    )


def trends_of_days(reviews: DataFrame, before: DataFrame, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """Streak and score change at every review of a range of days.

    ``reviews`` are those of the range, ``before`` the summaries of all earlier days; nothing else
    of the history is read. A streak that nothing in the range has broken yet goes on from there."""
    broken = F.when(_is_broken(settings), 1).otherwise(0)
    traced = since_last(reviews, ["repo"], _micros(), [F.col(TIE)], broken == 1, "_since")
    totals = [
        Running("_broken", broken, "max"),
        Running("_previous", _place(), "max", inclusive=False),
    ]
    traced = running(traced, ["repo"], _micros(), [F.col(TIE)], totals, TIME_SHIFTS)
    carried = merged_days(before).select("repo", F.col("streak").alias("_streak"), F.col("last_score").alias("_score"))
    same = carried.withColumnRenamed("repo", "_repo")
    joined = traced.join(same, F.col("repo").eqNullSafe(F.col("_repo")), "left")
    carry = F.when(F.col("_broken") == 0, F.coalesce("_streak", F.lit(0))).otherwise(0)
    previous = F.when(F.col("_previous").isNull(), F.col("_score")).otherwise(F.col("_previous.score"))
    return joined.select(
        *reviews.columns,
        (F.col("_since") + carry).cast("bigint").alias("streak"),
        (F.col("score") - previous).cast("bigint").alias("score_change"),
    )
