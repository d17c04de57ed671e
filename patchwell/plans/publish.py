"""Publishing the results of a review job, and reading them back."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchwell.operators import summaries
from patchwell.operators.ordered import null_safe_join
from patchwell.settings import DEFAULTS, ReviewSettings
from patchwell.sources.published import Publication, read_published
from patchwell.sources.tables import HISTORY, RULE_HITS

#: an entry's day, for tables whose rows are days
DAY = "day"


def publish(
    spark: SparkSession,
    out: str,
    run_id: str,
    reviews: DataFrame,
    hits: DataFrame,
    findings: DataFrame | None = None,
    settings: ReviewSettings = DEFAULTS,
) -> None:
    """Publish one run's review rows, rule hits and findings, with the summaries of the days they
    touch, all at once. A run that is repeated replaces what it had published.

    A day's summary is made again from that day's reviews, of all runs, when a run brings or takes
    back reviews of the day; no other day is read. Runs that touch the same days of a repository
    must be published one after the other."""
    run = Publication(spark, out, run_id)
    rows = run.write("history", reviews.select(*[c.split()[0] for c in HISTORY.split(", ")]))
    found = run.write("rule_hits", hits.select(*[c.split()[0] for c in RULE_HITS.split(", ")]))
    if findings is not None:
        run.write("findings", findings.drop("redacted_text", "secret_sha256"))
    for name, schema, own, make in (
        ("day_summaries", HISTORY, rows, lambda x: summaries.day_summaries(x, settings)),
        ("day_hits", RULE_HITS, found, summaries.day_hits),
    ):
        table = "history" if name == "day_summaries" else "rule_hits"
        before = read_published(spark, out, table, schema).drop("committed_at")
        replaced = before.where(F.col("run_id") == run_id)
        touched = own.select("repo", "review_date").union(replaced.select("repo", "review_date")).distinct()
        others = before.where(F.col("run_id") != run_id).drop("run_id")
        # the run's own rows lie on touched days by definition, only those of others are looked up
        given = own.unionByName(null_safe_join(others, touched, ["repo", "review_date"]))
        days = touched.withColumnRenamed("review_date", DAY)
        made = make(given)
        if name == "day_summaries":  # a day that has no reviews any more says so
            made = made.unionByName(_emptied(replaced, given), allowMissingColumns=True)
        else:
            run.write("day_hits_seen", days, F.col(DAY))
        run.write(name, made, F.col(DAY))
    run.commit()


def _emptied(replaced: DataFrame, given: DataFrame) -> DataFrame:
    """Days of replaced rows that have no row left."""
    gone = replaced.select(F.col("repo").alias("_repo"), F.col("review_date").alias("_day")).distinct()
    same = F.col("repo").eqNullSafe(F.col("_repo")) & F.col("review_date").eqNullSafe(F.col("_day"))
    return gone.join(given.select("repo", "review_date"), same, "left_anti").select(
        F.col("_repo").alias("repo"), F.col("_day").alias(DAY), F.lit(0).cast("bigint").alias("reviews")
    )


def read_days(spark: SparkSession, out: str, last_day: datetime.date | None = None) -> DataFrame:
    """The newest summary of every repository and day, up to ``last_day``."""
    rows = read_published(spark, out, "day_summaries", summaries.DAYS, last_day=last_day)
    values = [c.split()[0] for c in ("reviews", "clean_end", "all_clean", "last", "previous")]
    newest = F.max_by(F.struct(*values), F.struct("committed_at", "run_id")).alias("s")
    return rows.groupBy("repo", DAY).agg(newest).select("repo", DAY, "s.*")


def read_day_hits(spark: SparkSession, out: str) -> DataFrame:
    """Hits per repository, day and analyzer, of the run that counted the day last."""
    seen = read_published(spark, out, "day_hits_seen", "repo string, day date")
    order = F.struct("committed_at", "run_id")
    last = seen.groupBy("repo", DAY).agg(F.max(order).alias("_last"))
    rows = read_published(spark, out, "day_hits", summaries.DAY_HITS)
    return null_safe_join(rows.withColumn("_at", order), last, ["repo", DAY]).where("_at = _last").select(
        "repo", DAY, "analyzer", "hits", "first_seen"
    )


def read_history(
    spark: SparkSession, out: str, first_day: datetime.date | None = None, last_day: datetime.date | None = None
) -> DataFrame:
    """Published review rows of the given days."""
    return read_published(spark, out, "history", HISTORY, first_day, last_day).drop("committed_at", "run_id", "review_date")


def trends_since(spark: SparkSession, out: str, first_day: datetime.date, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """Streaks and score changes of the reviews from a day on, from these reviews and summaries."""
    before = read_days(spark, out, first_day - datetime.timedelta(days=1))
    return summaries.trends_of_days(read_history(spark, out, first_day), before, settings)


