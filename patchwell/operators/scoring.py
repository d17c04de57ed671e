"""Risk of files, scores and counts of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchwell.functions import fixed_values as fv
from patchwell.functions.text import matches
from patchwell.operators.ordered import ordinal_within
from patchwell.settings import DEFAULTS, ReviewSettings

#: bits dropped for (risk, file) ordinals
RISK_SHIFTS = (12, 24)
RISK_STEP = 1 << 44


def severity_tallies(found: DataFrame) -> DataFrame:
    """Findings per file and severity."""

    def of(severity: str) -> Column:
        return F.count_if(F.col("severity") == severity)

    return found.groupBy("review_id", "path").agg(
        of("error").alias("errors"),
        of("warning").alias("warnings"),
        of("info").alias("infos"),
        F.count(F.lit(1)).alias("findings"),
    )


def file_risk(files: DataFrame, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """Risk level of tallied files; the first condition that holds decides."""
    changed = F.col("additions") + F.col("deletions")
    risk = (
        F.when(F.col("errors") > 0, "high")
        .when(matches(F.col("path"), fv.SENSITIVE_PATH, any_case=True), "high")
        .when((F.col("warnings") > 0) | (changed > settings.large_change), "medium")
        .when(F.col("findings") > 0, "low")
        .when(matches(F.col("path"), fv.CONFIG_FILE), "info")
        .otherwise("low")
    )
    rank = None
    for i, level in enumerate(fv.RISK_ORDER):
        step = F.lit(i).cast("bigint")
        same = F.col("risk") == level
        rank = F.when(same, step) if rank is None else rank.when(same, step)
    return files.withColumn("risk", risk).withColumn("risk_rank", rank)


def files_by_risk(risky: DataFrame) -> DataFrame:
    """Position of each file in its review: by risk, then in file order."""
    order = F.col("risk_rank") * RISK_STEP + F.col("file_ord")
    return ordinal_within(risky, ["review_id"], order, [F.col("path")], "position", RISK_SHIFTS)


def review_rollup(
    files: DataFrame, reviews: DataFrame, settings: ReviewSettings = DEFAULTS
) -> DataFrame:
    """One row per review with score and counts, also for reviews without files.

    Files of a review that is not listed make a row without a time.

    The sums are pre-aggregated per task, so a review with very many files costs
    no more than its partial sums.
    """
    names = ("errors", "warnings", "infos", "findings", "additions", "deletions")
    own_repo = F.max("repo") if "repo" in files.columns else F.lit(None).cast("string")
    sums = files.groupBy("review_id").agg(
        own_repo.alias("own_repo"),
        F.count(F.lit(1)).alias("file_count"),
        *[F.sum(n).cast("bigint").alias(n) for n in names],
    )
    counted = reviews.join(sums, "review_id", "full").fillna(0, ["file_count", *names])
    return counted.select(
        F.coalesce("repo", "own_repo").alias("repo"),
        "review_id",
        "ts",
        review_score(F.col("errors"), F.col("warnings"), F.col("infos")).alias("score"),
        F.col("findings").alias("total_issues"),
        "errors",
        "warnings",
        "infos",
        "file_count",
        "additions",
        "deletions",
    )


def review_score(errors: Column, warnings: Column, infos: Column) -> Column:
    lost = (
        errors * fv.SEVERITY_WEIGHTS["error"]
        + warnings * fv.SEVERITY_WEIGHTS["warning"]
        + infos * fv.SEVERITY_WEIGHTS["info"]
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - lost)).cast("bigint")


def score_band(score: Column, settings: ReviewSettings = DEFAULTS) -> Column:
    return (
        F.when(score >= settings.good_score, "good")
        .when(score >= settings.warn_score, "warn")
        .otherwise("bad")
    )


def status_counts(files: DataFrame) -> DataFrame:
    """Number of files per status and review."""

    def of(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    return files.groupBy("review_id").agg(
        of("added"), of("modified"), of("deleted"), of("renamed")
    )


def change_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("additions").cast("bigint").alias("additions"),
        F.sum("deletions").cast("bigint").alias("deletions"),
    )


def findings_list(
    found: DataFrame, positions: DataFrame, severity: str | None = None
) -> DataFrame:
    """Findings with the place of their file in risk order; one severity or all."""
    chosen = found if severity is None else found.filter(F.col("severity") == severity)
    placed = positions.select("review_id", "path", F.col("position").alias("file_position"))
    return chosen.join(placed, ["review_id", "path"])


def file_rollup(risky: DataFrame) -> DataFrame:
    """One row per file: findings, clean flag, risk and change size."""
    return risky.select(
        "review_id",
        "path",
        "status",
        "risk",
        "findings",
        (F.col("findings") == 0).alias("is_clean"),
        "additions",
        "deletions",
    )
