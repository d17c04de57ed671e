"""Changed files of a review: diffs of both channels merged, snapshots filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchwell.operators.diff import (
    SECTION,
    file_sections,
    section_rows,
    snapshot_rows,
    source_class,
)

COUNTS = ("additions", "deletions")
TALLIES = ("errors", "warnings", "infos", "findings")


def merge_files(
    rows: DataFrame, measures: tuple[str, ...] = COUNTS, extra: DataFrame | None = None
) -> DataFrame:
    """One row per changed file from one row per section or snapshot.

    The union-and-group form of: sum sections of both channels, take the status
    of the first, add untracked files the diffs lack, then listed files that both
    lack. One shuffle of small rows, with map-side partial sums.

    ``extra`` holds further findings by (review_id, path), counted on files that
    exist.
    """
    classed = rows.select(
        "repo",
        "review_id",
        "path",
        "status",
        source_class(F.col("src_rank")).alias("src_class"),
        "src_ord",
        "first_ord",
        *measures,
    )
    if extra is not None:
        classed = classed.unionByName(extra, allowMissingColumns=True)
    has_source = F.col("src_class").isNotNull()
    from_diffs = F.col("src_class") == 0
    sums = []
    for m in measures:
        sums += [
            F.sum(F.when(from_diffs, F.col(m))).alias(f"{m}_diff"),
            F.min_by(m, F.when(has_source, F.col("src_ord"))).alias(f"{m}_first"),
            F.sum(F.when(~has_source, F.col(m))).alias(f"{m}_extra"),
        ]
    merged = classed.groupBy("review_id", "path").agg(
        F.max("repo").alias("repo"),
        F.min("src_class").alias("src_class"),
        F.min("first_ord").alias("file_ord"),
        F.min_by("status", "src_ord").alias("status"),
        *sums,
    )

    def value(m: str) -> Column:
        own = F.when(F.col("src_class") == 0, F.col(f"{m}_diff")).otherwise(F.col(f"{m}_first"))
        added = F.coalesce(F.col(f"{m}_extra"), F.lit(0))
        return (own + added).cast("bigint").alias(m)

    return merged.filter(F.col("src_class").isNotNull()).select(
        "repo",
        "review_id",
        "path",
        "file_ord",
        "src_class",
        "status",
        *[value(m) for m in measures],
    )


def changed_files(raw_diffs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changed files of every review with status and line counts."""
    rows = section_rows(file_sections(raw_diffs)).unionByName(snapshot_rows(snapshots))
    return merge_files(rows)


def covering_files(raw_diffs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``changed_files`` with the counts of snapshots alone: no line of a diff is counted."""
    zero = F.lit(0).cast("bigint")
    headers = file_sections(raw_diffs).withColumns({c: zero for c in COUNTS}).select(*SECTION)
    return merge_files(headers.unionByName(snapshot_rows(snapshots)))


def added_by_snapshot(files: DataFrame, rank: int) -> DataFrame:
    """Files that came from snapshots of one origin because nothing covered them."""
    return files.filter(F.col("src_class") == rank)
