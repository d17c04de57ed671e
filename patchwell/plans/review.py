"""Whole reviews: from tables of diffs to findings, files and review rows."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchwell.operators.diff import diff_sections, name_sections
from patchwell.operators.findings import (
    number_findings,
    reviewable_lines,
    reviewed_findings,
    scan,
    scanned_findings,
    static_findings,
    tallied_rows,
)
from patchwell.operators.history import rule_hits_of
from patchwell.operators.merge import COUNTS, TALLIES, covering_files, merge_files
from patchwell.operators.prompts import answered_files, assistant_findings
from patchwell.operators.report import markdown_reports
from patchwell.operators.scoring import (
    file_risk,
    files_by_risk,
    review_rollup,
    severity_tallies,
)
from patchwell.settings import DEFAULTS, ReviewSettings
from patchwell.sources.tables import SECTIONS, read_diff_files, small_files, stored, write_findings, write_history

SECTION_COLUMNS = [c.split()[0] for c in SECTIONS.split(", ")]


@dataclass(frozen=True)
class ReviewInputs:
    """Tables one review job reads.

    ``raw_diffs`` has one row per (review_id, channel), or one per section as
    ``store_sections`` leaves them; ``snapshots`` has one per
    (review_id, path, origin), ``reviews`` one per review, also for those without
    changes. ``responses`` and ``contents`` are only needed for answers of an
    assistant.
    """

    raw_diffs: DataFrame
    snapshots: DataFrame
    reviews: DataFrame
    responses: DataFrame | None = None
    contents: DataFrame | None = None


def _answers(inputs: ReviewInputs) -> DataFrame | None:
    if inputs.responses is None or inputs.contents is None:
        return None
    return assistant_findings(answered_files(inputs.responses, inputs.contents))


def review_files(inputs: ReviewInputs, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """Changed files with counts, findings by severity and risk, in one scan."""
    return _files(scan(inputs.raw_diffs, inputs.snapshots, settings), _answers(inputs), settings)


def _files(
    scanned: DataFrame, answers: DataFrame | None, settings: ReviewSettings
) -> DataFrame:
    extra = None if answers is None else severity_tallies(answers)
    files = merge_files(tallied_rows(scanned), (*COUNTS, *TALLIES), extra)
    return file_risk(files, settings)


def review_findings(inputs: ReviewInputs, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """Findings of all rules and answers on the files as merged.

    Lines are parsed once, for the rules; the files' places come from headers alone.
    """
    found = static_findings(reviewable_lines(inputs.raw_diffs, inputs.snapshots, settings), settings)
    return _placed(found, _answers(inputs), covering_files(inputs.raw_diffs, inputs.snapshots))


def _findings(scanned: DataFrame, answers: DataFrame | None, files: DataFrame) -> DataFrame:
    return _placed(scanned_findings(scanned), answers, files)


def _placed(found: DataFrame, answers: DataFrame | None, files: DataFrame) -> DataFrame:
    if answers is not None:
        found = found.unionByName(answers, allowMissingColumns=True)
    return reviewed_findings(found, files)


def review_rows(inputs: ReviewInputs, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """One row per review with its score and counts, in one scan of the diffs."""
    return review_rollup(review_files(inputs, settings), inputs.reviews, settings)


def review_tables(
    inputs: ReviewInputs, settings: ReviewSettings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Files and findings of all reviews from one read of the diffs.

    These are plans. What several branches read is marked to be kept when it is first
    computed, and computed again where an executor is lost; ``run_review`` stores it.
    """
    scanned = scan(inputs.raw_diffs, inputs.snapshots, settings).persist()
    answers = _answers(inputs)
    files = _files(scanned, answers, settings).persist()
    return files, _findings(scanned, answers, files).persist()


def run_review(
    inputs: ReviewInputs,
    out: str,
    settings: ReviewSettings = DEFAULTS,
    run_id: str | None = None,
) -> dict[str, DataFrame]:
    """Review everything and write findings, files, reviews, reports, hits and history.

    The diffs are read once: what the rules saw is stored below ``out/scan`` and read
    back, and ids, risks, scores and reports all start from that (small) table, which
    may be deleted afterwards. A run that is repeated with its ``run_id`` replaces
    what it has written.
    """
    run_id = run_id or uuid.uuid4().hex
    _reject_shared_ids(inputs.reviews)
    scanned = stored(scan(inputs.raw_diffs, inputs.snapshots, settings), f"{out}/scan", run_id)
    answers = _answers(inputs)
    if answers is not None:
        answers = stored(answers, f"{out}/answers", run_id)
    files = stored(_files(scanned, answers, settings), f"{out}/files", run_id)
    found = stored(_findings(scanned, answers, files), f"{out}/found", run_id)
    dated = inputs.reviews.select("review_id", "ts")
    write_findings(number_findings(found).join(dated, "review_id", "left"), f"{out}/findings", run_id)
    reports = stored(markdown_reports(inputs.reviews, files, found), f"{out}/reports", run_id)
    reviews = stored(review_rollup(files, inputs.reviews, settings), f"{out}/reviews", run_id)
    hits = rule_hits_of(found, files_by_risk(files), inputs.reviews)
    hits = stored(hits, f"{out}/rule_hits", run_id)
    write_history(reviews, f"{out}/history", run_id)
    return {
        "findings": found,
        "files": files,
        "reviews": reviews,
        "reports": reports,
        "rule_hits": hits,
    }


def store_sections(spark: SparkSession, diff_files: str, out: str, run_id: str) -> DataFrame:
    """Diff files of any size as a stored table of named sections, which takes the place of
    ``raw_diffs`` everywhere: the files are split and their sections named once. Small files are
    split in their rows, larger ones by Spark."""
    with small_files(spark):
        whole, larger = read_diff_files(spark, diff_files)
        sections = diff_sections(whole).withColumn("section_seq", F.col("section_seq").cast("bigint"))
        if larger is not None:
            sections = sections.unionByName(larger)
        return stored(name_sections(sections).select(*SECTION_COLUMNS), out, run_id)


def _reject_shared_ids(reviews: DataFrame) -> None:
    """Reviews are told apart by their id alone, so no two repositories may share one."""
    shared = reviews.groupBy("review_id").agg(F.min("repo").alias("a"), F.max("repo").alias("b"))
    clash = shared.filter(F.col("a") != F.col("b")).first()
    if clash is not None:
        raise ValueError(f"review {clash.review_id} belongs to {clash.a} and to {clash.b}")
