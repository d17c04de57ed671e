"""Findings: one narrow pass of all enabled rules over reviewable lines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchwell.functions import fixed_values as fv
from patchwell.functions import rules as R
from patchwell.operators.diff import (
    SECTION,
    file_sections,
    reviewable_diff_lines,
    reviewable_snapshot_lines,
    source_class,
)
from patchwell.operators.ordered import ordinal_within
from patchwell.settings import DEFAULTS, ReviewSettings

#: columns of the findings table before file order is known
FINDING_COLUMNS = (
    "repo",
    "review_id",
    "path",
    "src_rank",
    "src_ord",
    "hunk_idx",
    "pos",
    "line",
    "end_line",
    "severity",
    "source",
    "analyzer",
    "analyzer_ord",
    "rule",
    "message",
    "suggestion",
    "fix_kind",
    "fix_label",
    "fix_text",
    "fix_env_key",
    "redacted_text",
    "secret_sha256",
)
#: order of findings within a file
FINDING_ORDER = ("analyzer_ord", "src_ord", "hunk_idx", "pos")


def reviewable_lines(
    raw_diffs: DataFrame,
    snapshots: DataFrame,
    settings: ReviewSettings = DEFAULTS,
    keep_all: bool = False,
) -> DataFrame:
    """All lines the rules look at, from diffs and from snapshots."""
    sections = file_sections(raw_diffs)
    return reviewable_diff_lines(sections, settings.large_hunk, keep_all).unionByName(
        reviewable_snapshot_lines(snapshots, settings.large_hunk, keep_all)
    )


def _is_added() -> Column:
    return F.coalesce(F.col("line_type") == "added", F.lit(False))


def _starts_large_block() -> Column:
    """True on the one row per large hunk that carries its finding."""
    return F.col("large_added").isNotNull() & (F.coalesce(F.col("pos"), F.lit(0)) == 0)


def _line_finding(rule: R.Rule, line: R.Line) -> Column:
    is_secret = rule.analyzer == "secrets"
    key = rule.fix_env_key(line)
    none = F.lit(None).cast("string")
    return F.struct(
        F.col("line_number").alias("line"),
        F.lit(None).cast("bigint").alias("end_line"),
        rule.severity(line).alias("severity"),
        F.lit(rule.analyzer).alias("analyzer"),
        F.lit(rule.order).cast("bigint").alias("analyzer_ord"),
        F.lit(rule.name).alias("rule"),
        rule.message(line).alias("message"),
        rule.suggestion(line).alias("suggestion"),
        rule.fix_kind(line).alias("fix_kind"),
        rule.fix_label(line).alias("fix_label"),
        none.alias("fix_text"),
        key.alias("fix_env_key"),
        (F.when(key.isNotNull(), R.redacted(line.content, key)) if is_secret else none).alias(
            "redacted_text"
        ),
        (F.when(key.isNotNull(), R.secret_hash(line.content)) if is_secret else none).alias(
            "secret_sha256"
        ),
    )


def _block_finding(threshold: int) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.col("new_start").alias("line"),
        (F.col("new_start") + F.col("new_count")).alias("end_line"),
        F.lit("warning").alias("severity"),
        F.lit(R.LARGE_FUNCTIONS).alias("analyzer"),
        F.lit(fv.ANALYZERS.index(R.LARGE_FUNCTIONS)).cast("bigint").alias("analyzer_ord"),
        F.lit(R.LARGE_FUNCTIONS).alias("rule"),
        R.large_block_message(F.col("large_added"), F.col("large_name")).alias("message"),
        R.large_block_suggestion(threshold).alias("suggestion"),
        none.alias("fix_kind"),
        none.alias("fix_label"),
        none.alias("fix_text"),
        none.alias("fix_env_key"),
        none.alias("redacted_text"),
        none.alias("secret_sha256"),
    )


def _candidates(lines: DataFrame, settings: ReviewSettings, keep: Column) -> DataFrame:
    """Lines on which a rule may fire, and those in ``keep``."""
    line = R.Line.of_columns()
    hints = [rule.hint(line) for rule in R.line_rules(settings)]
    hinted = _is_added() & reduce(or_, hints, F.lit(False))
    large = _starts_large_block() if settings.large_functions else F.lit(False)
    return lines.filter(hinted | large | keep)


def _found(settings: ReviewSettings) -> Column:
    """Findings of every enabled rule on a line, as an array."""
    line = R.Line.of_columns()
    added = _is_added()
    found = [
        F.when(added & rule.hint(line) & rule.hit(line), _line_finding(rule, line))
        for rule in R.line_rules(settings)
    ]
    # with every rule off the array keeps its type
    large = _starts_large_block() if settings.large_functions else F.lit(False)
    found.append(F.when(large, _block_finding(settings.large_hunk)))
    return F.array_compact(F.array(*found))


def _as_findings(rows: DataFrame) -> DataFrame:
    own = ("repo", "review_id", "path", "src_rank", "src_ord", "hunk_idx", "pos")
    return rows.select(
        *own,
        *[
            F.lit("static").alias(c) if c == "source" else F.col(f"f.{c}").alias(c)
            for c in FINDING_COLUMNS
            if c not in own
        ],
    )


def static_findings(lines: DataFrame, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """Findings of every enabled rule on ``reviewable_lines``.

    Almost all lines leave at a filter of cheap tests; exact patterns, messages
    and fixes are only evaluated on the rest. The line text itself does not leave
    this stage.
    """
    return _as_findings(
        _candidates(lines, settings, F.lit(False)).select(
            "repo",
            "review_id",
            "path",
            "src_rank",
            "src_ord",
            "hunk_idx",
            F.coalesce("pos", F.lit(0).cast("bigint")).alias("pos"),
            F.explode(_found(settings)).alias("f"),
        )
    )


def scan(
    raw_diffs: DataFrame, snapshots: DataFrame, settings: ReviewSettings = DEFAULTS
) -> DataFrame:
    """Sections and their findings from one read of the diff texts.

    A row is a section or snapshot with its line counts and one finding ``f``, or
    none; every section has at least one row. Everything a review needs derives
    from this (small) table.
    """
    lines = reviewable_lines(raw_diffs, snapshots, settings, keep_all=True)
    zero = F.lit(0).cast("bigint")
    first = (F.coalesce("hunk_idx", zero) == 0) & (F.coalesce("pos", zero) == 0)
    return _candidates(lines, settings, first).select(
        *SECTION,
        F.coalesce("hunk_idx", zero).alias("hunk_idx"),
        F.coalesce("pos", zero).alias("pos"),
        F.explode_outer(_found(settings)).alias("f"),
    )


def scanned_findings(scanned: DataFrame) -> DataFrame:
    """The findings of a scan."""
    return _as_findings(scanned.filter(F.col("f").isNotNull()))


def tallied_rows(scanned: DataFrame) -> DataFrame:
    """One row per section or snapshot of a scan, with findings by severity."""

    def of(severity: str) -> Column:
        return F.count_if(F.col("f.severity") == severity)

    return scanned.groupBy(*SECTION).agg(
        of("error").alias("errors"),
        of("warning").alias("warnings"),
        of("info").alias("infos"),
        F.count("f").alias("findings"),
    )


def reviewed_findings(found: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of the files as merged, with the file's place in the review.

    Drops findings on snapshots whose path the diffs (or an earlier origin)
    already cover. Findings, not lines, are joined, on a key that no file shares.
    """
    placed = files.select("review_id", "path", "file_ord", "src_class")
    # assistant findings have no source of their own and belong to any file
    same_source = F.col("src_rank").isNull() | (
        source_class(F.col("src_rank")) == F.col("src_class")
    )
    return found.join(placed, ["review_id", "path"]).filter(same_source).drop("src_class")


def number_findings(found: DataFrame) -> DataFrame:
    """Finding ids: analyzer and running number within the review and source.

    Static and assistant findings count separately, each in (file, analyzer,
    line) order.
    """
    numbered = ordinal_within(
        found,
        keys=["review_id", "source"],
        order=F.col("file_ord"),
        ties=[F.col(c) for c in FINDING_ORDER],
        name="n",
    )
    prefix = F.when(F.col("source") == "ai", "ai").otherwise(F.col("analyzer"))
    return numbered.withColumn(
        "finding_id", F.concat(prefix, F.lit("-"), F.col("n").cast("string"))
    )
