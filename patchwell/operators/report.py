"""Markdown report of a review.

A report has no size limit, so it is a table of parts of at most ``PART_LINES``
lines, numbered with running totals rather than a window over the review. Joining
a review's parts in (section, part) order with line breaks gives its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchwell.functions import fixed_values as fv
from patchwell.operators.findings import FINDING_ORDER
from patchwell.operators.ordered import ordinal_within

PART_LINES = 4096
SUMMARY_SECTION = 50
NOTES_SECTION = 60


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _number(name: str) -> Column:
    return F.col(name).cast("string")


def _status_section(i: int) -> int:
    return 10 * (i + 1)


def report_sizes(files: DataFrame) -> DataFrame:
    """Counts a report states, and its approximate number of lines."""
    statuses = [
        F.count_if(F.col("status") == s).alias(f"n_{s}") for s, _ in fv.REPORT_STATUS_TITLES
    ]
    return files.groupBy("review_id").agg(
        *statuses,
        F.count(F.lit(1)).alias("n_files"),
        F.sum("additions").cast("bigint").alias("additions"),
        F.sum("deletions").cast("bigint").alias("deletions"),
        F.sum("findings").cast("bigint").alias("findings"),
    )


def _frame(sizes: DataFrame) -> DataFrame:
    """Titles, totals and blank lines of each report."""

    def piece(section: int, text: Column, shown: Column = F.lit(True)) -> Column:
        return F.when(shown, F.struct(F.lit(section).alias("section"), text.alias("text")))

    pieces = [piece(0, F.lit("## What Changed\n"))]
    for i, (status, title) in enumerate(fv.REPORT_STATUS_TITLES):
        shown = F.col(f"n_{status}") > 0
        start = _status_section(i)
        pieces.append(piece(start, _say(f"### {title} (", _number(f"n_{status}"), ")"), shown))
        pieces.append(piece(start + 2, F.lit(""), shown))
    pieces.append(
        piece(
            SUMMARY_SECTION,
            _say(
                "## Summary\n\n- **Files changed:** ",
                _number("n_files"),
                "\n- **Lines added:** ",
                _number("additions"),
                "\n- **Lines removed:** ",
                _number("deletions"),
                "\n",
            ),
        )
    )
    notes = "## Notes\n\nThe following items were flagged during pre-push review:\n"
    pieces.append(piece(NOTES_SECTION, F.lit(notes), F.col("findings") > 0))
    spread = sizes.select("review_id", F.explode(F.array_compact(F.array(*pieces))).alias("p"))
    return spread.select(
        "review_id",
        F.col("p.section").alias("section"),
        F.lit(1).cast("bigint").alias("position"),
        F.col("p.text").alias("text"),
    )


def _file_lines(files: DataFrame) -> DataFrame:
    quoted = _say("- `", F.col("path"), "`")
    plus = _say(" (+", _number("additions"))
    text = (
        F.when(F.col("status") == "added", _say(quoted, plus, " lines)"))
        .when(F.col("status") == "modified", _say(quoted, plus, ", -", _number("deletions"), ")"))
        .otherwise(quoted)
    )
    section = None
    for i, (status, _) in enumerate(fv.REPORT_STATUS_TITLES):
        here = F.lit(_status_section(i) + 1)
        same = F.col("status") == status
        section = F.when(same, here) if section is None else section.when(same, here)
    numbered = ordinal_within(
        files, ["review_id", "status"], F.col("file_ord"), [F.col("path")], "position"
    )
    return numbered.select(
        "review_id", section.alias("section"), "position", text.alias("text")
    )


def _note_lines(found: DataFrame) -> DataFrame:
    icon = None
    for severity, mark in fv.SEVERITY_ICONS.items():
        same = F.col("severity") == severity
        icon = F.when(same, mark) if icon is None else icon.when(same, mark)
    icon = icon.otherwise(fv.OTHER_ICON)
    ties = [F.col(c) for c in FINDING_ORDER]
    numbered = ordinal_within(found, ["review_id"], F.col("file_ord"), ties, "position")
    line = _number("line")
    if "line_given" in found.columns:  # of answers: printed as given, whole numbers as 10, not 1e1
        given = F.col("line_given")
        line = F.when(F.col("line").isNotNull() & given.rlike("[.eE]"), line).otherwise(F.coalesce(given, line))
    place = _say("`", F.col("path"), ":", line, "`")
    return numbered.select(
        "review_id",
        F.lit(NOTES_SECTION + 1).alias("section"),
        "position",
        _say("- ", icon, " ", place, " — ", F.col("message")).alias("text"),
    )


def report_parts(
    files: DataFrame, found: DataFrame, part_lines: int = PART_LINES
) -> DataFrame:
    """Parts of all reports; ``files`` are tallied, ``found`` has file order."""
    lines = (
        _frame(report_sizes(files)).unionByName(_file_lines(files)).unionByName(_note_lines(found))
    )
    part = F.floor((F.col("position") - 1) / F.lit(part_lines)).cast("bigint")
    in_order = F.array_sort(F.collect_list(F.struct("position", "text")))
    return (
        lines.withColumn("part", part)
        .groupBy("review_id", "section", "part")
        .agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("text"))
    )


def markdown_reports(
    reviews: DataFrame, files: DataFrame, found: DataFrame, part_lines: int = PART_LINES
) -> DataFrame:
    """Parts of the reports of all reviews, also of those without files."""
    parts = report_parts(files, found, part_lines)
    empty = reviews.select("review_id").join(files.select("review_id"), "review_id", "left_anti")
    return parts.unionByName(
        empty.select(
            "review_id",
            F.lit(0).alias("section"),
            F.lit(0).cast("bigint").alias("part"),
            F.lit(fv.EMPTY_REPORT).alias("text"),
        )
    )
