"""Where findings are shown, and the edits proposed for them.

Proximity groups are joined in spans of lines, so no task holds a file; the one window
here is over the findings of one line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchwell.functions import fixed_values as fv
from patchwell.operators.findings import FINDING_ORDER
from patchwell.settings import DEFAULTS, ReviewSettings

FILE = ("review_id", "path")
#: logarithms of the lines whose proximity groups are joined together, from step to step
SPAN_BITS = (10, 20, 30)


def _zero_based(line: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), line - 1)


def diagnostics(found: DataFrame) -> DataFrame:
    """Zero-based ranges with code and text as an editor shows them."""
    has_end = F.coalesce(F.col("end_line"), F.lit(0)) != 0
    start = _zero_based(F.col("line"))
    mark = F.when(F.col("source") == "ai", " (AI)").otherwise("")
    has_hint = F.coalesce(F.col("suggestion"), F.lit("")) != ""
    hint = F.when(has_hint, F.concat(F.lit("\n💡 "), F.col("suggestion"))).otherwise("")
    return found.select(
        *FILE,
        start.alias("start_line"),
        F.when(has_end, _zero_based(F.col("end_line"))).otherwise(start).alias("end_line"),
        "severity",
        F.concat("analyzer", mark).alias("code"),
        F.concat("message", hint).alias("message"),
    )


def proximity_groups(found: DataFrame, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """Findings of a file whose lines are close together, with severity split.

    ``line_count`` counts distinct lines, ``errors`` counts findings; their
    difference is what is shown as warnings and may be negative. A finding without a
    line is a group by itself.

    Groups are built inside spans of 1,024 lines first. One that no line of a neighbouring
    span can reach is complete; the others are joined in spans of 1,024 spans, and so on.
    What is left after the largest span is joined by file: at most two groups for each 2^30
    lines, whatever the file holds.
    """
    is_error = F.count_if(F.col("severity") == "error")
    lines = found.groupBy(*FILE, "line").agg(F.count(F.lit(1)).alias("n"), is_error.alias("errors"))
    rest = lines.select(
        *FILE,
        F.struct(
            F.col("line").alias("start_line"),
            F.col("line").alias("end_line"),
            # findings without a line are taken apart at the end
            F.when(F.col("line").isNull(), F.col("n")).otherwise(1).alias("line_count"),
            "errors",
        ).alias("g"),
    )
    done = []
    for bits in SPAN_BITS:
        joined = _joined_groups(rest, settings.group_gap, bits)
        at_edge = _reaches_out(settings.group_gap, bits)
        done.append(joined.filter(~at_edge).select(*FILE, "g"))
        rest = joined.filter(at_edge).select(*FILE, "g")
    done.append(_joined_groups(rest, settings.group_gap, None).select(*FILE, "g"))
    groups = reduce(DataFrame.union, done).select(*FILE, "g.*")
    unplaced, one = F.col("start_line").isNull(), F.lit(1).cast("bigint")
    parts = F.when(unplaced, F.sequence(one, F.col("line_count"))).otherwise(F.array(one))
    own_error = (F.col("part") <= F.col("errors")).cast("bigint")
    each = groups.withColumn("part", F.explode(parts)).withColumns(
        {
            "line_count": F.when(unplaced, one).otherwise(F.col("line_count")),
            "errors": F.when(unplaced, own_error).otherwise(F.col("errors")),
        }
    )
    return each.drop("part").withColumn("warnings", F.col("line_count") - F.col("errors"))


def _joined_groups(groups: DataFrame, gap: int, bits: int | None) -> DataFrame:
    """Groups of a file joined with those that start within ``gap`` lines of their end, among the
    groups of one span of lines (of the whole file if None). A group lies within one span."""
    keys = [*FILE] if bits is None else [*FILE, F.shiftright("g.start_line", bits).alias("span")]
    ordered = groups.groupBy(*keys).agg(F.array_sort(F.collect_list("g")).alias("gs"))

    def join(done: Column, g: Column) -> Column:
        last = F.element_at(done, -1)
        both = F.struct(
            last["start_line"].alias("start_line"),
            g["end_line"].alias("end_line"),
            (last["line_count"] + g["line_count"]).alias("line_count"),
            (last["errors"] + g["errors"]).alias("errors"),
        )
        near = g["start_line"] - last["end_line"] <= gap
        return F.when(near, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(
            F.concat(done, F.array(g))
        )

    rest = F.slice("gs", F.lit(2), F.size("gs"))
    joined = F.aggregate(rest, F.slice("gs", 1, 1), join)
    return ordered.select(*FILE, F.explode(joined).alias("g"))


def _reaches_out(gap: int, bits: int) -> Column:
    """Whether a line outside the group's span could be near it; false without a line."""
    last = F.lit((1 << bits) - 1).cast("bigint")
    below = F.col("g.start_line").bitwiseAND(last)  # lines of the span before it
    above = last - F.col("g.end_line").bitwiseAND(last)
    return F.coalesce((below < gap) | (above < gap), F.lit(False))


def fix_candidates(found: DataFrame) -> DataFrame:
    """The fix offered at each finding: that of the first finding on its line.

    A finding offers nothing if the first one on the line has no fix, even if it
    has one itself. Lines below 1 are shown on the first line.
    """
    shown = F.greatest(F.lit(1).cast("bigint"), F.col("line"))
    on_line = (
        Window.partitionBy(*FILE, "shown_line")
        .orderBy(*FINDING_ORDER)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    names = ("fix_kind", "fix_label", "fix_text", "fix_env_key", "redacted_text", "secret_sha256")
    own = F.when(F.col("line") == F.col("shown_line"), F.struct(*names))
    first = F.first(own, ignorenulls=True).over(on_line)
    offered = found.withColumn("shown_line", shown).withColumn("offered", first)
    return offered.filter(F.col("offered.fix_kind").isNotNull()).select(
        *FILE,
        F.col("shown_line").alias("line"),
        "analyzer",
        "rule",
        *[F.col(f"offered.{n}").alias(n) for n in names],
    )


def fix_edits(candidates: DataFrame) -> DataFrame:
    """Proposed edits; kinds that lack what they need propose none."""
    kind = F.col("fix_kind")
    usable = (
        (kind == "remove-line")
        | ((kind == "replace-line") & (F.coalesce("fix_text", F.lit("")) != ""))
        | ((kind == "move-to-env") & (F.coalesce("fix_env_key", F.lit("")) != ""))
    )
    return candidates.filter(usable).select(
        *FILE,
        "line",
        "analyzer",
        F.when(kind == "remove-line", "delete")
        .when(kind == "replace-line", "replace")
        .otherwise("move-to-env")
        .alias("edit"),
        F.col("fix_label").alias("label"),
        (F.col("line") - 1).alias("from_line"),
        F.when(kind == "remove-line", F.col("line")).otherwise(F.col("line") - 1).alias("to_line"),
        F.when(kind == "replace-line", F.col("fix_text")).alias("new_text"),
        F.when(kind == "move-to-env", F.col("fix_env_key")).alias("env_key"),
    )


def redacted_lines(candidates: DataFrame) -> DataFrame:
    """Lines rewritten to read a variable where a quoted value was found."""
    moved = (F.col("fix_kind") == "move-to-env") & F.col("redacted_text").isNotNull()
    return candidates.filter(moved).select(
        *FILE, "line", "analyzer", F.col("redacted_text").alias("new_text")
    )


def env_entries(candidates: DataFrame) -> DataFrame:
    """Variables to define, with a hash in place of each value."""
    moved = (F.col("fix_kind") == "move-to-env") & F.col("secret_sha256").isNotNull()
    return candidates.filter(moved).select(
        *FILE,
        "line",
        F.col("fix_env_key").alias("env_key"),
        "secret_sha256",
        F.concat("fix_env_key", F.lit("=sha256:"), "secret_sha256").alias("entry"),
    )


def ignore_updates(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Ignore files that have to learn about the variables' file.

    Reviews with entries are made distinct first, so the join never sees more
    than one row per review on either side.
    """
    concerned = entries.select("review_id").distinct()
    lacking = snapshots.filter(
        (F.col("path") == fv.IGNORE_FILE) & ~F.col("content").contains(fv.IGNORE_ENTRY)
    )
    return lacking.join(concerned, "review_id", "left_semi").select(
        "review_id", "path", F.lit(f"\n{fv.IGNORE_ENTRY}\n").alias("appended")
    )
