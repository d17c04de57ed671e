"""Diff text to sections, files, hunks and numbered lines.

Everything here is narrow: one diff text holds all of its sections, hunks and
lines, so they are split, classified and numbered inside the row they came from
and nothing is shuffled. In particular the running line numbers need no window
over the lines: a hunk's lines are cut into blocks of ``BLOCK`` lines, each of
which knows its first number and a string with one mark per line, and a line's
number is its block's first number plus the marks before it.

Ordinals replace row order: ``src_ord`` places a section or snapshot within its
review (channel, then position), ``hunk_idx`` a hunk within its section and
``pos`` a line within its hunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchwell.functions import fixed_values as fv
from patchwell.functions.paths import gates, is_scanned
from patchwell.functions.rules import block_name
from patchwell.functions.text import occurrences, prefix, record, tail, trim

SECTION_BREAK = r"\n(?=diff --git )"
HUNK_BREAK = r"\n(?=@@ -\d+,?\d* \+\d+,?\d* @@)"
HUNK_HEADER = r"^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@"
STATUS_HEADER = r"(?:^|\n)(new file mode|deleted file mode|rename from)"
BLOCK = 256
#: ``src_ord`` is the channel's rank times this, plus the position
RANK_STEP = 1 << 40
#: columns of a section or snapshot as merging reads them
SECTION = (
    "repo",
    "review_id",
    "path",
    "status",
    "src_rank",
    "src_ord",
    "first_ord",
    "additions",
    "deletions",
)
#: rank from which a source is a snapshot and not a diff
FIRST_SNAPSHOT_RANK = len(fv.CHANNELS)


def source_rank(name: Column, names: tuple[str, ...], start: int = 0) -> Column:
    chain = None
    for i, n in enumerate(names):
        rank = F.lit(start + i).cast("bigint")
        chain = F.when(name == n, rank) if chain is None else chain.when(name == n, rank)
    return chain


def source_class(rank: Column) -> Column:
    """0 for diffs of either channel, else the snapshot's own rank."""
    return F.when(rank < FIRST_SNAPSHOT_RANK, F.lit(0).cast("bigint")).otherwise(rank)


# --- sections and files -------------------------------------------------------


def _line_after(section: Column, marker: str) -> Column:
    """Rest of the first line that starts with ``marker`` (a regex)."""
    return F.regexp_extract(section, rf"(?:^|\n){marker}([^\n]*)", 1)


def section_path(section: Column) -> Column:
    """Path of a section, null if it is binary or names none.

    Nearly always the lines before the first hunk decide; only where they do not
    is the (long) rest of the section looked at.
    """
    head = F.substring_index(section, "\n@@ ", 1)
    new_side, old_side = r"(?:^|\n)\+\+\+ (b/|/dev/null)", r"(?:^|\n)--- a/"
    first_of_head = F.regexp_extract(head, new_side, 1)
    first_new_side = F.regexp_extract(section, new_side, 1)
    has_old_side = section.rlike(old_side)
    has_new_side = section.rlike(r"(?:^|\n)\+\+\+ b/")
    git_line = F.regexp_extract(section, r"(?:^|\n)(diff --git [^\n]*)", 1)
    any_but_break = r"[^\n\r  ]+"
    from_git_line = F.regexp_extract(
        git_line, rf"diff --git a/{any_but_break} b/({any_but_break})", 1
    )
    path = (
        F.when(first_of_head == "b/", _line_after(head, r"\+\+\+ b/"))
        .when((first_of_head == "/dev/null") & head.rlike(old_side), _line_after(head, "--- a/"))
        .when(first_new_side == "b/", _line_after(section, r"\+\+\+ b/"))
        .when((first_new_side == "/dev/null") & has_old_side, _line_after(section, "--- a/"))
        .when((first_new_side == "/dev/null") & has_new_side, _line_after(section, r"\+\+\+ b/"))
        .otherwise(from_git_line)
    )
    is_binary = section.contains("Binary files") & section.rlike(r"(?:^|\n)Binary files")
    # as an array, so that the path is extracted once
    named = F.filter(F.array(path), lambda p: p != "")
    return F.when(~is_binary, F.try_element_at(named, F.lit(1)))


def section_status(section: Column) -> Column:
    """Status by the first header that states one."""
    stated = (
        section.contains("new file mode")
        | section.contains("deleted file mode")
        | section.contains("rename from")
    )
    header = F.regexp_extract(section, STATUS_HEADER, 1)
    return (
        F.when(~stated, "modified")
        .when(header == "new file mode", "added")
        .when(header == "deleted file mode", "deleted")
        .when(header == "rename from", "renamed")
        .otherwise("modified")
    )


def _repeated_paths(paths: Column) -> Column:
    """Paths that occur more than once in a diff, by path, with first and last position.

    Git names a path once per diff, so this is null nearly always and costs one
    hash-set pass; only a diff with repeats pays for sorting its paths.
    """

    def runs(ordered: Column) -> Column:
        """Bounds of the runs of equal paths of more than one section."""

        def starts(p: Column, i: Column) -> Column:
            return F.when((i == 0) | (F.get(ordered, i - 1)["path"] != p["path"]), i)

        def located(bounds: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(bounds, k + 1), F.size(ordered)) - 1
                return F.when(
                    stop > start,
                    record(
                        path=F.get(ordered, start)["path"],
                        first=F.get(ordered, start)["at"],
                        last=F.get(ordered, stop)["at"],
                    ),
                )

            return F.map_from_entries(
                F.transform(
                    F.array_compact(F.transform(bounds, run)),
                    lambda r: F.struct(r["path"], record(first=r["first"], last=r["last"])),
                )
            )

        bounds = F.array_compact(F.transform(ordered, starts))
        return F.transform(F.array(bounds), located)[0]

    def spans(live: Column) -> Column:
        placed = F.transform(paths, lambda p, i: record(path=p, at=i.cast("bigint")))
        ordered = F.array_sort(F.filter(placed, lambda x: x["path"].isNotNull()))
        found = F.transform(F.array(ordered), runs)[0]
        return F.when(F.size(F.array_distinct(live)) < F.size(live), found)

    # as a lambda, so that the paths are compacted once
    return F.transform(F.array(F.array_compact(paths)), spans)[0]


def _section_texts(raw_diff: Column) -> Column:
    """Sections of the trimmed text.

    The start is trimmed before the split and the end after it, on the last
    section alone: trimming the end reads all of the text it is given.
    """

    def ends_trimmed(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.transform(parts, lambda x, i: F.when(i == last, trim(x)).otherwise(x))

    # as a lambda, so that the text is split once
    parts = F.split(F.ltrim(raw_diff, F.lit(fv.WHITE_SPACE)), SECTION_BREAK, -1)
    return F.transform(F.array(parts), ends_trimmed)[0]


def diff_sections(raw_diffs: DataFrame) -> DataFrame:
    """Every section of every diff, also those that name no file."""
    return raw_diffs.select(
        "repo",
        "review_id",
        "channel",
        F.posexplode(_section_texts(F.col("raw_diff"))).alias("section_seq", "section"),
    )


def file_sections(raw_diffs: DataFrame) -> DataFrame:
    """Sections that name a file, with path, status and ordinals.

    Within the staged channel the last section of a path replaces earlier ones
    but keeps the place of the first; within the unstaged channel repeats add up.

    ``raw_diffs`` has a whole diff in a row, or is a table of sections (``SECTIONS``), in
    which a diff may be larger than any row.
    """
    if "section" in raw_diffs.columns:
        return _located_sections(raw_diffs)
    parts = raw_diffs.select(
        "repo",
        "review_id",
        source_rank(F.col("channel"), fv.CHANNELS).alias("src_rank"),
        _section_texts(F.col("raw_diff")).alias("parts"),
    )
    named = parts.withColumn("paths", F.transform("parts", section_path))
    # looked up per diff, below the explode; only the (rare) repeats go with a section
    repeated = named.withColumn("repeats", _repeated_paths(F.col("paths")))
    spread = repeated.select(
        "repo",
        "review_id",
        "src_rank",
        "repeats",
        F.posexplode(F.arrays_zip("parts", "paths")).alias("section_seq", "part"),
    ).filter(F.col("part.paths").isNotNull())
    span = F.try_element_at("repeats", F.col("part.paths"))
    located = spread.select(
        "repo",
        "review_id",
        "src_rank",
        F.col("section_seq").cast("bigint").alias("section_seq"),
        F.col("part.paths").alias("path"),
        F.col("part.parts").alias("section"),
        F.coalesce(span["first"], F.col("section_seq")).alias("first"),
        F.coalesce(span["last"], F.col("section_seq")).alias("last"),
    )
    base = F.col("src_rank") * RANK_STEP
    return located.filter((F.col("src_rank") > 0) | (F.col("last") == F.col("section_seq"))).select(
        "repo",
        "review_id",
        "path",
        section_status(F.col("section")).alias("status"),
        "src_rank",
        "section_seq",
        (base + F.col("section_seq")).alias("src_ord"),
        (base + F.col("first")).alias("first_ord"),
        "section",
    )


def name_sections(sections: DataFrame) -> DataFrame:
    """Sections with the path and status they state; those that name no file are left out."""
    named = sections.withColumn("path", section_path(F.col("section"))).where("path IS NOT NULL")
    return named.withColumn("status", section_status(F.col("section")))


def _located_sections(sections: DataFrame) -> DataFrame:
    """``file_sections`` of a table of named sections.

    Repeated paths are found from the small columns alone. They are rare, so texts meet them
    in a join whose other side Spark measures, and only where there are any."""
    ranked = sections.withColumn("src_rank", source_rank(F.col("channel"), fv.CHANNELS))
    path = ["review_id", "src_rank", "path"]
    spans = ranked.groupBy(*path).agg(
        F.min("section_seq").alias("first"), F.max("section_seq").alias("last"), F.count(F.lit(1)).alias("times")
    )
    repeats = spans.where("times > 1").drop("times")
    seq = F.col("section_seq")
    if repeats.isEmpty():
        located = ranked.withColumns({"first": seq, "last": seq})
    else:
        located = ranked.join(repeats, path, "left").withColumns(
            {"first": F.coalesce("first", seq), "last": F.coalesce("last", seq)}
        )
    base = F.col("src_rank") * RANK_STEP
    return located.filter((F.col("src_rank") > 0) | (F.col("last") == seq)).select(
        "repo",
        "review_id",
        "path",
        "status",
        "src_rank",
        "section_seq",
        (base + seq).alias("src_ord"),
        (base + F.col("first")).alias("first_ord"),
        "section",
    )


def _with_counts(sections: DataFrame) -> DataFrame:
    """Sections with their added and removed lines, without exploding lines."""
    text = F.array_join(_hunk_texts(F.col("section")), "\n")
    return sections.withColumn("hunk_text", text).select(
        *sections.columns,
        occurrences(F.col("hunk_text"), "\n+", "\n").alias("additions"),
        occurrences(F.col("hunk_text"), "\n-", "\n").alias("deletions"),
    )


def _hunk_texts(section: Column) -> Column:
    return _after_first(F.split(F.concat(F.lit("\n"), section), HUNK_BREAK, -1))


def _after_first(items: Column) -> Column:
    return F.slice(items, 2, 1 << 30)


def section_rows(sections: DataFrame) -> DataFrame:
    """One row per section with its line counts."""
    return _with_counts(sections).select(*SECTION)


# --- hunks and lines ----------------------------------------------------------


def _is_counted(line: Column) -> Column:
    """Lines that advance the new file's numbering: added and context."""
    return (line == "") | line.startswith("+") | line.startswith(" ")


def _is_parsed(line: Column) -> Column:
    return _is_counted(line) | line.startswith("-")


def _content(line: Column) -> Column:
    return F.when(line == "", line).otherwise(tail(line))


def _count(text: Column) -> Column:
    return F.when(text == "", F.lit(1).cast("bigint")).otherwise(text.try_cast("bigint"))


def diff_hunks(sections: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per hunk; ``keep_empty`` keeps sections without any."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    spread = sections.select(
        *[c for c in sections.columns if c != "section"],
        explode(_hunk_texts(F.col("section"))).alias("hunk_idx", "hunk"),
    )
    header = F.substring_index("hunk", "\n", 1)

    def group(i: int) -> Column:
        return F.regexp_extract(header, HUNK_HEADER, i)

    return spread.select(
        *[c for c in spread.columns if c not in ("hunk", "hunk_idx")],
        F.col("hunk_idx").cast("bigint").alias("hunk_idx"),
        group(1).try_cast("bigint").alias("old_start"),
        _count(group(2)).alias("old_count"),
        group(3).try_cast("bigint").alias("new_start"),
        _count(group(4)).alias("new_count"),
        "hunk",
    )


def snapshot_hunks(snapshots: DataFrame, origins: tuple[str, ...] = fv.ORIGINS) -> DataFrame:
    """A snapshot as an added file with a single hunk that adds every line.

    One without content is a file that could not be read, and is no change.
    """
    rank = source_rank(F.col("origin"), origins, FIRST_SNAPSHOT_RANK)
    zero = F.lit(0).cast("bigint")
    readable = F.col("origin").isin(*origins) & F.col("content").isNotNull()
    return snapshots.filter(readable).select(
        "repo",
        "review_id",
        "path",
        F.lit("added").alias("status"),
        rank.alias("src_rank"),
        F.col("file_seq").alias("section_seq"),
        (rank * RANK_STEP + F.col("file_seq")).alias("src_ord"),
        (rank * RANK_STEP + F.col("file_seq")).alias("first_ord"),
        zero.alias("hunk_idx"),
        zero.alias("old_start"),
        zero.alias("old_count"),
        F.lit(1).cast("bigint").alias("new_start"),
        (occurrences(F.col("content"), "\n", "") + 1).alias("new_count"),
        F.col("content").alias("hunk"),
    )


def snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """``section_rows`` of snapshots: every line of the content is an addition."""
    return _counted_snapshots(snapshots).select(*SECTION)


def _counted_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshot_hunks(snapshots).select(
        "*",
        F.col("new_count").alias("additions"),
        F.lit(0).cast("bigint").alias("deletions"),
    )


def _blocks(lines: Column, start: Column) -> Column:
    """Cut a hunk's lines into blocks that each know their first line number.

    Every line is looked at once. A block's number adds the counts of the blocks before
    it in its row of ``BLOCK`` blocks and of the rows before that.
    """
    size = F.size(lines)

    def sliced(i: Column) -> Column:
        return F.slice(lines, i * BLOCK + 1, F.lit(BLOCK))

    def marked(i: Column) -> Column:
        marks = F.transform(sliced(i), lambda x: F.when(_is_counted(x), "1").otherwise("0"))
        return F.array_join(marks, "")

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0), lambda a, x: a + x)

    def numbered(marks: Column) -> Column:
        counts = F.transform(
            marks, lambda m: F.octet_length(F.replace(m, F.lit("0"), F.lit("")))
        )
        return F.transform(F.array(counts), lambda c: with_rows(marks, c))[0]

    def with_rows(marks: Column, counts: Column) -> Column:
        last = F.floor((F.size(counts) - 1) / F.lit(BLOCK)).cast("int")
        rows = F.transform(
            F.sequence(F.lit(0), last), lambda r: total(F.slice(counts, r * BLOCK + 1, F.lit(BLOCK)))
        )
        return F.transform(F.array(rows), lambda r: with_numbers(marks, counts, r))[0]

    def with_numbers(marks: Column, counts: Column, rows: Column) -> Column:
        def block(own: Column, i: Column) -> Column:
            row = F.floor(i / F.lit(BLOCK)).cast("int")
            before = total(F.slice(rows, F.lit(1), row)) + total(
                F.slice(counts, row * BLOCK + 1, i - row * BLOCK)
            )
            return record(first_pos=i * BLOCK, number=start + before, marks=own, lines=sliced(i))

        return F.transform(marks, block)

    last = F.floor((size - 1) / F.lit(BLOCK)).cast("int")
    marks = F.transform(F.sequence(F.lit(0), last), marked)
    return F.when(size > 0, F.transform(F.array(marks), numbered)[0])


def _with_body(hunks: DataFrame) -> DataFrame:
    return hunks.withColumn("body", _after_first(F.split("hunk", "\n", -1)))


def number_before(first: Column, marks: Column, index: Column) -> Column:
    """Line number at ``index`` of a block: counted marks before it."""
    counted = F.replace(prefix(marks, index), F.lit("0"), F.lit(""))
    return first + F.octet_length(counted)


def hunk_blocks(hunks: DataFrame) -> DataFrame:
    """Hunks with their lines as an array of numbered blocks."""
    return _with_body(hunks).withColumn("blocks", _block_array())


def _block_array() -> Column:
    return _blocks(F.col("body"), F.col("new_start"))


def diff_lines(hunks: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per parsed line with its number in the new file.

    Lines that are neither added, removed nor context (such as the no-newline
    marker) are dropped, or kept with a null type if ``keep_empty`` is set, which
    also keeps hunks without lines.
    """
    explode = F.explode_outer if keep_empty else F.explode
    posexplode = F.posexplode_outer if keep_empty else F.posexplode
    carried = [c for c in hunks.columns if c != "hunk"]
    # exploding the expression, not a column of it, keeps Spark from deriving a filter
    # that would evaluate it twice more
    blocks = _with_body(hunks).select(*carried, explode(_block_array()).alias("block"))
    spread = blocks.select(
        *carried,
        F.col("block.first_pos").alias("first_pos"),
        F.col("block.number").alias("first_number"),
        F.col("block.marks").alias("block_marks"),
        posexplode("block.lines").alias("i", "line"),
    )
    line = F.col("line")
    kind = (
        F.when(line.startswith("+"), "added")
        .when(line.startswith("-"), "removed")
        .when(line.startswith(" ") | (line == ""), "context")
    )
    lines = spread.select(
        *carried,
        (F.col("first_pos") + F.col("i")).cast("bigint").alias("pos"),
        number_before(F.col("first_number"), F.col("block_marks"), F.col("i"))
        .cast("bigint")
        .alias("line_number"),
        kind.alias("line_type"),
        _content(line).alias("content"),
    )
    return lines if keep_empty else lines.filter(F.col("line_type").isNotNull())


def snapshot_lines(hunks: DataFrame) -> DataFrame:
    """One row per line of a snapshot, all added."""
    carried = [c for c in hunks.columns if c != "hunk"]
    return hunks.select(*carried, F.posexplode(F.split("hunk", "\n", -1)).alias("i", "content")).select(
        *carried,
        F.col("i").cast("bigint").alias("pos"),
        (F.col("i") + 1).cast("bigint").alias("line_number"),
        F.lit("added").alias("line_type"),
        "content",
    )


def added_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line_type") == "added")


# --- lines as the rules read them ---------------------------------------------


def _with_gates(files: DataFrame, keep_all: bool) -> DataFrame:
    gated = files.select("*", *gates(F.col("path")))
    if keep_all:
        return gated
    return gated.filter(is_scanned(F.col("is_code"), F.col("secret_class")))


def _block_columns(added: Column, first_lines: Column, threshold: int) -> list[Column]:
    """Added lines and function name of a hunk that is large, else nulls."""
    large = F.col("is_code") & (added >= threshold)
    return [
        F.when(large, added).alias("large_added"),
        F.when(large, block_name(first_lines)).alias("large_name"),
    ]


def reviewable_diff_lines(
    sections: DataFrame, threshold: int, keep_all: bool = False
) -> DataFrame:
    """Lines of diffs with file gates and the large-block columns of their hunk.

    Files no rule looks at are dropped before their lines are exploded. With
    ``keep_all`` every section stays, with its line counts, and with a row of
    nulls if it has no lines.
    """
    counted = _with_counts(sections) if keep_all else sections
    hunks = diff_hunks(_with_gates(counted, keep_all), keep_empty=keep_all)
    added = occurrences(F.col("hunk"), "\n+", "\n")
    head = F.slice(
        F.filter(_after_first(F.split("hunk", "\n", -1)), _is_parsed),
        1,
        fv.FUNCTION_NAME_LINES,
    )
    first_lines = F.array_join(F.transform(head, _content), "\n")
    sized = hunks.select("*", *_block_columns(added, first_lines, threshold))
    return diff_lines(sized, keep_empty=True)


def reviewable_snapshot_lines(
    snapshots: DataFrame, threshold: int, keep_all: bool = False
) -> DataFrame:
    """``reviewable_diff_lines`` for snapshots."""
    counted = _counted_snapshots(snapshots) if keep_all else snapshot_hunks(snapshots)
    hunks = _with_gates(counted, keep_all)
    first_lines = F.substring_index("hunk", "\n", fv.FUNCTION_NAME_LINES)
    sized = hunks.select("*", *_block_columns(F.col("new_count"), first_lines, threshold))
    return snapshot_lines(sized)
