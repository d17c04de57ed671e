"""Review prompts for a language model, and its answers as findings.

The call itself is not made here: prompts are rows to hand to a batch service,
answers are rows it returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchwell.functions import fixed_values as fv
from patchwell.functions.rules import ASSISTANT_ORDER
from patchwell.functions.text import record, tail
from patchwell.operators.diff import (
    diff_hunks,
    file_sections,
    hunk_blocks,
    number_before,
    snapshot_hunks,
    source_class,
)

HUNK = ("review_id", "path", "src_rank", "src_ord", "hunk_idx")


def _covered(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose source the merge kept for their file."""
    kept = files.select("review_id", "path", "src_class")
    return (
        rows.withColumn("own_class", source_class(F.col("src_rank")))
        .join(kept, ["review_id", "path"])
        .filter(F.col("own_class") == F.col("src_class"))
        .drop("own_class", "src_class")
    )


def review_hunks(raw_diffs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Hunks of diffs and of snapshots with their change text and added numbers.

    Built inside the hunk's row: the lines themselves are never shuffled.
    """
    blocks = hunk_blocks(diff_hunks(file_sections(raw_diffs)))

    def changed(block: Column) -> Column:
        def line(x: Column, i: Column) -> Column:
            number = number_before(block["number"], block["marks"], i)
            added = F.concat(F.lit("+ L"), number.cast("string"), F.lit(": "), tail(x))
            removed = F.concat(F.lit("- (removed): "), tail(x))
            return F.when(x.startswith("+"), added).when(x.startswith("-"), removed)

        return F.array_compact(F.transform(block["lines"], line))

    def numbers(block: Column) -> Column:
        def line(x: Column, i: Column) -> Column:
            number = number_before(block["number"], block["marks"], i)
            return F.when(x.startswith("+"), number.cast("bigint"))

        return F.array_compact(F.transform(block["lines"], line))

    columns = [*HUNK, "new_start", "new_count"]
    none = F.array().cast("array<string>")
    of_diffs = blocks.select(
        *columns,
        F.coalesce(F.flatten(F.transform("blocks", changed)), none).alias("changes"),
        F.coalesce(F.flatten(F.transform("blocks", numbers)), none.cast("array<bigint>")).alias(
            "added_numbers"
        ),
    )
    whole = snapshot_hunks(snapshots).withColumn("lines", F.split("hunk", "\n", -1))
    of_snapshots = whole.select(
        *columns,
        F.transform(
            "lines",
            lambda x, i: F.concat(F.lit("+ L"), (i + 1).cast("string"), F.lit(": "), x),
        ).alias("changes"),
        F.sequence(F.lit(1).cast("bigint"), F.col("new_count")).alias("added_numbers"),
    )
    return of_diffs.unionByName(of_snapshots)


def change_details(hunks: DataFrame, files: DataFrame) -> DataFrame:
    """Added and removed lines of each file as one text."""
    texts = hunks.filter(F.size("changes") > 0).select(
        *HUNK, F.array_join("changes", "\n").alias("text")
    )
    in_order = F.array_sort(F.collect_list(F.struct("src_ord", "hunk_idx", "text")))
    return (
        _covered(texts, files)
        .groupBy("review_id", "path")
        .agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("changes"))
    )


def context_lines(hunks: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """Lines of the reviewed file around each hunk; overlaps stay separate.

    A file's hunks meet its content once, as an array, and each hunk slices the
    lines it needs. Which lines changed is an equi-join on (file, line number).
    """
    covered = _covered(hunks, files)
    wanted = covered.groupBy("review_id", "path").agg(
        F.collect_list(F.struct("src_ord", "hunk_idx", "new_start", "new_count")).alias("hunks")
    )
    filled = contents.filter(F.length("content") > 0).select(
        "review_id", "path", F.split("content", "\n", -1).alias("lines")
    )
    together = wanted.join(filled, ["review_id", "path"])

    def around(h: Column) -> Column:
        start = F.greatest(F.lit(0).cast("bigint"), h["new_start"] - (fv.CONTEXT_LINES + 1))
        stop = F.least(
            F.size("lines").cast("bigint"), h["new_start"] + h["new_count"] + fv.CONTEXT_LINES
        )
        length = F.greatest(F.lit(0).cast("bigint"), stop - start)
        return record(
            src_ord=h["src_ord"],
            hunk_idx=h["hunk_idx"],
            start=start,
            lines=F.slice("lines", (start + 1).cast("int"), length.cast("int")),
        )

    ranges = together.select(
        "review_id", "path", F.explode(F.transform("hunks", around)).alias("r")
    )
    spread = ranges.select(
        "review_id",
        "path",
        F.col("r.src_ord").alias("src_ord"),
        F.col("r.hunk_idx").alias("hunk_idx"),
        F.col("r.start").alias("start"),
        F.posexplode("r.lines").alias("i", "content"),
    ).withColumn("line_number", F.col("start") + F.col("i") + 1)
    added = (
        covered.select("review_id", "path", F.explode("added_numbers").alias("line_number"))
        .distinct()
        .withColumn("is_changed", F.lit(True))
    )
    marked = spread.join(added, ["review_id", "path", "line_number"], "left")
    return marked.select(
        "review_id",
        "path",
        "src_ord",
        "hunk_idx",
        "line_number",
        F.coalesce("is_changed", F.lit(False)).alias("is_changed"),
        "content",
    )


def context_texts(lines: DataFrame, hunks: DataFrame, files: DataFrame) -> DataFrame:
    """Context of each file as one text, one range per hunk."""
    mark = F.when(F.col("is_changed"), fv.CONTEXT_MARK).otherwise(fv.CONTEXT_BLANK)
    shown = F.concat(mark, F.lit(" "), F.col("line_number").cast("string"), F.lit(": "), "content")
    in_order = F.array_sort(F.collect_list(F.struct("line_number", shown.alias("text"))))
    per_hunk = lines.groupBy("review_id", "path", "src_ord", "hunk_idx").agg(
        F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("text")
    )
    # a hunk beyond the end of the file has an empty range but still counts
    empty = _covered(hunks, files).select(
        "review_id", "path", "src_ord", "hunk_idx", F.lit("").alias("text")
    )
    ranges = (
        per_hunk.unionByName(empty)
        .groupBy("review_id", "path", "src_ord", "hunk_idx")
        .agg(F.max("text").alias("text"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("src_ord", "hunk_idx", "text")))
    return ranges.groupBy("review_id", "path").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), fv.CONTEXT_BREAK).alias("context")
    )


def _filled(template: str, values: dict[str, Column]) -> Column:
    """A format string with Columns in its places."""
    pieces: list[Column] = []
    rest = template
    while True:
        start = rest.find("{")
        if start < 0:
            pieces.append(F.lit(rest))
            return F.concat(*pieces)
        stop = rest.index("}", start)
        pieces += [F.lit(rest[:start]), values[rest[start + 1 : stop]]]
        rest = rest[stop + 1 :]


def review_prompts(
    files: DataFrame, hunks: DataFrame, contents: DataFrame
) -> DataFrame:
    """One prompt per changed file that has content."""
    filled = contents.filter(F.length("content") > 0).select("review_id", "path")
    details = change_details(hunks, files)
    context = context_texts(context_lines(hunks, files, contents), hunks, files)
    rows = (
        files.join(filled, ["review_id", "path"], "left_semi")
        .join(details, ["review_id", "path"], "left")
        .join(context, ["review_id", "path"], "left")
    )
    empty = F.lit("")
    values = {
        "path": F.col("path"),
        "status": F.col("status"),
        "additions": F.col("additions").cast("string"),
        "deletions": F.col("deletions").cast("string"),
        "changes": F.coalesce("changes", empty),
        "context": F.coalesce("context", empty),
    }
    return rows.select("review_id", "path", _filled(fv.PROMPT_FORMAT, values).alias("prompt"))


# --- answers ------------------------------------------------------------------

def parsed_answers(responses: DataFrame) -> DataFrame:
    """Items of each answer's array; an answer that is not valid JSON gives none.

    Items other than objects have no fields; a JSON null voids the whole answer. Of a
    field that an object names twice the last counts.
    """
    widest = F.regexp_extract("response", r"(?s)\[.*\]", 0)
    # Parsers stop at the end of the first value. What follows the array would have
    # to close or continue an object and also an array, which no text does.
    answer = F.col("answer")
    responses.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    as_field = F.try_parse_json(F.concat(F.lit('{"items":'), answer, F.lit("}")))
    as_element = F.try_parse_json(F.concat(F.lit("["), answer, F.lit("]")))
    valid = as_field.isNotNull() & as_element.isNotNull()
    items = F.try_parse_json(answer).cast("array<variant>")
    usable = F.when(~F.exists("items", lambda x: F.is_variant_null(x)), F.col("items"))
    fields = [
        F.try_variant_get(F.col("item"), f"$.{name}", "variant").alias(name)
        for name in ("line", "severity", "message", "suggestion")
    ]
    return (
        responses.withColumn("answer", widest)
        .filter((F.col("answer") != "") & valid)
        .withColumn("items", items)
        .select("review_id", "path", F.posexplode(usable).alias("item_no", "item"))
        .select("review_id", "path", "item_no", *fields)
    )


def _text(value: Column) -> Column:
    """A JSON value as text: strings as they are, others as written."""
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    return F.when(kind == "STRING", plain).otherwise(F.coalesce(plain, F.to_json(value)))


def _is_given(value: Column) -> Column:
    """Whether a JSON value counts as given: not missing, null, false, zero or empty."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    empty = (
        (kind == "VOID")
        | ((kind == "STRING") & (F.try_variant_get(value, "$", "string") == ""))
        | ((kind == "BOOLEAN") & ~F.coalesce(F.try_variant_get(value, "$", "boolean"), F.lit(True)))
        | (
            (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"))
            & (F.coalesce(number, F.lit(1.0)) == 0)
        )
    )
    return value.isNotNull() & ~F.coalesce(empty, F.lit(False))


def _whole(value: Column) -> Column:
    """The value as a whole number, if it is a number and whole; texts are read alike."""
    number = F.coalesce(
        F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string").try_cast("double")
    )
    return F.when((number == F.floor(number)) & (F.abs(number) < 2.0**53), number.cast("bigint"))


def assistant_findings(responses: DataFrame) -> DataFrame:
    """Usable answer items in the shape of findings.

    ``line``, ``severity`` and ``message`` must be given and not empty, false or zero.
    A line that is no whole number, such as a range, is kept as ``line_given`` and its
    number is null; the finding counts like any other. Severities are kept as answered.
    """
    items = parsed_answers(responses)
    given = _is_given(F.col("line")) & _is_given(F.col("severity")) & _is_given(F.col("message"))
    none = F.lit(None).cast("string")
    last = F.lit(ASSISTANT_ORDER).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return items.filter(given).select(
        none.alias("repo"),
        "review_id",
        "path",
        F.lit(None).cast("bigint").alias("src_rank"),
        zero.alias("src_ord"),
        zero.alias("hunk_idx"),
        F.col("item_no").cast("bigint").alias("pos"),
        _whole(F.col("line")).alias("line"),
        _text(F.col("line")).alias("line_given"),
        F.lit(None).cast("bigint").alias("end_line"),
        _text(F.col("severity")).alias("severity"),
        F.lit("ai").alias("source"),
        F.lit(fv.AI_ANALYZER).alias("analyzer"),
        last.alias("analyzer_ord"),
        F.lit(fv.AI_ANALYZER).alias("rule"),
        _text(F.col("message")).alias("message"),
        _text(F.col("suggestion")).alias("suggestion"),
        *[
            none.alias(c)
            for c in (
                "fix_kind",
                "fix_label",
                "fix_text",
                "fix_env_key",
                "redacted_text",
                "secret_sha256",
            )
        ],
    )


def answered_files(responses: DataFrame, contents: DataFrame) -> DataFrame:
    """Answers for files that had content to review."""
    filled = contents.filter(F.length("content") > 0).select("review_id", "path")
    return responses.join(filled, ["review_id", "path"], "left_semi")
