"""Review inputs derived from the driver tables, as pure expressions of them.

The driver tables hold no diffs. ``documents`` become the sections of diffs (and
the snapshots and assistant answers that go with them), ``events`` become a
review history. Every function works on whole tables; a document's section is
built inside its row, and one shuffle collects a review's sections (at most 400
documents by construction) into its diff texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchwell.functions.text import record

DIRECTORIES = ("src", "auth", "lib", "docs", "payment")
ENDINGS = (
    ".ts", ".tsx", ".js", ".py", ".go", ".yml", ".json", ".sql",
    ".env", "/Dockerfile", ".md", ".mts", ".toml", ".rb", ".vue", ".lock",
)
PREFIXES = ("+", "+", "+", " ", "-")
#: made-up values, put together here so that no whole token stands in the code
_VALUE = "abcd" + "efgh" + "1234"
LINES = (
    "  console.log('state', value);",
    "\tconsole.table(rows)",
    "  debugger;",
    "# print(value)",
    "print(value)",
    "import pdb; pdb.set_trace()",
    "import pdb",
    "// TODO: tidy this up  ",
    "// known bug",
    "function handler(input) {",
    "let value: any = load();",
    "// @ts-nocheck",
    "// @ts-expect-error wrong type",
    "const apiKey" + " = '" + _VALUE + "';",
    "password" + ": " + _VALUE,
    "API_TOKEN" + "=" + _VALUE,
    "ARG BUILD_TOKEN" + "=" + _VALUE,
    "ALTER USER app SET PASSWORD" + " = '" + _VALUE + "';",
    '"token"' + ': "' + _VALUE + '",',
    "AKIA" + "ABCDEFGH" + "12345678",
    "// ghp_" + _VALUE * 3,
    "-- PASSWORD" + " = '" + _VALUE + "'",
)
LINE_CYCLE = 44
HUNK_LINES = 6
REVIEW_SIZE = 400


def _pick(values: tuple[str, ...], index: Column) -> Column:
    items = F.split(F.lit("\x1f".join(values)), "\x1f")  # folded to a literal
    return F.element_at(items, (index + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the review, path and lines they stand for."""
    return as_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def arriving(spark: SparkSession, sf_dir: str, table: str, schema: str) -> DataFrame:
    """A driver table as a stream, be it one file or a folder of files.

    The name is a pattern, as Spark takes a plain one for a folder."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def as_files(docs: DataFrame) -> DataFrame:
    """A table or stream of documents as files under review."""
    i = F.col("doc_id")

    def line(x: Column, pos: Column) -> Column:
        k = (i * 7 + pos * 13) % LINE_CYCLE
        return F.when(k < len(LINES), _pick(LINES, k)).otherwise(x)

    return docs.select(
        "doc_id",
        F.col("source").alias("repo"),
        F.concat(
            "source", F.lit("-r"), F.floor(i / F.lit(REVIEW_SIZE)).cast("bigint").cast("string")
        ).alias("review_id"),
        F.concat(
            "source",
            F.lit("/"),
            _pick(DIRECTORIES, i % len(DIRECTORIES)),
            F.lit("/f"),
            i.cast("string"),
            _pick(ENDINGS, i % len(ENDINGS)),
        ).alias("path"),
        F.transform(F.split("text", "\n", -1), line).alias("lines"),
    )


def _marked(lines: Column, doc_id: Column) -> Column:
    return F.transform(
        lines,
        lambda x, pos: record(
            mark=_pick(PREFIXES, (doc_id + pos) % len(PREFIXES)), text=x
        ),
    )


def _hunk(part: Column, number: Column) -> Column:
    old = F.size(F.filter(part, lambda x: x["mark"] != "+")).cast("string")
    new = F.size(F.filter(part, lambda x: x["mark"] != "-")).cast("string")
    start = (number * 10 + 1).cast("string")
    body = F.transform(part, lambda x: F.concat(x["mark"], x["text"]))
    header = F.concat(
        F.lit("@@ -"), start, F.lit(","), old, F.lit(" +"), start, F.lit(","), new, F.lit(" @@")
    )
    return F.array_join(F.concat(F.array(header), body), "\n")


def sections(docs: DataFrame) -> DataFrame:
    """A document as one section of a diff."""
    kind = F.col("doc_id") % 10
    extra = (
        F.when(kind == 0, F.array(F.lit("new file mode 100644")))
        .when(kind == 1, F.array(F.lit("deleted file mode 100644")))
        .when(kind == 2, F.array(F.concat(F.lit("rename from old/"), "path")))
        .when(kind == 3, F.array(F.lit("Binary files differ")))
        .otherwise(F.array().cast("array<string>"))
    )
    new_side = F.when(kind == 1, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), "path"))
    marked = docs.withColumn("marked", _marked(F.col("lines"), F.col("doc_id")))
    last = F.floor((F.size("marked") - 1) / F.lit(HUNK_LINES)).cast("int")
    hunks = F.transform(
        F.sequence(F.lit(0), last),
        lambda h: _hunk(F.slice("marked", h * HUNK_LINES + 1, F.lit(HUNK_LINES)), h),
    )
    head = F.array(
        F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path")
    )
    sides = F.array(F.concat(F.lit("--- a/"), "path"), new_side)
    return marked.select(
        "doc_id",
        "repo",
        "review_id",
        "path",
        F.array_join(F.concat(head, extra, sides, hunks), "\n").alias("section"),
    )


def _collected(parts: DataFrame) -> DataFrame:
    in_order = F.array_sort(F.collect_list(F.struct("doc_id", "section")))
    texts = F.transform(in_order, lambda s: s["section"])
    return parts.groupBy("repo", "review_id", "channel").agg(
        F.array_join(texts, "\n").alias("raw_diff")
    )


def _channel(doc_id: Column) -> Column:
    return F.when(F.floor(doc_id / F.lit(20)) % 4 == 0, "staged").otherwise("unstaged")


def raw_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a diff of its review, in one channel."""
    parts = sections(documents(spark, sf_dir))
    return _collected(parts.withColumn("channel", _channel(F.col("doc_id"))))


def merge_raw_diffs(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Diffs that share paths between channels; they leave room for snapshots, which have
    the other documents, or hold every document."""
    i = F.col("doc_id")
    both = F.array(F.lit("staged"), F.lit("unstaged"))
    channels = F.when(i % 9 == 0, both).otherwise(F.array(_channel(i)))
    docs = documents(spark, sf_dir)
    parts = sections(docs if every else docs.filter(i % 7 != 6))
    return _collected(parts.withColumn("channel", F.explode(channels)))


def snapshots(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Whole files, untracked and listed: those that the diffs lack and as many that they
    cover, or every document."""
    i = F.col("doc_id")
    docs = documents(spark, sf_dir)
    return (docs if every else docs.filter(i % 7 >= 5)).select(
        "repo",
        "review_id",
        "path",
        F.array_join("lines", "\n").alias("content"),
        F.when(i % 2 == 0, "untracked").otherwise("staged_list").alias("origin"),
        i.alias("file_seq"),
    )


def reviewed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of the files the diffs touch: their added and context lines."""
    docs = documents(spark, sf_dir)
    marked = docs.withColumn("marked", _marked(F.col("lines"), F.col("doc_id")))
    kept = F.filter("marked", lambda x: x["mark"] != "-")
    return marked.select(
        "repo",
        "review_id",
        "path",
        F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("content"),
        F.lit("reviewed").alias("origin"),
        F.col("doc_id").alias("file_seq"),
    )


def ignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ignore file for two reviews of three, one of which lists ``.env``."""
    reviews = review_dimension(spark, sf_dir)
    number = F.try_to_number(F.regexp_extract("review_id", r"-r(\d+)$", 1), F.lit("999999999"))
    numbered = reviews.withColumn("number", number.cast("bigint") % 3).filter("number < 2")
    return numbered.select(
        "repo",
        "review_id",
        F.lit(".gitignore").alias("path"),
        F.when(F.col("number") == 0, "node_modules\ndist")
        .otherwise("node_modules\n.env")
        .alias("content"),
        F.lit("reviewed").alias("origin"),
        F.lit(0).cast("bigint").alias("file_seq"),
    )


def review_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews, including one per repository that changed nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    number = F.floor(F.col("doc_id") / F.lit(REVIEW_SIZE)).cast("bigint")
    numbers = docs.select("source", F.explode(F.array(number, F.lit(-1).cast("bigint"))).alias("n"))
    distinct = numbers.distinct()
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return distinct.select(
        F.col("source").alias("repo"),
        F.when(F.col("n") < 0, F.concat("source", F.lit("-empty")))
        .otherwise(F.concat("source", F.lit("-r"), F.col("n").cast("string")))
        .alias("review_id"),
        (start + F.make_dt_interval(hours=(F.col("n") + 1).cast("int"))).alias("ts"),
    )


def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long history per repository: one review per event of a user."""
    return as_history(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_history(events: DataFrame, **more: Column) -> DataFrame:
    """A table or stream of events as reviews; ``more`` names further columns."""
    score = F.greatest(
        F.lit(0).cast("bigint"), F.lit(100) - (F.floor("value").cast("bigint") % 45)
    )
    i = F.col("event_id")
    return events.select(
        F.col("user_id").cast("string").alias("repo"),
        i.cast("string").alias("review_id"),
        "ts",
        score.cast("bigint").alias("score"),
        (i % 7 + i % 5 + i % 3).alias("total_issues"),
        (i % 3).alias("errors"),
        (i % 5).alias("warnings"),
        (i % 7).alias("infos"),
        (i % 11).alias("file_count"),
        *[value.alias(name) for name, value in more.items()],
    )


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule hit per event; the event's type stands for the analyzer."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("user_id").cast("string").alias("repo"),
        F.col("event_id").cast("string").alias("review_id"),
        "ts",
        F.col("event_type").alias("analyzer"),
        F.col("event_id").alias("seq"),
    )


#: answer by ``doc_id`` modulo their number; @ stands for a line number of the document
ANSWERS = (
    '[{"line": @, "severity": "error", "message": "off by one", "suggestion": "use <"}]',
    'Sure: [{"line": @, "severity": "warning", "message": "unclear"},'
    ' {"line": 2, "severity": "info", "message": "rename it"}] as asked.',
    "[]",
    "Nothing to report.",
    '[{"line": @, "severity": "error", "message": "cut off',
    "[{'line': @, 'severity': 'error', 'message': 'single quotes'}]",
    '[{"line": 0, "severity": "error", "message": "no line"},'
    ' {"line": @, "severity": "error", "message": ""}]',
    '[{"line": @, "severity": "note", "message": "other severity"}]',
    '[{"line": 1e1, "severity": "error", "message": "a whole number"},'
    ' {"line": 3.5, "severity": "info", "message": "no whole number"}]',
    '[{"line": "12-14", "severity": "warning", "message": "a range"},'
    ' {"line": "@", "severity": "info", "message": "a number as text"}]',
    '[{"line": @, "severity": false, "message": "no severity"},'
    ' {"line": @, "severity": "error", "message": 0}]',
    '[{"line": 1, "line": @, "severity": "info", "message": "named twice"}]',
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assistant's answer for every file."""
    docs = documents(spark, sf_dir)
    line = (F.col("doc_id") % 20 + 1).cast("string")
    answer = _pick(ANSWERS, F.col("doc_id") % len(ANSWERS))
    return docs.select(
        "review_id", "path", F.replace(answer, F.lit("@"), line).alias("response")
    )
