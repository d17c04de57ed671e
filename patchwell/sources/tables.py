"""Schemas, readers and sinks of the review tables."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_
from urllib.parse import unquote, urlsplit

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchwell.functions.fixed_values import WHITE_SPACE

RAW_DIFFS = "repo string, review_id string, channel string, raw_diff string"
SNAPSHOTS = (
    "repo string, review_id string, path string, content string, origin string, file_seq bigint"
)
REVIEWS = "repo string, review_id string, ts timestamp_ntz"
HISTORY = (
    "repo string, review_id string, ts timestamp_ntz, score bigint, total_issues bigint,"
    " errors bigint, warnings bigint, infos bigint, file_count bigint"
)
RULE_HITS = "repo string, review_id string, ts timestamp_ntz, analyzer string, seq bigint"
RESPONSES = "review_id string, path string, response string"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read a parquet table with its known schema (no inference)."""
    return spark.read.schema(schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read a table that need not exist yet, such as the history before a first run.

    Only a missing path counts as no state; any other failure is raised.
    """
    from pyspark.errors import AnalysisException

    try:
        return read_table(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_diff_texts(spark: SparkSession, path: str) -> DataFrame:
    """Read diff files laid out as ``<repo>/<review>/<channel>.diff``.

    Reviews of two repositories may have the same name, so the id is both names.
    """
    texts = spark.read.text(path, wholetext=True)
    return texts.select(*_diff_keys(texts), F.col("value").alias("raw_diff"))


#: columns that tell diffs apart
KEYS = ("repo", "review_id", "channel")
#: where one section of a diff ends and the next begins
SECTION_START = "diff --git "
SECTIONS = (
    "repo string, review_id string, channel string, section_seq bigint, path string, status string,"
    " section string"
)


#: Spark lists a folder a task and takes a file for 4 MB when it deals files to tasks; diffs are small,
#: and opening one was measured to take about as long as the rules take for 8 KB of text. Smaller splits
#: leave what is stored in even parts.
SMALL_FILES = {
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "32",
    "spark.sql.files.openCostInBytes": "16k",
    "spark.sql.files.maxPartitionBytes": "32m",
}


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Listing and reading very many small files takes few tasks; a session's own choice stays."""
    given = set(spark.conf.getAll)
    ours = {k: v for k, v in SMALL_FILES.items() if k not in given}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in ours:
            spark.conf.unset(k)


#: Keys are taken from a file's name, in tasks. Where Spark takes folders for partitions, its driver tries
#: types on each key (``007`` becomes 7) and then walks a linked list for each folder, so the time grows
#: with the square of their number.
BY_NAME = ("recursiveFileLookup", "true")
#: files up to this size are read whole: a row holds a section or a small file
WHOLE_FILE = 1 << 20
#: Spark's text reader unpacks these, so they are left to it
COMPRESSED = r"\.(deflate|gz|bz2|lz4|snappy|zst|zstd|xz)$"


def _whole_size(spark: SparkSession) -> int:
    """Size up to which files are read whole; what Spark would cut is not."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return min(WHOLE_FILE, int(number) << 10 * " kmgtp".index(unit or " "))


def read_diff_files(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Diff files of any size: small files as whole diffs (``RAW_DIFFS``), the sections of larger ones
    as ``read_diff_sections`` cuts them, or none if no file is large.

    A small file's first and last section are known in its row, so it is read once and nothing is
    shuffled for it. All files are listed once; larger ones once more."""
    files = spark.read.format("binaryFile").option(*BY_NAME).load(path)
    # settled by the listing: neither side opens the other's files
    small = (F.col("_metadata.file_size") <= _whole_size(spark)) & ~F.col("_metadata.file_name").rlike(COMPRESSED)
    whole = files.where(small).select(*_diff_keys(files), F.col("content").cast("string").alias("raw_diff"))
    if files.where(~small).isEmpty():
        return whole, None
    return whole, read_diff_sections(spark, path, ~small)


def read_diff_sections(spark: SparkSession, path: str | list[str], some: Column | None = None) -> DataFrame:
    """Sections of diff files of any size: ``SECTIONS`` without path and status.

    Spark cuts files into splits and records at section starts, so one diff file spreads over
    tasks and no row holds more than a section. ``section_seq`` orders the sections of a file: the
    start of the split plus the place in it. (A split of full size has a task of its own, so places
    never reach the next split's start; only a file's last split shares a task.)

    What trimming the whole text does to its first and last section needs to know which these are.
    Only sections that end in white space, or do not look like sections, can be concerned; these
    alone are joined with the ends of their files, all others pass without a shuffle. Text before
    the first section whose first line reads like the rest of a section's (``a/x b/x``) counts as
    a section.

    Files lie as ``<repo>/<review>/<channel>.diff``, or in folders that name ``repo``,
    ``review_id`` and ``channel`` as Spark partitions them. ``some`` says by ``_metadata`` which
    files to read."""
    texts = spark.read.option("lineSep", "\n" + SECTION_START).option(*BY_NAME).text(path)
    if some is not None:
        texts = texts.where(some)
    records = texts.select(
        *_diff_keys(texts),
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    ).withColumn("section_seq", F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1))
    value = F.col("value")
    in_front = (F.col("start") == 0) & value.startswith(SECTION_START)
    may_be_preface = (F.col("start") == 0) & ~in_front & ~value.rlike(r'\A"?a/[^\n]* "?b/')
    may_be_trimmed = F.rtrim(value, F.lit(WHITE_SPACE)) != value
    concerned = may_be_preface | may_be_trimmed
    columns = ["repo", "review_id", "channel", "section_seq"]
    complete = F.when(in_front, value).otherwise(F.concat(F.lit(SECTION_START), value))
    untouched = records.where(~concerned).select(*columns, complete.alias("section"))

    ends = records.groupBy("file").agg(F.min("section_seq").alias("first"), F.max("section_seq").alias("last"))
    edges = records.where(concerned).join(ends, "file")
    is_first, is_last = (F.col("section_seq") == F.col(c) for c in ("first", "last"))
    begun = F.when(is_first, F.ltrim(value, F.lit(WHITE_SPACE))).otherwise(F.concat(F.lit(SECTION_START), value))
    edges = edges.withColumn("_begun", begun)
    ended = F.when(is_last, F.rtrim("_begun", F.lit(WHITE_SPACE))).otherwise(F.col("_begun"))
    edges = edges.select(*columns, ended.alias("section")).where("section <> ''")
    return untouched.unionByName(edges)


def _diff_keys(texts: DataFrame) -> list[Column]:
    """Repository, review and channel of a diff file, from its folders, named or not."""
    if set(KEYS) <= set(texts.columns):
        return [F.col(c).cast("string").alias(c) for c in KEYS]
    path = F.col("_metadata.file_path")
    parts = F.split(path, "/")

    def decoded(name: Column) -> Column:
        return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)

    def from_end(i: int) -> Column:
        return decoded(F.element_at(parts, -i))

    plain = (
        from_end(3),
        F.concat(from_end(3), F.lit("/"), from_end(2)),
        F.regexp_replace(from_end(1), r"\.diff$", ""),
    )

    def of_name(key: str) -> Column:
        """Escaped by Spark within the folder's name, which is encoded within the path."""
        value = decoded(decoded(F.regexp_extract(path, f"/{key}=([^/]*)/", 1)))
        return F.when(value != NO_VALUE, value)

    named = reduce(and_, [path.contains(f"/{key}=") for key in KEYS])
    return [F.when(named, of_name(key)).otherwise(value).alias(key) for key, value in zip(KEYS, plain)]


#: characters that Spark escapes in the names of folders it partitions by
ESCAPED = re.compile(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _named(key: str, value: str | None) -> str:
    """Name of the folder of a key's value, as Spark partitions a table."""
    return f"{key}=" + (ESCAPED.sub(lambda x: f"%{ord(x[0]):02X}", value) if value else NO_VALUE)


def _mounted(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder in a file system that all executors mount, null if it lies elsewhere."""
    at = urlsplit(folder)
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    if (at.scheme or urlsplit(default).scheme) != "file":
        return None
    return unquote(at.path) if at.scheme else folder


def write_diff_files(diffs: DataFrame, folder: str) -> None:
    """Append diffs (``RAW_DIFFS``, one row per repository, review and channel) to a folder, a file
    for each, in folders that name the keys as Spark partitions them.

    The files are those of Spark's text writer, which stays the writer for remote stores. On a
    mounted file system that makes a checksum beside each file and, without Hadoop's native library,
    starts a process for each of both; and one thread of the driver moves all folders at the end.
    So there tasks write files themselves. A file appears whole, and a task that is repeated
    replaces what it wrote."""
    diffs = diffs.select(*KEYS, "raw_diff")
    root = _mounted(diffs.sparkSession, folder)
    if root is None:
        diffs.write.partitionBy(*KEYS).mode("append").text(folder)
        return
    name = f"part-{uuid.uuid4().hex}.txt"

    def write(batches):
        import pyarrow as pa

        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for row in zip(*batch.columns):
                *values, text = row
                at = os.path.join(root, *[_named(k, v.as_py()) for k, v in zip(KEYS, values)])
                os.makedirs(at, exist_ok=True)
                part = os.path.join(at, f".{name}.{attempt}")
                with open(part, "wb") as file:
                    if text.is_valid:
                        file.write(text.as_buffer())
                    file.write(b"\n")
                os.replace(part, os.path.join(at, name))
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    workers_find_package(diffs.sparkSession)
    os.makedirs(root, exist_ok=True)
    diffs.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def stored(df: DataFrame, path: str, run_id: str, partition: str | None = None) -> DataFrame:
    """Write one run's rows of a table and read them back.

    A run has a folder of its own, which it replaces when it is repeated, so a run
    that failed half-way leaves nothing twice.
    """
    writer = df.write.mode("overwrite")
    if partition is not None:
        writer = writer.partitionBy(partition)
    folder = f"{path}/run_id={run_id}"
    writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_findings(findings: DataFrame, path: str, run_id: str) -> None:
    """Write a run's findings, partitioned by the day of their review.

    The redaction columns stay with the job that proposes edits. Messages hold what
    the rules quote: of a note its text, of a secret its kind.
    """
    kept = findings.drop("redacted_text", "secret_sha256")
    stored(kept.withColumn("review_date", F.to_date("ts")), path, run_id, "review_date")


def write_history(reviews: DataFrame, path: str, run_id: str) -> None:
    """Write one row per review; everything about trends is derived on read."""
    rows = reviews.select(*[c.split()[0] for c in HISTORY.split(", ")])
    stored(rows.withColumn("review_date", F.to_date("ts")), path, run_id, "review_date")


def workers_find_package(spark: SparkSession) -> None:
    """Python workers of a local session get to know where this package lies; on a cluster it is
    installed or shipped with the job."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def scratch_folder(spark: SparkSession) -> str:
    """A folder that all executors share: the checkpoint folder, else the warehouse."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir")
