"""Reviews of diffs as they arrive.

Splitting, numbering and all rules are narrow, so findings can be computed on a
stream as they are on a table. What spans several rows (merging channels, scores,
trends) is derived on read from tables that the stream appends to; those batch
operators spread a large review or repository over many tasks, which one state
per key could not.

Sinks keep each micro-batch in a folder of its own and overwrite it when the
batch is retried, so a batch that failed half-way leaves nothing behind twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from patchwell.operators.diff import file_sections, reviewable_diff_lines
from patchwell.operators.findings import scan, static_findings
from patchwell.settings import DEFAULTS, ReviewSettings
from patchwell.sources.tables import HISTORY, SNAPSHOTS, read_or_empty

#: columns that identify an arriving diff
ARRIVAL = ("repo", "review_id", "channel")


def arriving_findings(raw_diffs: DataFrame, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """Findings of arriving diffs, without state and without a shuffle."""
    lines = reviewable_diff_lines(file_sections(raw_diffs), settings.large_hunk)
    return static_findings(lines, settings)


def batch_folder(batch: DataFrame, out: str, batch_id: int) -> str:
    """A folder for one batch of one query: a new query, whose batches count from 0 again,
    replaces nothing of an earlier one."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{out}/query_id={query or 'none'}/batch_id={batch_id}"


def appended(
    stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]
) -> DataStreamWriter:
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def once(stream: DataFrame, kept_for: str | None, keys: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """Rows whose keys have not arrived before: within ``kept_for`` of their arrival, after which
    the state forgets them, or ever if that is null.

    Time is that of the micro-batch, so that nothing is dropped for being late."""
    if kept_for is None:
        return stream.dropDuplicates(list(keys))
    timed = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", kept_for)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop("_arrived")


def scan_arrivals(
    raw_diffs: DataFrame,
    out: str,
    checkpoint: str,
    settings: ReviewSettings = DEFAULTS,
    kept_for: str | None = None,
) -> DataStreamWriter:
    """Append the scan (sections and findings) of every new diff to ``out``.

    A diff that arrives again is skipped: the stream's state keeps the keys it has
    seen, for ``kept_for`` if that is given, so a batch costs what it brings. For diffs
    that arrive as files ``files.scan_files`` keeps texts out of the state's shuffle. Files, scores, reports and fixes are the
    batch operators on ``read_scan``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        none = batch.sparkSession.createDataFrame([], SNAPSHOTS)
        scan(batch, none, settings).write.mode("overwrite").parquet(batch_folder(batch, out, batch_id))

    return appended(once(raw_diffs, kept_for), checkpoint, write)


def read_scan(spark: SparkSession, out: str) -> DataFrame:
    """The scans of all batches so far."""
    return spark.read.parquet(out).drop("query_id", "batch_id")


def append_history(
    reviews: DataFrame, out: str, checkpoint: str, kept_for: str | None = None
) -> DataStreamWriter:
    """Append arriving review rows to the history; trends are derived on read. A review that
    arrives again (within ``kept_for``, if given) is skipped."""
    columns = [c.split()[0] for c in HISTORY.split(", ")]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(batch, out, batch_id))

    return appended(once(reviews.select(*columns), kept_for, ("review_id",)), checkpoint, write)


def read_history(spark: SparkSession, out: str) -> DataFrame:
    """The history so far, empty before the first batch."""
    parts = f"{HISTORY}, query_id string, batch_id bigint"
    return read_or_empty(spark, out, parts).drop("query_id", "batch_id")


def replaced(totals: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Keep the newest totals of a streaming aggregate in ``out``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return appended(totals, checkpoint, write).outputMode("complete")


def running_rule_hits(findings: DataFrame) -> DataFrame:
    """Hits per repository and analyzer of a stream of findings.

    A built-in streaming aggregate: partial counts are combined before the
    shuffle and the state holds one number per repository and analyzer.
    """
    return findings.groupBy("repo", "analyzer").agg(F.count(F.lit(1)).alias("hits"))
