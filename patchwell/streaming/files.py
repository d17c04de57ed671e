"""Reviews of diff files as they arrive.

The stream carries file names, not texts: what decides whether a diff is new is its key, so the
state holds keys alone, for a stated time after they arrived, and no text is shuffled. Each
micro-batch reads its own files once, small ones whole and larger ones split at sections.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from patchwell.operators.diff import name_sections
from patchwell.operators.findings import scan
from patchwell.settings import DEFAULTS, ReviewSettings
from patchwell.sources.tables import SNAPSHOTS, read_diff_files, small_files
from patchwell.streaming.arrivals import ARRIVAL, appended, batch_folder, once

LISTING = "path string, modificationTime timestamp, length bigint, content binary"
#: files of one micro-batch at most; their names are what the driver holds
BATCH_FILES = 10_000


def _keys(path: Column) -> list[Column]:
    """Repository, review and channel by a file's folders, named or not."""
    parts = F.split(path, "/")
    plain = (F.element_at(parts, -3), F.element_at(parts, -2), F.regexp_replace(F.element_at(parts, -1), r"\.diff$", ""))
    named = path.contains("/repo=") & path.contains("/review_id=") & path.contains("/channel=")
    return [
        F.when(named, F.regexp_extract(path, f"/{key}=([^/]*)/", 1)).otherwise(value).alias(key)
        for key, value in zip(ARRIVAL, plain)
    ]


def arriving_files(spark: SparkSession, folder: str, kept_for: str, batch_files: int = BATCH_FILES) -> DataFrame:
    """Names of arriving diff files, ``path`` and keys, each key once within ``kept_for``.

    Contents are not read. Time is that of the micro-batch, so no file comes too late; of files
    of one key in one batch any may be taken, as they hold the same diff."""
    with small_files(spark):  # loading lists the folder
        listed = (
            spark.readStream.format("binaryFile")
            .schema(LISTING)
            .option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", batch_files)
            .load(folder)
        )
    return once(listed.select("path", *_keys(F.col("path"))), kept_for)


def _literal(path: str) -> str:
    """A path without characters that would match other names."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def batch_diffs(batch: DataFrame) -> tuple[DataFrame, DataFrame | None] | None:
    """Diffs of a batch's files, see ``read_diff_files``; their names go through the driver, bounded
    by the number of files of a batch."""
    spark = batch.sparkSession
    paths = [_literal(r.path) for r in batch.select("path").collect()]
    return read_diff_files(spark, paths) if paths else None


def scan_files(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    settings: ReviewSettings = DEFAULTS,
    kept_for: str = "7 days",
    batch_files: int = BATCH_FILES,
) -> DataStreamWriter:
    """Append the scan (sections and findings) of every new diff file to ``out``.

    ``arrivals.read_scan`` reads it, and files, scores, reports and fixes are the batch operators
    on that. The stream lists files by the settings of ``spark`` at the time, so a folder of very
    many files wants ``small_files`` to hold while it runs."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with small_files(batch.sparkSession):
            diffs = batch_diffs(batch)
            if diffs is None:
                return
            whole, sections = diffs
            none = batch.sparkSession.createDataFrame([], SNAPSHOTS)
            scanned = scan(whole, none, settings)
            if sections is not None:
                scanned = scanned.unionByName(scan(name_sections(sections), none, settings))
            scanned.write.mode("overwrite").parquet(batch_folder(batch, out, batch_id))

    return appended(arriving_files(spark, folder, kept_for, batch_files), checkpoint, write)
