"""Tables that several runs write and many jobs read.

All tables of one run appear together: a run writes each of them under an attempt of its own, and
then one row in ``commits`` that names the attempt. Readers take, of every run, the attempt that
was committed last, so a run that failed half-way shows nothing, and a run that is repeated
replaces all it had published at once. Tables are partitioned by the day of the review, run and
attempt; readers that state days list and read those alone.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchwell.sources.tables import read_or_empty

COMMITS = "run_id string, attempt string, committed_at timestamp"
PLACE = ("review_date", "run_id", "attempt")


@dataclass(frozen=True)
class Publication:
    """One attempt of one run; nothing of it is visible before :meth:`commit`."""

    spark: SparkSession
    out: str
    run_id: str
    attempt: str = field(default_factory=lambda: uuid.uuid4().hex)

    def write(self, name: str, rows: DataFrame, day: Column | None = None) -> DataFrame:
        """Write a table of this attempt, by the day of ``ts`` if no other is given, and give what
        was written back."""
        dated = rows.withColumn("review_date", F.to_date("ts") if day is None else day)
        placed = dated.withColumns({"run_id": F.lit(self.run_id), "attempt": F.lit(self.attempt)})
        # a file for each day, several of a large one
        placed.hint("rebalance", "review_date").write.partitionBy(*PLACE).mode("append").parquet(f"{self.out}/{name}")
        return self.own(name, placed)

    def own(self, name: str, like: DataFrame) -> DataFrame:
        written = read_or_empty(self.spark, f"{self.out}/{name}", _ddl(like))
        mine = (F.col("run_id") == self.run_id) & (F.col("attempt") == self.attempt)
        return written.where(mine).drop("run_id", "attempt")

    def commit(self) -> None:
        """Make all that this attempt has written visible, and what it replaces invisible."""
        row = self.spark.createDataFrame([(self.run_id, self.attempt)], "run_id string, attempt string")
        stamped = row.withColumn("committed_at", F.current_timestamp())
        stamped.coalesce(1).write.mode("append").parquet(f"{self.out}/commits")


def _ddl(like: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)


def commits(spark: SparkSession, out: str) -> DataFrame:
    """The attempt that counts of every run, a row each."""
    last = F.max_by(F.struct("attempt", "committed_at"), F.struct("committed_at", "attempt")).alias("last")
    return read_or_empty(spark, f"{out}/commits", COMMITS).groupBy("run_id").agg(last).select("run_id", "last.*")


def read_published(
    spark: SparkSession,
    out: str,
    name: str,
    schema: str,
    first_day: datetime.date | None = None,
    last_day: datetime.date | None = None,
) -> DataFrame:
    """What committed runs have published of a table, of the days from ``first_day`` to
    ``last_day``; with ``review_date``, ``run_id`` and ``committed_at``. Empty before the first."""
    rows = read_or_empty(spark, f"{out}/{name}", f"{schema}, review_date date, run_id string, attempt string")
    if first_day is not None:
        rows = rows.where(F.col("review_date") >= F.lit(first_day))
    if last_day is not None:
        rows = rows.where(F.col("review_date") <= F.lit(last_day))
    return rows.join(commits(spark, out), ["run_id", "attempt"]).drop("attempt")
