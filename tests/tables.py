"""Small tables for hand-written cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchwell.sources.tables import RAW_DIFFS, SNAPSHOTS


def raw_diffs(spark: SparkSession, *rows: tuple[str, str, str]) -> DataFrame:
    """(review_id, channel, text) rows."""
    return spark.createDataFrame([("repo", *row) for row in rows], RAW_DIFFS)


def snapshots(spark: SparkSession, *rows: tuple[str, str, str, str]) -> DataFrame:
    """(review_id, path, content, origin) rows, listed in the order given."""
    return spark.createDataFrame(
        [("repo", *row, i) for i, row in enumerate(rows)], SNAPSHOTS
    )


def section(path: str, *hunks: str, header: str = "", new_side: str | None = None) -> str:
    head = [f"diff --git a/{path} b/{path}"]
    if header:
        head.append(header)
    head += [f"--- a/{path}", new_side or f"+++ b/{path}"]
    return "\n".join([*head, *hunks])


def added(path: str, *lines: str, start: int = 1) -> str:
    """A section whose single hunk only adds lines."""
    body = "\n".join("+" + x for x in lines)
    return section(path, f"@@ -0,0 +{start},{len(lines)} @@\n{body}")


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
