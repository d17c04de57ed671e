from __future__ import annotations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchwell.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a DataFrame; Python workers of a local session find the package."""
    table(spark, SF, "region")

    def make(rows: list[tuple], schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def docs(frame):
    """Documents with everything that may go wrong, and columns named like results."""

    def make(rows: list[tuple]) -> DataFrame:
        df = frame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)
        clash = ("n_hit", "n_words", "items", "spans", "fp", "grams", "likelihood", "_utf8", "_row", "_block", "rank", "length")
        return df.withColumns({c: F.lit("x") for c in clash})

    return make


@pytest.fixture(scope="session")
def odd_rows():
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    return [
        (1, None),
        (2, ""),
        (3, "  \n\t "),
        (4, long),
        (5, "The same text twice over, with some words in it."),
        (6, "The same text twice over, with some words in it."),
        (6, "The same text twice over, with some words in it."),
        (None, "A row without an id that says a few things."),
        (None, None),
        (7, "é" * 500),
        (8, "one"),
    ]
