"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

A row's number in a fixed order goes through a keyed permutation of 0..n-1; the result
says its shard and its slot there, and the inverse says which row a slot holds. Only ids,
sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchwell.llm.common import mix, utf8

ROUNDS = 6
#: Rows that are numbered together in one bucket, on average.
BUCKET_ROWS = 50_000


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys:
        left, right = right, left ^ (mix(right + key) & mask)
    return (right << shift) | left  # halves swapped, so that reversed keys invert


def _walk(x: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    half = _half_bits(n)
    out = _network(x.astype(np.uint64), half, keys)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], half, keys)
    return out.astype(np.int64)


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mix(np.array([seed], np.uint64)))


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Positions of row numbers below ``n`` in the shuffle. Cycle walking: a value outside
    0..n-1 goes through the network again, which ends as the network is a bijection."""
    return _walk(np.asarray(rows), n, _keys(seed))


def unpermute(positions: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers at the given positions: the inverse of :func:`permute`."""
    return _walk(np.asarray(positions), n, _keys(seed)[::-1])


def numbered(rows: DataFrame, order: list[str], n: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``row_number`` 0..n-1. Rows are dealt to buckets by a hash of the first column of the
    order, a bucket's rows are ranked by the order, and the buckets' counts give each bucket's
    first number, so no task sees more than a bucket and counting reads one column. Rows equal
    in the order share a bucket and are interchangeable."""
    spread = F.pmod(F.xxhash64(order[0]), F.lit(max(1, -(-n // bucket_rows))))
    rows = rows.withColumn("_bucket", spread)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    ranked = rows.withColumn("_rank", rank - 1).join(first, "_bucket")
    return ranked.withColumn("row_number", F.col("_first") + F.col("_rank")).drop("_bucket", "_rank", "_first")


def shard(docs: DataFrame, shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every document.

    Position p of the shuffle is slot p div ``shards`` of shard p mod ``shards``: counts differ
    by one at most (law ``rows``) and slots have no gaps. ``size`` is the text's UTF-8 bytes
    plus 8. Null texts count as empty, null and repeated ids are rows like others, equal rows
    are interchangeable, an empty table gives no rows, other columns are ignored."""
    n = docs.count()
    text = utf8("text")
    rows = docs.select("doc_id", (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = numbered(rows, ["doc_id", "text_crc32", "size"], n, bucket_rows)

    @F.pandas_udf("long")
    def position(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    return rows.withColumn("_at", position("row_number")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_at") % shards).cast("int").alias("shard"),
        F.floor(F.col("_at") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
