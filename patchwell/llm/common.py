"""What several operators share: text as bytes, blocks of documents, the shared folder."""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one block of documents holds on average.
BLOCK_BYTES = 8 << 20
#: Text bytes below which a block is not worth a task.
LEAST_BYTES = 256 << 10


def utf8(name: str) -> Column:
    """The text as UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(bytearray(b"")))


def quoted(name: str) -> str:
    """A column's name as Spark parses it, whatever it is made of."""
    return "`" + name.replace("`", "``") + "`"


def given_columns(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: str) -> Column:
    """A digest that rows share if they agree in all of these columns; null is not empty."""
    parts = []
    for c in columns:
        text = F.col(quoted(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat(*parts))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Local Python workers get to know where this package lies."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_count(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """So many blocks that each holds about ``block_bytes`` of text; of a small table as many as
    Spark deals rows to, so that all tasks have some."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(total / block_bytes), min(tasks, math.ceil(total / LEAST_BYTES)))


def block_of(column: str, blocks: int) -> Column:
    """The block of a document, by its id alone, so that a lost task deals as before."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(blocks)).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets its own."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if where is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(where)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends, lost tasks reread it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[str, Any] = {}


def kept(name: str, build: Callable[[], Any]) -> Any:
    """The one thing that a worker process keeps from task to task; asking for another one
    drops it."""
    if name not in _kept:
        make_room()
        _kept[name] = build()
    return _kept[name]


def make_room() -> None:
    """Called by tasks that need memory themselves: workers outlive the jobs they served, and what
    those have freed goes back to the machine only when it is asked for."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def spread(total: np.ndarray) -> np.ndarray:
    """Start of each run of the given lengths laid end to end, and the end of the last."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(total, dtype=np.int64)])


def mix(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
