"""Benchmark decontamination: test n-grams as a broadcast hash set, scanned over all texts.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. Every
window of 13 consecutive words of a test item is looked for; a shorter item is one window.
Candidates found by hash are verified word by word before they count.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchwell.llm.common import given_columns, make_room, mix, spread, utf8

WINDOW = 13
#: Text bytes of test items that one broadcast set may hold; more are scanned in several passes.
SLICE_BYTES = 16 << 20
#: Text bytes that are scanned at once within a batch.
SCAN_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(257, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:256] = True
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:  # doubling: the second half is the first times base ** size
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(pow(base, size, 1 << 64))
        size += more
    return out


class Words:
    """The words of several texts laid end to end: bounds, document and a 64-bit hash each."""

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = b" ".join([*texts, b""])
        raw = np.frombuffer(self.raw, np.uint8)
        low = _LOWER[raw]
        word = np.zeros(len(raw) + 2, np.int8)
        word[1:-1] = _IS_WORD[low]
        edge = np.diff(word)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.offsets = spread(np.array([len(x) + 1 for x in texts]))
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, its first word
        n = len(raw) + 1
        sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE_VALUE[low] * _powers(_BASE, n - 1), out=sums[1:])
        back = _powers(pow(_BASE, -1, 1 << 64), n)
        self.hash = mix((sums[self.ends] - sums[self.starts]) * back[self.starts])
        self.low = low

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; texts are not kept apart."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(size):
            total = total * _STEP + self.hash[j : j + n]
        return mix(total)

    def words(self, first: int, size: int) -> tuple[bytes, ...]:
        starts, ends = self.starts[first : first + size], self.ends[first : first + size]
        return tuple(self.low[s:e].tobytes() for s, e in zip(starts, ends))


class NgramSet:
    """Windows of test items by size: sorted hashes, and the exact words with their items."""

    def __init__(self, items: list[tuple[str, bytes]], size: int) -> None:
        self.by_size: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            words = Words([text])
            n = len(words.hash)
            width = min(n, size)
            for i in range(n - width + 1 if n else 0):
                self.by_size.setdefault(width, {}).setdefault(words.words(i, width), set()).add(item)
        self.hashes = {k: self._hashes(k) for k in self.by_size}

    def _hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        sorted_hashes = np.unique([Words([b" ".join(w)]).windows(size)[0] for w in self.by_size[size]])
        bits = max(16, 4 + len(sorted_hashes).bit_length())
        seen = np.zeros(1 << bits, bool)
        seen[sorted_hashes & np.uint64((1 << bits) - 1)] = True
        return sorted_hashes, seen

    def hits(self, words: Words) -> list[tuple[int, int, set[str]]]:
        """(first word, size, items) of every verified occurrence that lies in one text."""
        out = []
        for size, (hashes, seen) in self.hashes.items():
            found = words.windows(size)
            maybe = np.flatnonzero(seen[found & np.uint64(len(seen) - 1)])
            at = np.searchsorted(hashes, found[maybe])
            maybe = maybe[hashes[np.minimum(at, len(hashes) - 1)] == found[maybe]]
            text = np.searchsorted(words.first, maybe, "right")
            maybe = maybe[maybe + size <= words.first[text]]
            exact = self.by_size[size]
            out += [(int(i), size, items) for i in maybe if (items := exact.get(words.words(i, size)))]
        return out


HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def _slices(benchmark: DataFrame, slice_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The distinct items in slices whose text has a bounded size."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), utf8("text").alias("text"))
    items = items.where(F.length("text") > 0).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / slice_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(x.item, bytes(x.text)) for x in part.collect()]  # about slice_bytes at most


def _scan_pass(docs: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    grams = docs.sparkSession.sparkContext.broadcast(NgramSet(items, window))
    schema = pa.schema(
        [
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("items", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            texts = batch.column("_utf8").to_pylist()
            kept = batch.drop_columns(["_utf8"])
            rows = [x for group in _groups(texts) for x in _hit_rows(group, grams.value)]
            columns = [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, *schema.names])

    more = T.StructType.fromDDL(HITS).fields
    result = T.StructType([T.StructField(f.name, f.dataType) for f in [*docs.schema, *more]])
    return docs.withColumn("_utf8", utf8("text")).mapInArrow(run, result)


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    group: list[bytes] = []
    size = 0
    for text in texts:
        if group and size + len(text) > SCAN_BYTES:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _hit_rows(texts: list[bytes], grams: NgramSet) -> list[tuple]:
    words = Words(texts)
    hit = np.zeros(len(words.hash) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for first, size, found in grams.hits(words):
        hit[first] += 1
        hit[first + size] -= 1
        items.setdefault(int(np.searchsorted(words.first, first, "right")) - 1, set()).update(found)
    covered = np.cumsum(hit[:-1]) > 0
    rows = []
    for k in range(len(texts)):
        a, b = words.first[k], words.first[k + 1]
        spans: list[dict[str, int]] = []
        if k in items:
            run = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]])))
            base = words.offsets[k]
            spans = [
                {"start": int(words.starts[a + s] - base), "end": int(words.ends[a + e - 1] - base)}
                for s, e in zip(run[::2], run[1::2])
            ]
        rows.append((int(b - a), int(covered[a:b].sum()), sorted(items.get(k, ())), spans))
    return rows


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``spans`` (byte
    ranges of hit words in the UTF-8 text).

    One pass over the texts, no shuffle. A benchmark beyond ``slice_bytes`` is scanned slice by
    slice; spans of later passes are merged in the row. Null and empty texts have no words; a null
    item id counts as ``null``, items without words are no items, repeated items count once;
    repeated documents each get their row. A column named like a result must be packed in a struct,
    as :func:`decontaminate` does."""
    passes = 0
    for items in _slices(benchmark, slice_bytes):
        found = _scan_pass(docs, items, window)
        if passes:
            found = _merged(found)
        names = ["n_words", "n_hit", "items", "spans"]
        docs = found.withColumnsRenamed({x: f"_before_{x}" for x in names})
        passes += 1
    return docs.withColumnsRenamed({f"_before_{x}": x for x in ("n_words", "n_hit", "items", "spans")})


def _merged(found: DataFrame) -> DataFrame:
    """Hits of this pass and those before, counted again over the merged spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["_utf8", "n_words", "items", "spans", "_before_items", "_before_spans"]).to_pylist()
            out = [_merge_row(x) for x in rows]
            kept = batch.drop_columns(["_utf8", "n_hit", "items", "spans", *(f"_before_{x}" for x in ("n_words", "n_hit", "items", "spans"))])
            types = batch.schema
            columns = [pa.array([x[k] for x in out], types.field(n).type) for k, n in enumerate(("n_hit", "items", "spans"))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "n_hit", "items", "spans"])

    keep = [f for f in found.schema if not f.name.startswith("_before_") and f.name not in ("n_hit", "items", "spans")]
    more = [f for f in T.StructType.fromDDL(HITS) if f.name != "n_words"]
    result = T.StructType([T.StructField(f.name, f.dataType) for f in [*keep, *more]])
    return found.withColumn("_utf8", utf8("text")).mapInArrow(run, result)


def _merge_row(row: dict) -> tuple[int, list[str], list[dict[str, int]]]:
    spans: list[dict[str, int]] = []
    both = sorted(row["spans"] + row["_before_spans"], key=lambda x: (x["start"], x["end"]))
    for x in both:
        if spans and x["start"] <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], x["end"])
        else:
            spans.append(dict(x))
    n_hit = sum(len(Words([row["_utf8"][x["start"] : x["end"]]]).hash) for x in spans)
    return n_hit, sorted({*row["items"], *row["_before_items"]}), spans


def contaminated(part: int = 20) -> F.Column:
    """One word in ``part`` or more is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * part >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document its words, hits, items and verdict; ids of several items in one digest."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """Documents without contamination: contaminated ``documents`` are left out, or hit ``spans``
    are cut out of their texts and every document stays. Columns as given."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")
    found = scan(docs.select(F.struct(*given_columns(docs)).alias("doc"), "text"), benchmark)
    if remove == "documents":
        return found.where(~contaminated()).select("doc.*")

    @F.udf("string")
    def cut(text: str | None, spans: list) -> str | None:
        if not text or not spans:
            return text
        raw, at, out = text.encode(), 0, []
        for s in spans:
            out.append(raw[at : s.start])
            at = s.end
        return b"".join([*out, raw[at:]]).decode()

    shorter = F.col("doc").withField("text", cut("text", "spans"))
    return found.select(shorter.alias("doc")).select("doc.*")


def digest(items: Iterable[str]) -> str:
    """What ``items_sha256`` holds for the given ids."""
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()
