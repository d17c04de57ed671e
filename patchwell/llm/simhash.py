"""Near duplicates by SimHash: fingerprints of 3-word shingles, joined through a binary trie.

Two fingerprints link if they differ in at most two of 64 bits. Then one of three blocks of
bits is equal in both, so fingerprints are dealt by each block's value and joined within
it; a trie over the other bits is walked in pairs of nodes, and a pair is left as soon as the
bits on its two paths differ in more places than allowed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchwell.llm.common import free_name, given_columns, make_room, mix, row_key, utf8, written
from patchwell.llm.components import components

BITS = 64
BUDGET = 2
SEED = 42
SHINGLE = 3
#: Fingerprints that share a block's value before they are dealt by more bits.
GROUP_ROWS = 50_000
#: Shingles whose bits are counted at once.
_CHUNK = 8192


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes; zero for a text without words."""
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :])]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at : at + _CHUNK], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long; and the column ``key``, a string, as ``row``."""
    more = [] if key is None else [("row", pa.string())]
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), *more])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
            own = [batch.column(name).cast(pa.string()) for name, _ in more]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), *own], schema=schema)

    carried = [] if key is None else [F.col(key).alias("row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"), *carried)
    return rows.mapInArrow(run, "doc_id long, fp long" + (", row string" if more else ""))


# --- the trie join of one group -------------------------------------------------------------


def trie_pairs(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of codes that differ in at most ``budget`` bits, within each range lo..hi.

    ``codes`` are distinct and ascending within a range and use their lowest ``width`` bits. A
    trie node is a range of codes with a common prefix; the walk goes down one bit at a time
    over all open pairs of nodes, adds a bit that differs and prunes beyond the budget. A pair of
    single codes is decided at once by the bits that are left."""
    a_lo, a_hi, b_lo, b_hi = lo, hi, lo, hi
    cost = np.zeros(len(lo), np.int64)
    left, right = [], []
    for bit in range(width - 1, -1, -1):
        single = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        if single.any():
            i, j = a_lo[single], b_lo[single]
            rest = (codes[i] ^ codes[j]) & np.uint64((1 << (bit + 1)) - 1)
            near = (i != j) & (cost[single] + np.bitwise_count(rest) <= budget)
            left.append(i[near])
            right.append(j[near])
            a_lo, a_hi, b_lo, b_hi, cost = (x[~single] for x in (a_lo, a_hi, b_lo, b_hi, cost))
        if not len(a_lo):
            break
        ones = np.concatenate([[0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        a_mid = a_hi - (ones[a_hi] - ones[a_lo])
        b_mid = b_hi - (ones[b_hi] - ones[b_lo])
        other = a_lo != b_lo  # of a node with itself one order of its two children is enough
        pairs = [
            (a_lo, a_mid, b_lo, b_mid, cost),
            (a_mid, a_hi, b_mid, b_hi, cost),
            (a_lo, a_mid, b_mid, b_hi, cost + 1),
            tuple(x[other] for x in (a_mid, a_hi, b_lo, b_mid, cost + 1)),
        ]
        a_lo, a_hi, b_lo, b_hi, cost = (np.concatenate(x) for x in zip(*pairs))
        keep = (a_hi > a_lo) & (b_hi > b_lo) & (cost <= budget) & ~((a_lo == b_lo) & (a_hi - a_lo == 1))
        a_lo, a_hi, b_lo, b_hi, cost = (x[keep] for x in (a_lo, a_hi, b_lo, b_hi, cost))
    left.append(a_lo)
    right.append(b_lo)
    return np.concatenate(left), np.concatenate(right)


# --- dealing fingerprints by blocks of equal bits -------------------------------------------
# A path such as (0, 2) says: block 0 of all bits is equal, and block 2 of the bits left.


def _blocks(path: tuple[int, ...], budget: int) -> tuple[list[list[int]], list[int]]:
    """Of each step of the path the bits of its budget + 1 blocks, and the bits that stay free."""
    free = list(range(BITS))
    steps = []
    for block in path:
        cuts = [len(free) * k // (budget + 1) for k in range(budget + 2)]
        steps.append([free[a:b] for a, b in zip(cuts, cuts[1:])])
        free = [x for k, own in enumerate(steps[-1]) if k != block for x in own]
    return [b for step in steps for b in step], free


def _gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for bit in bits:
        out = (out << np.uint64(1)) | ((fps >> np.uint64(bit)) & np.uint64(1))
    return out


def _fixed(path: tuple[int, ...], budget: int) -> list[int]:
    return sorted(set(range(BITS)) - set(_blocks(path, budget)[1]))


def _key(fps: np.ndarray, path: tuple[int, ...], budget: int) -> np.ndarray:
    """A group's key: the path and the values of all fixed bits (injective for one path)."""
    salt = np.uint64(int("1" + "".join(map(str, path)), 10))
    return mix(mix(_gather(fps, _fixed(path, budget))) + salt).view(np.int64)


def _first_time(a: np.ndarray, b: np.ndarray, path: tuple[int, ...], budget: int) -> np.ndarray:
    """True where at each step no earlier block is equal too: other paths drop the pair."""
    blocks, _ = _blocks(path, budget)
    different = a ^ b
    first = np.ones(len(a), bool)
    for step, block in enumerate(path):
        for own in blocks[step * (budget + 1) : step * (budget + 1) + block]:
            first &= _gather(different, own) != 0
    return first


def _partition_pairs(path: tuple[int, ...], keys: np.ndarray, fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    free = _blocks(path, budget)[1]
    codes = _gather(fps, free)
    order = np.lexsort((codes, keys))
    keys, codes, fps = keys[order], codes[order], fps[order]
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    lo, hi = edges[:-1], edges[1:]
    several = hi - lo > 1
    i, j = trie_pairs(codes, lo[several], hi[several], len(free), budget)
    a, b = fps[i], fps[j]
    once = _first_time(a, b, path, budget)
    return a[once], b[once]


def _deal(rows: DataFrame, budget: int) -> DataFrame:
    """Each fingerprint once more for each block that its path can go on with."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, part in batch.groupby("path"):
                fps = part.fp.to_numpy().view(np.uint64)
                for block in range(budget + 1):
                    longer = (*map(int, path), block)
                    yield pd.DataFrame({"path": "".join(map(str, longer)), "key": _key(fps, longer, budget), "fp": part.fp})

    return rows.select("path", "fp").mapInPandas(run, "path string, key long, fp long")


def _group_pairs(rows: DataFrame, budget: int) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # a partition of bounded groups of 8-byte fingerprints
        if parts:
            for path, part in pd.concat(parts).groupby("path"):
                fps = part.fp.to_numpy().view(np.uint64)
                a, b = _partition_pairs(tuple(map(int, path)), part.key.to_numpy(), fps, budget)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.repartition("key").mapInPandas(run, "a long, b long")


def links(distinct: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints ``fp`` within the budget, each pair once.

    A group above ``group_rows`` is dealt again by blocks of the bits left, until it is small
    enough or so few bits are free that its distinct fingerprints are few by themselves."""
    rows = _deal(distinct.select(F.lit("").alias("path"), "fp"), budget)
    found = None
    for _ in range(3):  # after four steps at most 13 of 64 bits are free
        large = rows.groupBy("path", "key").count().where(F.col("count") > group_rows).select("path", "key")
        large = written(large, "groups")
        if large.isEmpty():
            break
        small = _group_pairs(rows.join(large, ["path", "key"], "left_anti"), budget)
        found = small if found is None else found.union(small)
        rows = _deal(rows.join(large, ["path", "key"], "left_semi"), budget)
    last = _group_pairs(rows, budget)
    return last if found is None else found.union(last)


def _classes(prints: DataFrame, budget: int) -> DataFrame:
    """``fp, root, least``: the component of each fingerprint and its own smallest ``doc_id``."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), budget))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document.

    Documents with equal fingerprints are one node, so copies never become pairs. The
    component's id is its smallest ``doc_id``. Null and empty texts have fingerprint zero, which
    links like any other; rows without a ``doc_id`` take part, and a component of nothing else
    has a null id; repeated rows each get their row; an empty table gives none; other columns
    are ignored."""
    prints = written(fingerprints(docs), "fingerprints")
    named = _classes(prints, budget)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row of each component; columns as given.

    Rows are told apart by id and text, not by id alone. The row with the smallest id stays (rows
    without one come last, equal ids go by a digest of the text), and of rows that agree in both
    any one. Texts meet an anti join with the digests of the rows that go; only rows that occur
    more than once and stay are grouped."""
    key = free_name(docs, "_row")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    prints = written(fingerprints(keyed, key), "fingerprints")
    roots = written(_classes(prints, budget).select("fp", "root"), "roots")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    members = prints.groupBy("fp", "row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times"))
    members = members.join(roots, "fp")
    first = members.groupBy("root").agg(F.min(place)["row"].alias("_first"))
    placed = written(members.join(first, "root").select(F.col("row").alias(key), "times", (F.col("row") == F.col("_first")).alias("_stays")), "members")
    aside = placed.where("not _stays or times > 1").select(key)
    columns = given_columns(docs)
    kept = keyed.join(aside, key, "left_anti").select(*columns)
    repeated = placed.where("_stays and times > 1").select(key)
    if repeated.isEmpty():
        return kept
    once = keyed.join(repeated, key, "left_semi").dropDuplicates([key]).select(*columns)
    return kept.union(once)
