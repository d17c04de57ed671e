"""Repeated byte strings: per-shard suffix arrays over all places where a repeat can be.

A string of ``length`` bytes that occurs twice has the same least gram (by hash) in both
places, so windows are dealt by their least gram, the *anchor*. Documents go in blocks of
some megabytes; what travels between blocks is packed arrays, never single positions:

1. each block counts its anchors' *stretches* (all windows that share one anchor place);
2. stretches are counted over all blocks: equal ones are merged with their number of copies,
   and an anchor that occurs in one place only is done;
3. blocks mark stretches with copies and send those of anchors with several different
   stretches, once each, to shards;
4. a shard sorts the suffixes of its stretches (Larsson-Sadakane refinement), takes common
   prefixes (Kasai) and marks windows that share ``length`` bytes with a neighbour;
5. a very frequent anchor is spread over several shards, whose sorted windows are merged by
   binary search;
6. blocks join the marked windows into byte spans and cut them out.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchwell.llm.common import BLOCK_BYTES, block_count, block_of, make_room, mix, quoted, spread, utf8

LENGTH = 200
#: Window starts whose anchors are computed at once.
STEP = 1 << 19
#: Bytes of stretches that one suffix array holds; indices and ranks take 21 bits each.
ARRAY_BYTES = 1 << 20
_INDEX_BITS = 21
_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)
_NO_U64 = np.zeros(0, np.uint64)


def gram_size(length: int) -> int:
    """A power of two, about a sixth of the length."""
    return 1 << max(0, (length // 4).bit_length() - 1)


def _pack(*arrays: np.ndarray) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def _unpack(packets: list[bytes]) -> list[np.ndarray]:
    """The arrays of several packets, each kind laid end to end."""
    return [np.concatenate(x) for x in zip(*(pickle.loads(x) for x in packets))]


# --- anchors --------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place, by doubling."""
    h = mix(data.astype(np.uint64) + np.uint64(1))
    size = 1
    while size < gram:
        h = h[:-size] * _MULTIPLY + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2
    return mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Stretches:
    """Runs of windows with one anchor: first and last start, anchor hash, hash of all bytes."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int) -> None:
        """``ends``: of each place in ``data`` the end of its text; no window crosses it."""
        parts = [self._step(data, ends, at, length) for at in range(0, max(0, len(data) - length + 1), STEP)]
        parts = parts or [(np.zeros(0, np.int64),) * 2 + (_NO_U64,) * 2]
        self.first, self.last, self.anchor, self.content = (np.concatenate(x) for x in zip(*parts))

    @staticmethod
    def _step(data: np.ndarray, ends: np.ndarray, at: int, length: int) -> tuple[np.ndarray, ...]:
        gram = gram_size(length)
        data = data[at : at + STEP + length - 1]
        h = _gram_hashes(data, gram)
        place_bits = np.uint64((1 << 20) - 1)
        key = (h & ~place_bits) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
        least = (_sliding_min(key, length - gram + 1) & place_bits).astype(np.int64)
        start = np.arange(len(least))
        start = start[start + at + length <= ends[at : at + len(least)]]
        if not len(start):
            return (start, start, _NO_U64, _NO_U64)
        anchor = least[start]
        cut = np.flatnonzero(np.diff(anchor)) + 1
        first, last = start[np.concatenate([[0], cut])], start[np.concatenate([cut - 1, [len(start) - 1]])]
        place = anchor[np.concatenate([[0], cut])]
        stop = last + length - gram  # the last gram
        content = mix((place - first).astype(np.uint64) + (np.uint64(1) << np.uint64(32)) * (stop - first).astype(np.uint64))
        for k in range(0, int((stop - first).max()) + 1, gram):
            more = first + k <= stop
            content[more] = mix(content[more] * _MULTIPLY + h[first[more] + k])
        content = mix(content * _MULTIPLY + h[stop])
        return first + at, last + at, h[place], content


def _in_order(docs: pa.Table) -> tuple[list[int], list[bytes]]:
    """Rows of a block in an order that a repeated task finds again, and their texts."""
    ids, texts = docs.column("_id").to_pylist(), docs.column("_utf8").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return order, [texts[i] for i in order]


class Block:
    """Documents of one block end to end, with their stretches."""

    def __init__(self, docs: pa.Table, length: int) -> None:
        make_room()
        _, texts = _in_order(docs)
        sizes = np.array([len(x) for x in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.number = docs.column("_block")[0].as_py()
        self.stretches = Stretches(self.data, np.repeat(spread(sizes)[1:], sizes), length)

    @property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self.stretches.anchor, self.stretches.content


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and the bounds of the runs of equal keys in that order."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order) + 1, bool)
    if len(order):
        new[1:-1] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new) if len(order) else np.zeros(1, np.int64)


# --- suffix arrays --------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order.

    Larsson-Sadakane: suffixes ordered by their first h bytes are put in order by 2h with the
    rank of the suffix h further on; groups of one are done and left alone. Group, rank and
    index are sorted as one 63-bit number."""
    n = len(text)
    if n >= 1 << _INDEX_BITS:
        raise ValueError("too long for one suffix array")
    used = np.unique(text)
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)
    bits = int(len(used)).bit_length()
    h = max(1, 42 // bits)
    padded = np.concatenate([code[text], np.zeros(h, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key = (key << np.uint64(bits)) | padded[k : k + n]
    low = np.uint64((1 << _INDEX_BITS) - 1)
    shift = np.uint64(_INDEX_BITS)
    both = np.sort((key << shift) | np.arange(n, dtype=np.uint64))
    sa = (both & low).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = (both[1:] >> shift) != (both[:-1] >> shift)
    rank = np.zeros(n + 1, np.uint64)  # zero at the end
    slots = np.arange(n)  # of the suffixes that are not in their place yet
    while True:
        group = np.maximum.accumulate(np.where(new, slots, 0))
        rank[sa[slots]] = group.astype(np.uint64) + np.uint64(1)
        alone = new & np.concatenate([new[1:], [True]])
        slots, group = slots[~alone], group[~alone]
        if not len(slots):
            return sa
        own = sa[slots]
        both = (group.astype(np.uint64) << (shift + shift)) | (rank[np.minimum(own + h, n)] << shift) | own.astype(np.uint64)
        both.sort()
        sa[slots] = (both & low).astype(np.int64)
        new = np.ones(len(slots), bool)
        new[1:] = (both[1:] >> shift) != (both[:-1] >> shift)
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, lanes: np.ndarray, counts: np.ndarray, cap: int) -> np.ndarray:
    """Of the suffixes at ``lanes[k] .. lanes[k] + counts[k] - 1`` the length, up to ``cap`` at
    least, shared with the suffix before them in the array; elsewhere zero.

    Kasai: a suffix shares at least one byte less than the suffix one place before it in the
    text. The lanes, stretches of text, go side by side; eight bytes are compared at a time."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)]).astype(np.uint64)
    eight = np.zeros(n + cap + 9, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(eight)]
    out = np.zeros(n, np.int32)
    order = np.argsort(-counts, kind="stable")
    lanes, counts = lanes[order], counts[order]
    shared = np.zeros(len(lanes), np.int64)
    for step in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -step, "left"))  # lanes that are longer than step
        i = lanes[:live] + step
        j = before[i]
        h = np.where(j < 0, 0, np.maximum(shared[:live] - 1, 0))
        open_ = np.flatnonzero((j >= 0) & (h < cap))
        while len(open_):
            differ = eight[i[open_] + h[open_]] ^ eight[j[open_] + h[open_]]
            same = (_leading_zeros(differ) >> 3).astype(np.int64)
            h[open_] += same
            open_ = open_[(same == 8) & (h[open_] < cap)]
        shared[:live] = h
        out[i] = h
    return out


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(shift))
    return np.bitwise_count(~x)


class Shard:
    """Stretches of a shard as one text; each is followed by a byte that UTF-8 never has."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, length: int) -> None:
        self.text = np.full(len(text) + len(sizes), 0xFF, np.uint8)
        self.starts = spread(sizes + 1)[:-1]
        inside = np.ones(len(self.text), bool)
        inside[self.starts + sizes] = False
        self.text[inside] = text
        self.length, self.windows = length, sizes - length + 1
        self.owner = np.repeat(np.arange(len(sizes)), self.windows)
        self.place = np.arange(len(self.owner)) - np.repeat(spread(self.windows)[:-1], self.windows)

    def classes(self) -> np.ndarray:
        """For each window, in the order of ``owner`` and ``place``, a number that it shares with
        the windows of equal bytes and with no others."""
        sa = suffix_array(self.text)
        shared = common_prefixes(self.text, sa, self.starts, self.windows, self.length)
        at = self.starts[self.owner] + self.place
        is_window = np.zeros(len(self.text), bool)
        is_window[at] = True
        in_order = sa[is_window[sa]]  # what lies between two equal windows is an equal window
        number = np.zeros(len(self.text), np.int64)
        number[in_order] = np.cumsum(shared[in_order] < self.length)
        return number[at]


# --- the steps ------------------------------------------------------------------------------

COUNTED = pa.schema([("_range", pa.int64()), ("_block", pa.int32()), ("_data", pa.binary())])
FLOW = pa.schema([("_key", pa.int64()), ("_kind", pa.int32()), ("_block", pa.int32()), ("_data", pa.binary())])
JUDGED = pa.schema([("_block", pa.int32()), ("_data", pa.binary())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.table([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _count(docs: pa.Table, length: int, ranges: int) -> pa.Table:
    """Step 1: different stretches of a block with their counts, a packet for each range of anchors."""
    block = Block(docs, length)
    anchor, content = block.pairs
    order, bounds = _runs(anchor % np.uint64(ranges), anchor, content)
    at = order[bounds[:-1]]
    anchor, content, copies = anchor[at], content[at], np.diff(bounds)
    where = anchor % np.uint64(ranges)
    cuts = np.flatnonzero(np.diff(where)) + 1 if len(where) else []
    parts = zip(*(np.split(x, cuts) for x in (where, anchor, content, copies.astype(np.int32))))
    return _rows(COUNTED, [(int(w[0]), block.number, _pack(a, c, n)) for w, a, c, n in parts if len(w)])


def _judge(packets: pa.Table, array_bytes: int, length: int) -> pa.Table:
    """Step 2: of each stretch that is not alone: has it copies; which block sends it; to how many
    shards its anchor is spread."""
    data = packets.column("_data").to_pylist()
    sizes = [len(pickle.loads(x)[0]) for x in data]
    anchor, content, copies = _unpack(data)
    block = np.repeat(packets.column("_block").to_numpy(), sizes)
    order, bounds = _runs(anchor, content)
    at = order[bounds[:-1]]  # one row of each different stretch
    total = np.add.reduceat(copies[order], bounds[:-1]) if len(at) else copies[:0]
    sender = np.minimum.reduceat(block[order], bounds[:-1]) if len(at) else block[:0]
    own = anchor[at]
    _, which, kinds = np.unique(own, return_inverse=True, return_counts=True)
    kinds = kinds[which]  # different stretches of the anchor
    shards = np.maximum(1, -(-kinds * 2 * length // array_bytes))
    back = np.repeat(np.arange(len(at)), np.diff(bounds))  # for the rows in order
    keep = (total > 1)[back] | (kinds > 1)[back]
    rows, back = order[keep], back[keep]
    send = np.where((kinds > 1)[back] & (sender[back] == block[rows]), shards[back], 0)
    out = []
    for b in np.unique(block[rows]):
        mine = block[rows] == b
        out.append((int(b), _pack(anchor[rows[mine]], content[rows[mine]], (total[back[mine]] > 1), send[mine].astype(np.int32))))
    return _rows(JUDGED, out)


def _mark_and_send(docs: pa.Table, packets: pa.Table, length: int, shards: int) -> pa.Table:
    """Step 3: marks of stretches with copies (kind 0), and stretches for the shards (kind 1)."""
    if not docs.num_rows or not packets.num_rows:
        return _rows(FLOW, [])
    block = Block(docs, length)
    x, number = block.stretches, block.number
    anchor, content, repeated, send = _unpack(packets.column("_data").to_pylist())
    key, sought = mix(mix(anchor) + content), mix(mix(x.anchor) + x.content)
    order = np.argsort(key, kind="stable")
    at = np.searchsorted(key[order], sought)
    at = order[np.minimum(at, len(key) - 1)]
    known = (anchor[at] == x.anchor) & (content[at] == x.content)
    rows = []
    marked = np.flatnonzero(known & repeated[at])
    if len(marked):
        rows.append((-1 - number, 0, number, _pack(*_joined(x.first[marked], x.last[marked] + length))))
    sent = np.flatnonzero(known & (send[at] > 0))
    _, once = np.unique(at[sent], return_index=True)  # equal stretches are sent once
    sent = sent[once]
    own, spread_over = at[sent], send[at[sent]].astype(np.uint64)
    part = content[own] % spread_over
    to = (anchor[own] % np.uint64(shards)).astype(np.int64)
    split = spread_over > 1
    to[split] = (mix(mix(anchor[own]) + part)[split] >> np.uint64(2)).astype(np.int64) + shards
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for some in np.split(order, cuts) if len(order) else []:
        first, last = x.first[sent[some]], x.last[sent[some]]
        text = np.concatenate([block.data[a : b + length] for a, b in zip(first, last)])
        owner = np.full(len(some), number, np.int32)
        packet = _pack(text, last - first + length, anchor[own[some]], ~repeated[own[some]], split[some], owner, first)
        rows.append((int(to[some[0]]), 1, number, packet))
    return _rows(FLOW, rows)


def _joined(starts: np.ndarray, ends: np.ndarray, touching: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping spans made one; also touching ones, which in a block may be of two documents."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    gap = starts[1:] > ends[:-1] if touching else starts[1:] >= ends[:-1]
    return starts[np.concatenate([[True], gap])], ends[np.concatenate([gap, [True]])]


def _marks(owner: np.ndarray, start: np.ndarray, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    for b in np.unique(owner):
        spans = _joined(start[owner == b], start[owner == b] + length)
        yield int(b), 0, int(b), _pack(*spans)


def _of_kind(packets: pa.Table, kind: int) -> list[tuple[int, int, int, bytes]]:
    return [tuple(x.values()) for x in packets.to_pylist() if x["_kind"] == kind]


def _sort_shard(packets: pa.Table, length: int, array_bytes: int, ranges: int) -> pa.Table:
    """Step 4: marks (kind 0) of repeated windows. Of a spread anchor also the digests of its
    different windows, in order (kind 2), a packet for each range of digests."""
    rows = _of_kind(packets, 0)
    sent = _of_kind(packets, 1)
    if sent:
        text, sizes, anchor, single, split, owner, first = _unpack([x[-1] for x in sent])
        offsets = spread(sizes)
        order = np.argsort(anchor, kind="stable")
        new = np.concatenate([[True], np.diff(anchor[order]) != 0])
        filled = np.maximum.accumulate(np.where(new, spread(sizes[order] + 1)[:-1], 0)) // array_bytes
        for some in np.split(order, np.flatnonzero(np.diff(filled)) + 1):
            own = np.concatenate([text[offsets[k] : offsets[k + 1]] for k in some])
            shard = Shard(own, sizes[some], length)
            number = shard.classes()
            alone = np.bincount(number)[number] == 1
            needs = single[some][shard.owner]
            start = first[some][shard.owner] + shard.place
            marked = needs & ~alone
            rows += _marks(owner[some][shard.owner][marked], start[marked], length)
            if split[some].any():
                rows += _digests(shard, number, split[some], needs & alone, anchor[some], owner[some], start, ranges)
    return _rows(FLOW, rows)


def _digests(shard: Shard, number: np.ndarray, split: np.ndarray, needs: np.ndarray, anchor: np.ndarray, owner: np.ndarray, start: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int, bytes]]:
    own = np.flatnonzero(split[shard.owner])
    _, once = np.unique(number[own], return_index=True)
    own = own[once]
    raw = shard.text.tobytes()
    at = (shard.starts[shard.owner] + shard.place)[own]
    digest = np.array([hashlib.blake2b(raw[i : i + shard.length], digest_size=16).digest() for i in at.tolist()], "S16")
    where = mix(anchor[shard.owner[own]]) + np.frombuffer(b"".join(x.ljust(16, b"\0") for x in digest.tolist()), np.uint64)[::2] % np.uint64(ranges)
    key = -1 - (where >> np.uint64(2)).astype(np.int64)
    order, bounds = _runs(key, digest)
    for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        packet = _pack(digest[some], needs[own[some]], owner[shard.owner[own[some]]], start[own[some]])
        yield int(key[some[0]]), 2, -1, packet


def _merge(packets: pa.Table, length: int) -> pa.Table:
    """Step 5: windows that occur in one shard of their anchor only once, but in another one too."""
    rows = [x[2:] for x in _of_kind(packets, 0)]
    lists = [pickle.loads(x[-1]) for x in _of_kind(packets, 2)]
    if lists:
        merged = np.sort(np.concatenate([x[0] for x in lists]))
        for digest, needs, owner, start in lists:  # digests of one list are all different
            times = np.searchsorted(merged, digest, "right") - np.searchsorted(merged, digest, "left")
            found = needs & (times > 1)
            rows += [(b, data) for b, _, _, data in _marks(owner[found], start[found], length)]
    return _rows(JUDGED, rows)


def _cut(docs: pa.Table, packets: pa.Table) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Step 6: of each document its row, its text and its spans."""
    order, texts = _in_order(docs)
    offsets = spread(np.array([len(x) for x in texts], np.int64))
    data = packets.column("_data").to_pylist()
    starts, ends = _unpack(data) if data else (np.zeros(0, np.int64),) * 2
    doc = np.searchsorted(offsets, starts, "right") - 1
    rank = np.lexsort((starts, doc))
    doc, starts, ends = doc[rank], starts[rank], ends[rank]
    bounds = np.searchsorted(doc, np.arange(len(order) + 1))
    for k, row in enumerate(order):
        a, b = bounds[k], bounds[k + 1]
        if a == b:
            yield row, texts[k], starts[:0], starts[:0]
        else:
            s, e = _joined(starts[a:b] - offsets[k], ends[a:b] - offsets[k], touching=True)
            yield row, texts[k], s, e


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    edges = [0, *(x for s, e in zip(starts.tolist(), ends.tolist()) for x in (s, e)), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _repeats(docs: DataFrame, length: int, array_bytes: int, block_bytes: int, build: Callable, schema: str | T.StructType) -> DataFrame:
    """Runs the six steps over packed rows; ``build`` makes the result of a block.

    The documents are dealt to blocks once: the three steps that read them share that exchange."""
    docs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        utf8("text").alias("_utf8"),
        F.struct(
            *(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(x for x in docs.columns if x != "text")),
            F.col("text").isNull().alias("null"),
        ).alias("_row"),
    )
    blocks = block_count(docs, "_utf8", block_bytes)
    ranges, shards = max(1, blocks // 4), blocks * 4
    dealt = docs.withColumn("_block", block_of("_id", blocks))

    def count(x: pa.Table) -> pa.Table:
        return _count(x, length, ranges)

    def judge(x: pa.Table) -> pa.Table:
        return _judge(x, array_bytes, length)

    def send(a: pa.Table, b: pa.Table) -> pa.Table:
        return _mark_and_send(a, b, length, shards)

    def sort(x: pa.Table) -> pa.Table:
        return _sort_shard(x, length, array_bytes, 64)

    def merge(x: pa.Table) -> pa.Table:
        return _merge(x, length)

    def cut(a: pa.Table, b: pa.Table) -> pa.Table:
        return build(a, list(_cut(a, b)))

    counted = dealt.groupBy("_block").applyInArrow(count, _ddl(COUNTED))
    judged = counted.groupBy("_range").applyInArrow(judge, _ddl(JUDGED))
    sent = dealt.groupBy("_block").cogroup(judged.groupBy("_block")).applyInArrow(send, _ddl(FLOW))
    marked = sent.groupBy("_key").applyInArrow(sort, _ddl(FLOW))
    merged = marked.groupBy("_key").applyInArrow(merge, _ddl(JUDGED))
    return dealt.groupBy("_block").cogroup(merged.groupBy("_block")).applyInArrow(cut, schema)


def repeats(docs: DataFrame, length: int = LENGTH, array_bytes: int = ARRAY_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every document; ``spans`` are
    the byte ranges of the input text that strings of ``length`` bytes cover which also start
    elsewhere, in this or another document.

    Null texts are empty; texts shorter than ``length`` keep all; rows with null or repeated ids
    are documents of their own; an empty table gives no rows; other columns are ignored."""
    out = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("n_spans", pa.int64()),
            ("kept_sha256", pa.string()),
            ("spans", pa.list_(pa.list_(pa.int64()))),
        ]
    )

    def build(docs: pa.Table, cut: list) -> pa.Table:
        ids = docs.column("_row").combine_chunks().field("c0").to_pylist()
        rows = []
        for row, text, starts, ends in cut:
            kept = _kept(text, starts, ends)
            spans = [list(x) for x in zip(starts.tolist(), ends.tolist())]
            rows.append((ids[row], len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans))
        return _rows(out, rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    return _repeats(rows, length, array_bytes, block_bytes, build, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, array_bytes: int = ARRAY_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all repeated strings cut out of ``text``; columns and rows as given. Where a
    cut leaves part of a character, that part goes too. A null text stays null."""

    def build(docs: pa.Table, cut: list) -> pa.Table:
        texts = [_kept(text, starts, ends).decode("utf-8", "ignore") for _, text, starts, ends in cut]
        order = pa.array([row for row, *_ in cut], pa.int64())
        row = docs.column("_row").combine_chunks().take(order)
        fields = [row.field(i) for i in range(row.type.num_fields)]
        row = pa.StructArray.from_arrays(fields, [f.name for f in row.type])  # all fields nullable
        return pa.table({"_row": row, "_kept": pa.array(texts, pa.string())})

    others = [f for f in docs.schema if f.name != "text"]
    inner = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(others)]
    row = T.StructType([*inner, T.StructField("null", T.BooleanType())])
    schema = T.StructType([T.StructField("_row", row), T.StructField("_kept", T.StringType())])
    kept = _repeats(docs, length, array_bytes, block_bytes, build, schema)
    columns = {f.name: F.col("_row").getField(f"c{i}") for i, f in enumerate(others)}
    columns["text"] = F.when(~F.col("_row").getField("null"), F.col("_kept"))
    return kept.select(*(columns[c].alias(c) for c in docs.columns))
