"""The trie of conversation prefixes, its sums rolled up band by band.

A node is a prefix that conversations share. Its key is the exclusive or of 120-bit hashes of its
turns, each bound to its place, so keys are running totals and need no walk along a conversation.
Depths are cut into bands of a fixed height. A node explodes to its ancestors inside its band
alone; what a band's roots total goes on as a smaller trie of band roots, rolled up in the same
way, and comes back to the nodes that the bands hang from. A conversation of n turns takes
log(n) rounds, and no node explodes to more than a band's height.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchwell.llm.common import written
from patchwell.operators.ordered import Running, running

#: Depths of a band, and so the most ancestors that a node explodes to.
HEIGHT = 16
#: A rebuilt conversation takes up to this many turns from the one it is made after.
HEAD = 8
#: The conversations of one family are made after its first.
FAMILY = 5
#: Ids that are joined to one text before a node's digest is taken.
CHUNK_IDS = 4096


class _Xor(Running):
    """A running exclusive or."""

    def total(self, value: Column) -> Column:
        return F.bit_xor(value)

    def combine(self, *parts: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        return reduce(lambda a, b: a.bitwiseXOR(b), [F.coalesce(p, zero) for p in parts])


def _key(one: Column, two: Column) -> Column:
    return F.named_struct(F.lit("one"), one, F.lit("two"), two)


def _root() -> Column:
    return _key(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))


def turns_in_order(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, said, bytes``: turns numbered from 1 in each conversation.

    Texts stay where they are read; ``said`` is a digest of role and text. Rows are dealt by
    ranges of (conversation, turn), so a long conversation spreads over tasks, and are numbered
    within their range; the counts of earlier ranges are added. Null turns come first, turns of
    one number go by their digests, repeated rows are turns of their own."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("said"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    ranged = turns.repartitionByRange("conv_id", "turn", "said", "row")
    dealt = written(ranged.withColumn("part", F.spark_partition_id()), "turns")
    within = Window.partitionBy("part", "conv_id").orderBy("turn", "said", "row")
    local = dealt.withColumn("_local", F.row_number().over(within))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part", "conv_id").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = local.join(before, ["part", "conv_id"])
    return numbered.select("conv_id", (F.col("_before") + F.col("_local")).alias("pos"), "said", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and ``conv_id, n_turns`` of each of these.

    Conversation c takes the first h turns of c - c % 5 (``%`` as in SQL), h being crc32(c) % 9,
    and goes on with its own turns after its first h."""
    conv = F.col("conv_id")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = lengths.withColumns({"h": F.crc32(conv.cast("string")) % (HEAD + 1), "family": conv - conv % FAMILY})
    first = F.sort_array(F.collect_list(F.struct("pos", "said", "bytes")))
    heads = turns.where(F.col("pos") <= HEAD).groupBy(conv.alias("family")).agg(first.alias("head"))
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array())
    given = convs.join(heads, "family", "left").select("conv_id", "n", "h", taken.alias("taken"))
    given = written(given, "given")
    start = given.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.pos", "t.said", "t.bytes")
    moved = F.col("pos") - F.col("h") + F.size("taken")
    own = turns.join(given, "conv_id").where("pos > h").select("conv_id", moved.alias("pos"), "said", "bytes")
    n_turns = F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return start.union(own), given.select("conv_id", n_turns.cast("long").alias("n_turns"))


def _blocks(turns: DataFrame, height: int) -> DataFrame:
    """``conv_id, band, start, keys, bytes``: a conversation's nodes in a band, topmost first, and
    the key of the node above them."""
    part = lambda at: F.conv(F.substring("_md5", at, 15), 16, 10).cast("bigint")
    bound = turns.withColumn("_md5", F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("said"))))
    bound = bound.select(
        "conv_id",
        F.floor((F.col("pos") - 1) / height).alias("band"),
        F.struct("pos", part(1).alias("one"), part(16).alias("two"), "bytes").alias("turn"),
    )
    grouped = bound.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    grouped = written(grouped, "grouped")

    def xor(turns: Column, name: str, start: Column) -> Column:
        return F.aggregate(turns, start, lambda a, t: a.bitwiseXOR(t[name]))

    zero = F.lit(0).cast("bigint")
    sums = grouped.select("conv_id", "band", *[xor(F.col("turns"), c, zero).alias(f"x_{c}") for c in ("one", "two")])
    totals = [_Xor(f"s_{c}", F.col(f"x_{c}"), inclusive=False) for c in ("one", "two")]
    starts = running(sums, ["conv_id"], F.col("band"), [], totals, (8, 16)).drop("x_one", "x_two")
    upto = lambda i, c: xor(F.slice("turns", F.lit(1), i), c, F.col(f"s_{c}"))
    keys = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda i: _key(upto(i, "one"), upto(i, "two")))
    joined = grouped.join(starts, ["conv_id", "band"])
    start = _key(F.col("s_one"), F.col("s_two")).alias("start")
    return written(joined.select("conv_id", "band", start, keys.alias("keys"), F.col("turns.bytes").alias("bytes")), "blocks")


def _nodes(blocks: DataFrame, given: DataFrame, height: int) -> DataFrame:
    """Every node once, the root included, with the number of its children."""
    at = blocks.select("*", F.explode(F.sequence(F.lit(1), F.size("keys"))).alias("i"))
    entries = at.select(
        "conv_id",
        (F.col("band") * height + F.col("i")).alias("depth"),
        F.slice("keys", F.lit(1), F.col("i")).alias("path"),
        "start",
        F.element_at("bytes", F.col("i")).alias("bytes"),
    )
    members = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")]
    nodes = entries.groupBy("depth", "path", "start", "bytes").agg(*members)
    above = F.when(F.size("path") > 1, F.element_at("path", -2)).otherwise(F.col("start"))
    nodes = nodes.select(
        "conv_id", "depth", "n_convs", "path", F.element_at("path", -1).alias("key"), above.alias("parent"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("cost"),
    )
    nothing = F.lit(0).cast("bigint")
    root = given.agg(*members).where("n_convs > 0").select(
        "conv_id", nothing.alias("depth"), "n_convs", F.array(_root()).alias("path"), _root().alias("key"),
        F.lit(None).cast(nodes.schema["parent"].dataType).alias("parent"), nothing.alias("cost"),
    )
    nodes = written(nodes.union(root), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    joined = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return written(joined.withColumn("leaves", (F.col("n_children") == 0).cast("bigint")), "family")


def _levels(blocks: DataFrame, height: int) -> list[DataFrame]:
    """Paths of band roots among band roots: level 1 are the roots of all bands, level 2 the roots
    of bands of these, and so on until one band is left. Level 0 is not in the list."""
    level = blocks.select("conv_id", F.col("band").alias("place"), F.col("keys")[0].alias("key"))
    levels = []
    last = blocks.agg(F.max("band")).first()[0] or 0
    while last > 0:
        band = F.floor(F.col("place") / height).alias("place")
        along = F.transform(F.sort_array(F.collect_list(F.struct("place", "key"))), lambda x: x["key"])
        grouped = written(level.groupBy("conv_id", band).agg(along.alias("keys")), "bands")
        upto = F.slice("keys", F.lit(1), F.col("i")).alias("path")
        paths = grouped.select("*", F.explode(F.sequence(F.lit(1), F.size("keys"))).alias("i")).select(upto).distinct()
        levels.append(written(paths.withColumn("key", F.element_at("path", -1)), "level"))
        level = grouped.select("conv_id", "place", F.col("keys")[0].alias("key"))
        last //= height
    return levels


_SUMS = ("leaves", "cost")


def _summed(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("key")).agg(*[F.sum(c).cast("bigint").alias(c) for c in _SUMS])


def _within_bands(values: DataFrame) -> DataFrame:
    """Sums over the part of each node's subtree that lies in its band."""
    return _summed(values.select(F.explode("path").alias("_above"), *_SUMS), F.col("_above"))


def subtree_sums(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``key, leaves, cost`` over whole subtrees for all nodes but the root.

    ``nodes`` have ``key, path, parent, leaves, cost``; a path holds the keys of a node's band from
    the band's root down to the node. ``levels`` are as :func:`_levels` leaves them."""
    values = [nodes.select("key", "path", *_SUMS)]
    hung = nodes.where(F.size("path") == 1).select("key", "parent").where(F.col("parent") != _root())
    hooks = [hung]  # where the bands of each level hang
    for paths in levels:
        if len(values) > 1:
            tops = values[-2].select(F.col("key").alias("parent"), F.col("path")[0].alias("_top"))
            above = hooks[-1].join(paths.select("key"), "key", "left_semi").join(tops, "parent")
            hooks.append(written(above.select("key", F.col("_top").alias("parent")), "hooks"))
        own = _summed(values[-1], F.col("path")[0])
        values.append(written(paths.join(own, "key").select("key", "path", *_SUMS), "values"))
    totals = _within_bands(values[-1])
    for rows, hook in zip(reversed(values[:-1]), reversed(hooks)):
        hanging = _summed(totals.join(hook, "key"), F.col("parent"))
        added = hanging.select("key", *[F.col(c).alias(f"_{c}") for c in _SUMS])
        more = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in _SUMS]
        totals = written(_within_bands(rows.join(added, "key", "left").select("path", *more)), "totals")
    return totals


def _chunks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Ids of sorted rows as texts of ``size`` ids at most, one node each."""
    node: tuple | None = None
    ids: list[int] = []
    done: list[tuple] = []

    def close() -> None:
        if ids:
            done.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def out() -> pa.RecordBatch:
        columns = list(zip(*done)) or [(), (), (), ()]
        done.clear()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["one", "two", "first", "ids"])

    for batch in batches:
        for one, two, conv in zip(*(batch.column(c).to_pylist() for c in ("one", "two", "conv_id"))):
            if (one, two) != node or len(ids) >= size:
                close()
                node = one, two
            ids.append(conv)
        if done:
            yield out()
    close()
    if done:
        yield out()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks in their order; one running digest."""
    node: tuple | None = None
    running_digest = hashlib.sha256()
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done))
        done.clear()
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["one", "two", "digest"])

    for batch in batches:
        for one, two, ids in zip(*(batch.column(c).to_pylist() for c in ("one", "two", "ids"))):
            if (one, two) == node:
                running_digest.update(b",")
            else:
                if node is not None:
                    done.append((*node, running_digest.hexdigest()))
                node, running_digest = (one, two), hashlib.sha256()
            running_digest.update(ids.encode())
        if done:
            yield out()
    if node is not None:
        done.append((*node, running_digest.hexdigest()))
        yield out()


def _ends(blocks: DataFrame, given: DataFrame, chunk_ids: int) -> DataFrame:
    """``key, ends_sha256`` of nodes at which conversations end. Ids are joined in ranges, so that
    a node at which very many end costs one task no more than its texts' digest."""
    last = F.max_by(F.element_at("keys", -1), "band").alias("key")
    ends = blocks.groupBy("conv_id").agg(last).select("conv_id", "key.one", "key.two")
    zero = F.lit(0).cast("bigint")
    ends = ends.union(given.where("n_turns = 0").select("conv_id", zero.alias("one"), zero.alias("two")))
    order = ["one", "two", "conv_id"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = written(chunks.mapInArrow(lambda batches: _chunks(batches, chunk_ids), "one long, two long, first long, ids string"), "ids")
    dealt = chunks.repartition("one", "two").sortWithinPartitions("one", "two", "first")
    found = dealt.mapInArrow(_digests, "one long, two long, digest string")
    return found.select(_key(F.col("one"), F.col("two")).alias("key"), F.col("digest").alias("ends_sha256"))


def prefix_trie(rows: DataFrame, height: int = HEIGHT, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """A row for every node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    ``rows`` have ``conv_id, turn, role, text``; other columns are ignored. Null roles and texts
    are empty, null turns come first, turns of one number go by a digest of role and text,
    repeated rows are turns of their own, rows without a ``conv_id`` belong to no conversation.
    An empty table has no conversation and so no nodes. Keys are compared by 120 bits, never by
    texts, which stay in the scan."""
    turns, given = rebuilt(written(turns_in_order(rows), "numbered"))
    blocks = _blocks(turns, height)
    nodes = _nodes(blocks, given, height)
    below = nodes.where("depth > 0")
    totals = subtree_sums(below, _levels(blocks, height))
    whole = nodes.agg(*[F.sum(c).cast("bigint").alias(c) for c in _SUMS]).select(_root().alias("key"), *_SUMS)
    totals = totals.union(whole).select("key", F.col("leaves").alias("n_leaves"), F.col("cost").alias("saved_tokens"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(totals, "key").join(_ends(blocks, given, chunk_ids), "key", "left").join(parents, "parent", "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
