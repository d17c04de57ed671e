"""The trie of conversation prefixes against a plain walk."""

from __future__ import annotations

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from patchwell.llm import prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def plain(rows: list[tuple]) -> list[tuple]:
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    said = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    made = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = said.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for path, own in members.items():
        under = [p for p in members if p[: len(path)] == path]
        leaf = [p for p in under if not any(q[:-1] == p and q for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        children = sum(1 for p in under if len(p) == len(path) + 1)
        ends = ",".join(map(str, sorted(c for c in own if len(made[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(own), len(path), parent, len(own), children, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, height=prefix_trie.HEIGHT, chunk_ids=prefix_trie.CHUNK_IDS) -> list[tuple]:
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, height, chunk_ids).collect()), key=repr)


def family(n: int, lengths: int) -> list[tuple]:
    """Conversations of many lengths that share their first turns."""
    rows = []
    for c in range(n):
        for t in range((c * 7) % lengths):
            text = f"turn {t}" if t < 9 or c % 3 else f"turn {t} of {c % 4}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    return rows


@pytest.mark.parametrize("height", [2, 3, 16])
def test_equals_plain_walk(frame, height):
    rows = family(40, 23)
    assert found(frame(rows, CONVERSATIONS), height) == plain(rows)


def test_odd_rows(frame):
    rows = [
        (0, None, None, None), (0, 0, "user", "é" * 50), (0, 0, "user", "b"), (0, 0, "user", "b"), (0, 1, "assistant", ""),
        (1, 5, "user", "b"), (1, None, "user", None), (None, 0, "user", "nobody"), (-3, 0, "user", "minus"), (-1, 1, None, "x"),
        (7, 0, "user", "long " * 50_000), (8, 0, "user", "long " * 50_000), (103, 0, "user", "one turn"),
    ]
    df = frame(rows, CONVERSATIONS)
    assert found(df, 2) == plain(rows)
    clash = {c: F.lit("x") for c in ("pos", "key", "path", "depth", "n_convs", "part", "said", "band", "_n", "a-b")}
    assert found(df.withColumns(clash), 2) == plain(rows)


def test_empty_and_turnless(frame):
    assert found(frame([], CONVERSATIONS)) == []
    alone = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1][:3]
    rows = [(c, 0, "user", "only turn") for c in alone]  # their families' first are absent
    assert found(frame(rows, CONVERSATIONS)) == plain(rows)
    assert len(plain(rows)) == 1


def test_one_long_conversation_and_many_copies(frame):
    rows = [(50, t, "user", f"t{t}") for t in range(300)]
    rows += [(c, t, "user", "same") for c in range(1000, 1300) for t in range(2)]
    assert found(frame(rows, CONVERSATIONS), 4) == plain(rows)


def test_whole_table(spark, frame):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_ids_of_a_crowded_node_are_joined_in_chunks(frame):
    rows = [(c, 0, "user", "same") for c in range(0, 500, 5)]
    assert found(frame(rows, CONVERSATIONS), chunk_ids=3) == plain(rows)
