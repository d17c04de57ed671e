"""Diagnostics, proximity groups and proposed edits."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from patchwell.operators import locate
from patchwell.operators.findings import FINDING_COLUMNS
from patchwell.settings import ReviewSettings
from tests.tables import rows, snapshots
from tests.test_plans import physical

DEFAULT = {
    "review_id": "r",
    "path": "a.ts",
    "severity": "warning",
    "source": "static",
    "analyzer": "todos",
    "analyzer_ord": 0,
    "src_rank": 0,
    "src_ord": 0,
    "hunk_idx": 0,
    "pos": 0,
    "message": "m",
}
NUMBERS = ("src_rank", "src_ord", "hunk_idx", "pos", "line", "end_line", "analyzer_ord")


def findings(spark, *given):
    schema = ", ".join(f"{c} {'bigint' if c in NUMBERS else 'string'}" for c in FINDING_COLUMNS)
    filled = [{**DEFAULT, **g} for g in given]
    return spark.createDataFrame(
        [tuple(f.get(c) for c in FINDING_COLUMNS) for f in filled], schema
    )


def test_diagnostic_ranges_and_texts(spark):
    table = findings(
        spark,
        {"line": 3, "suggestion": "do it"},
        {"line": 0, "end_line": 5, "source": "ai", "analyzer": "ai-review", "suggestion": ""},
        {"line": 7, "end_line": 0},
    )
    assert rows(locate.diagnostics(table), "start_line", "end_line", "code", "message") == [
        (0, 4, "ai-review (AI)", "m"),
        (2, 2, "todos", "m\n💡 do it"),
        (6, 6, "todos", "m"),
    ]


def test_proximity_groups(spark):
    table = findings(
        spark,
        {"line": 1, "severity": "error"},
        {"line": 1, "severity": "error"},
        {"line": 6},
        {"line": 12, "severity": "info"},
        {"line": 1, "path": "b.ts"},
    )
    columns = ("path", "start_line", "end_line", "line_count", "errors", "warnings")
    assert rows(locate.proximity_groups(table), *columns) == [
        ("a.ts", 1, 6, 2, 2, 0),
        ("a.ts", 12, 12, 1, 0, 1),
        ("b.ts", 1, 1, 1, 0, 1),
    ]


def _plain_groups(given, gap):
    """Groups by walking each file's findings in order of lines."""
    out = []
    for path in sorted({g["path"] for g in given}):
        own = sorted((g for g in given if g["path"] == path and g["line"] is not None), key=lambda g: g["line"])
        groups = [[g] for g in given if g["path"] == path and g["line"] is None]
        placed = []
        for g in own:
            if placed and g["line"] - placed[-1][-1]["line"] <= gap:
                placed[-1].append(g)
            else:
                placed.append([g])
        for members in groups + placed:
            count = 1 if members[0]["line"] is None else len({m["line"] for m in members})
            errors = sum(m["severity"] == "error" for m in members)
            out.append((path, members[0]["line"], members[-1]["line"], count, errors, count - errors))
    return sorted(out, key=repr)


def test_groups_across_spans_of_every_size(spark):
    rng = random.Random(5)
    given = []
    for path in ("a", "b", "c", "d"):
        for bits in (0, 10, 11, 20, 21, 30, 31, 60):
            for at in (1, -1, 3):
                given += [{"line": at * (1 << bits) + rng.randint(-9, 9)} for _ in range(6)]
        given += [{"line": x} for x in range(1, 5000, 5 if path == "a" else 7)]
        given += [{"line": None}] * 3
        given = [{"path": path, "severity": rng.choice(["error", "info"]), **g} if "path" not in g else g for g in given]
    columns = ("path", "start_line", "end_line", "line_count", "errors", "warnings")
    table = findings(spark, *given)
    for gap in (0, 1, 5):
        got = rows(locate.proximity_groups(table, ReviewSettings(group_gap=gap)), *columns)
        assert got == _plain_groups(given, gap)


def test_no_window_over_a_file_and_one_read(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = physical(locate.proximity_groups(findings(spark, {"line": 1})))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Window" not in plan
    # the lines, three sizes of spans, the file; every other branch reuses one of them
    assert len(re.findall(r"\+- Exchange hashpartitioning\(", plan)) == 5, plan


def test_negative_warnings_are_kept(spark):
    table = findings(spark, {"line": 4, "severity": "error"}, {"line": 4, "severity": "error"})
    assert rows(locate.proximity_groups(table), "errors", "warnings") == [(2, -1)]


def test_first_finding_on_a_line_supplies_the_fix(spark):
    remove = {"fix_kind": "remove-line", "fix_label": "Remove"}
    table = findings(
        spark,
        {"line": 1, "analyzer_ord": 1, "rule": "a", **remove},
        {"line": 1, "analyzer_ord": 0, "rule": "b"},
        {"line": 2, "analyzer_ord": 0, "rule": "c", **remove},
        {"line": 2, "analyzer_ord": 3, "rule": "d"},
        {"line": 3, "rule": "e", "src_ord": 2, "fix_kind": "replace-line", "fix_label": "late"},
        {"line": 3, "rule": "f", "src_ord": 1, **remove},
        {"line": -4, "rule": "g"},
        {"line": 1, "path": "b.ts", "rule": "h", **remove},
        {"line": -2, "path": "b.ts", "rule": "i"},
    )
    offered = rows(locate.fix_candidates(table), "path", "line", "rule", "fix_label")
    assert offered == [
        ("a.ts", 2, "c", "Remove"),
        ("a.ts", 2, "d", "Remove"),
        ("a.ts", 3, "e", "Remove"),
        ("a.ts", 3, "f", "Remove"),
        ("b.ts", 1, "h", "Remove"),
        ("b.ts", 1, "i", "Remove"),
    ]


def test_edits(spark):
    digest = hashlib.sha256(b"value").hexdigest()
    moved = {"fix_kind": "move-to-env", "fix_label": "Move", "fix_env_key": "KEY"}
    table = findings(
        spark,
        {"line": 1, "fix_kind": "remove-line", "fix_label": "Remove"},
        {"line": 2, "fix_kind": "replace-line", "fix_text": "new", "fix_label": "Replace"},
        {"line": 3, "fix_kind": "replace-line", "fix_label": "Nothing to put there"},
        {"line": 4, **moved, "redacted_text": "x = process.env.KEY", "secret_sha256": digest},
        {"line": 5, **moved},
        {"line": 6, "fix_kind": "move-to-env", "fix_label": "No key"},
    )
    candidates = locate.fix_candidates(table)
    edits = rows(locate.fix_edits(candidates), "edit", "from_line", "to_line", "new_text", "env_key")
    assert edits == [
        ("delete", 0, 1, None, None),
        ("move-to-env", 3, 3, None, "KEY"),
        ("move-to-env", 4, 4, None, "KEY"),
        ("replace", 1, 1, "new", None),
    ]
    assert rows(locate.redacted_lines(candidates), "line", "new_text") == [
        (4, "x = process.env.KEY")
    ]
    entries = locate.env_entries(candidates)
    assert rows(entries, "line", "entry") == [(4, f"KEY=sha256:{digest}")]

    ignores = snapshots(
        spark,
        ("r", ".gitignore", "dist", "reviewed"),
        ("r", "sub/.gitignore", "dist", "reviewed"),
        ("s", ".gitignore", "dist", "reviewed"),
    )
    assert rows(locate.ignore_updates(entries, ignores), "review_id", "path", "appended") == [
        ("r", ".gitignore", "\n.env\n")
    ]
    listed = ignores.withColumn("content", F.lit("x/.env.local"))
    assert locate.ignore_updates(entries, listed).count() == 0
