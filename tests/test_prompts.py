"""Prompts and answers of a language model."""

from __future__ import annotations

import pytest

from patchwell.operators import merge, prompts
from patchwell.sources.tables import RESPONSES
from tests.tables import raw_diffs, rows, section, snapshots


def test_prompt_of_a_file(spark):
    text = section("a.ts", "@@ -7,3 +7,3 @@\n x7\n-old\n+x8\n x9", "@@ -30 +30 @@\n+far")
    given = raw_diffs(spark, ("r", "staged", text), ("r", "unstaged", section("a.ts", "@@ -1 +1 @@\n+x1")))
    extra = snapshots(spark, ("r", "u.ts", "u1\nu2", "untracked"), ("r", "e.ts", "", "untracked"))
    contents = snapshots(
        spark,
        ("r", "a.ts", "\n".join(f"x{i}" for i in range(1, 16)), "reviewed"),
        ("r", "u.ts", "u1\nu2", "reviewed"),
        ("r", "e.ts", "", "reviewed"),
    )
    files = merge.changed_files(given, extra)
    hunks = prompts.review_hunks(given, extra)
    got = {r.path: r.prompt for r in prompts.review_prompts(files, hunks, contents).collect()}
    assert set(got) == {"a.ts", "u.ts"}
    first = "\n".join(f"{'>>>' if i in (1, 8) else '   '} {i}: x{i}" for i in range(2, 16))
    last = "\n".join(f"{'>>>' if i in (1, 8) else '   '} {i}: x{i}" for i in range(1, 8))
    assert (
        "CHANGES (+ = added, - = removed):\n- (removed): old\n+ L8: x8\n+ L30: far\n+ L1: x1\n\n"
        in got["a.ts"]
    )
    assert f"marks changed lines):\n{first}\n---\n\n---\n{last}\n\nRespond" in got["a.ts"]
    assert got["u.ts"].startswith('You are a code reviewer. Review the following changes in "u.ts"')
    assert "STATUS: added\nADDITIONS: 2 lines\nDELETIONS: 0 lines\n" in got["u.ts"]
    assert ">>> 1: u1\n>>> 2: u2\n\nRespond" in got["u.ts"]


ITEM = '{"line": 4, "severity": "error", "message": "m"}'
ANSWERS = [
    (f"[{ITEM}]", [(4, "error", "m", None)]),
    (f"Here:\n[{ITEM},\n {ITEM}]\nDone.", [(4, "error", "m", None)] * 2),
    ("[]", []),
    ("no array", []),
    (f"[{ITEM}", []),
    (f"[{ITEM}, broken]", []),
    (f"[{ITEM}] and [1]", []),
    (f"[{ITEM}] trailing ]", []),
    (f"[{ITEM}]]", []),
    (f"[{ITEM}]}} ]", []),
    (f'[{ITEM}], "x": [1]', []),
    (f"[{ITEM}], [1]", []),
    (f"[{ITEM}, null]", []),
    (f'["{{}}", [2], {ITEM}, true]', [(4, "error", "m", None)]),
    (f"[1, {ITEM}]", [(4, "error", "m", None)]),
    ("[{'line': 4, 'severity': 'error', 'message': 'm'}]", []),
    ('[{"line": 0, "severity": "error", "message": "m"}]', []),
    ('[{"line": 3, "severity": "", "message": "m"}]', []),
    ('[{"line": 3, "severity": "error"}]', []),
    ('[{"line": "7", "severity": "note", "message": "m", "suggestion": "s"}]', [(7, "note", "m", "s")]),
    ('[{"line": 1.5, "severity": "error", "message": "m"}]', [(None, "error", "m", None)]),
    ('[{"line": 1e1, "severity": "error", "message": "m"}]', [(10, "error", "m", None)]),
    ('[{"line": "12-14", "severity": "error", "message": "m"}]', [(None, "error", "m", None)]),
    ('[{"line": 1, "line": 4, "severity": "error", "message": "m"}]', [(4, "error", "m", None)]),
    ('[{"line": 4, "severity": false, "message": "m"}]', []),
    ('[{"line": 4, "severity": "error", "message": 0}]', []),
    ('[{"line": false, "severity": "error", "message": "m"}]', []),
    ('[{"line": 4, "severity": 2, "message": {"a": 1}}]', [(4, "2", '{"a":1}', None)]),
    ('[{"line": 2, "severity": "info", "message": "a [b] c", "other": {"x": [1]}}]', [(2, "info", "a [b] c", None)]),
]


def test_answers(spark):
    table = spark.createDataFrame(
        [(str(i), "a.ts", text) for i, (text, _) in enumerate(ANSWERS)], RESPONSES
    )
    found = prompts.assistant_findings(table)
    got = {i: [] for i in range(len(ANSWERS))}
    for r in found.orderBy("review_id", "pos").collect():
        got[int(r.review_id)].append((r.line, r.severity, r.message, r.suggestion))
    for i, (text, expected) in enumerate(ANSWERS):
        assert got[i] == expected, text


@pytest.mark.parametrize("size", [300])
def test_numbers_in_long_snapshots_and_hunks(spark, size):
    text = section("a.ts", "@@ -1 +5,9 @@\n" + "\n".join(["+a", "-b", " c"] * size))
    hunks = prompts.review_hunks(
        raw_diffs(spark, ("r", "staged", text)), snapshots(spark, ("s", "b.ts", "x", "untracked"))
    )
    numbers = {r.path: r.added_numbers for r in hunks.collect()}
    assert numbers == {"a.ts": [5 + 2 * i for i in range(size)], "b.ts": [1]}
    assert rows(hunks, "path", "new_start") == [("a.ts", 5), ("b.ts", 1)]
