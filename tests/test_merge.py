"""Channels merged by path, snapshots filled in."""

from __future__ import annotations

from patchwell.operators import merge
from patchwell.operators.diff import RANK_STEP
from patchwell.operators.merge import changed_files
from patchwell.plans.review import ReviewInputs, review_files, review_rows
from patchwell.sources.tables import REVIEWS
from tests.tables import added, raw_diffs, rows, section, snapshots

FILE = ("review_id", "path", "status", "additions", "deletions", "file_ord")


def test_merge_of_channels_and_snapshots(spark):
    staged = "\n".join(
        [
            section("both.ts", "@@ -1,2 +1,2 @@\n+x\n-y", header="new file mode 100644"),
            added("only.ts", "1", "2"),
        ]
    )
    unstaged = "\n".join(
        [
            added("new.ts", "1"),
            section("both.ts", "@@ -9 +9,2 @@\n+z\n+w"),
            section("new.ts", "@@ -9 +9 @@\n-z", header="rename from x"),
        ]
    )
    given = raw_diffs(spark, ("r", "staged", staged), ("r", "unstaged", unstaged))
    files = snapshots(
        spark,
        ("r", "both.ts", "ignored", "untracked"),
        ("r", "u.ts", "a\nb", "untracked"),
        ("r", "u.ts", "other", "staged_list"),
        ("r", "l.ts", "a", "staged_list"),
        ("s", "alone.ts", "", "staged_list"),
        ("s", "seen.ts", "a", "reviewed"),
    )
    assert rows(merge.changed_files(given, files), *FILE) == sorted(
        [
            ("r", "both.ts", "added", 3, 1, 0),
            ("r", "only.ts", "modified", 2, 0, 1),
            ("r", "new.ts", "modified", 1, 1, RANK_STEP),
            ("r", "u.ts", "added", 2, 0, 2 * RANK_STEP + 1),
            ("r", "l.ts", "added", 1, 0, 3 * RANK_STEP + 3),
            ("s", "alone.ts", "added", 1, 0, 3 * RANK_STEP + 4),
        ],
        key=repr,
    )


def test_last_staged_section_of_a_path_wins(spark):
    staged = "\n".join([added("a.ts", "1", "2", "3"), added("b.ts", "1"), added("a.ts", "9")])
    given = raw_diffs(spark, ("r", "staged", staged))
    files = merge.changed_files(given, snapshots(spark, ("x", "y", "z", "reviewed")))
    assert rows(files, *FILE) == [
        ("r", "a.ts", "modified", 1, 0, 0),
        ("r", "b.ts", "modified", 1, 0, 1),
    ]


def test_input_order_does_not_matter(spark):
    texts = [(f"r{i % 3}", c, added(f"f{i}.ts", *"ab"[: i % 3])) for i in range(3) for c in ("staged", "unstaged")]
    none = snapshots(spark, ("r0", "u.ts", "x", "untracked"))
    one = rows(merge.changed_files(raw_diffs(spark, *texts), none), *FILE)
    other = rows(merge.changed_files(raw_diffs(spark, *reversed(texts)).repartition(5), none), *FILE)
    assert one == other


def test_snapshots_that_could_not_be_read_are_no_change(spark):
    snaps = snapshots(spark, ("r", "a.ts", None, "untracked"), ("r", "b.ts", "x", "untracked"))
    raw = raw_diffs(spark, ("r", "staged", added("c.ts", "console.log(1)")))
    assert rows(changed_files(raw, snaps), "path", "additions") == [("b.ts", 1), ("c.ts", 1)]
    given = ReviewInputs(raw, snaps, spark.createDataFrame([], REVIEWS))
    assert rows(review_files(given), "path", "findings") == [("b.ts", 0), ("c.ts", 1)]
    # a review that is not listed keeps its findings
    assert rows(review_rows(given), "repo", "review_id", "warnings") == [("repo", "r", 1)]


def test_many_sections_with_repeats(spark):
    paths = [f"f{i % 300}.ts" for i in range(400)]
    text = "\n".join(added(p, "x") for p in paths)
    raw = raw_diffs(spark, ("r", "staged", text), ("s", "unstaged", text))
    got = {(r.review_id, r.path): (r.file_ord, r.additions) for r in changed_files(raw, snapshots(spark)).collect()}
    step = 1 << 40
    assert got == {
        **{("r", f"f{i}.ts"): (i, 1) for i in range(300)},
        **{("s", f"f{i}.ts"): (step + i, 2 if i < 100 else 1) for i in range(300)},
    }
