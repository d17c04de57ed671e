"""Diff texts to sections, files, hunks and numbered lines."""

from __future__ import annotations

from patchwell.operators import diff
from tests.tables import raw_diffs, rows, section, snapshots

SAMPLE = "\n".join(
    [
        "@@ -10,6 +10,5 @@ def f():",
        " context",
        "-removed one",
        "-removed two",
        "+added",
        " context",
    ]
)


def lines_of(spark, *texts):
    given = raw_diffs(spark, *[(f"r{i}", "staged", t) for i, t in enumerate(texts)])
    return diff.diff_lines(diff.diff_hunks(diff.file_sections(given)))


def numbered(df, review="r0"):
    found = df.filter(df.review_id == review).orderBy("src_ord", "hunk_idx", "pos").collect()
    return [(r.line_number, r.line_type, r.content) for r in found]


def test_numbers_belong_to_the_new_file(spark):
    assert numbered(lines_of(spark, section("a.ts", SAMPLE))) == [
        (10, "context", "context"),
        (11, "removed", "removed one"),
        (11, "removed", "removed two"),
        (11, "added", "added"),
        (12, "context", "context"),
    ]


def test_lines_that_are_skipped_or_empty(spark):
    hunk = "\n".join(
        ["@@ -1 +1,3 @@", "-old", "\\ No newline at end of file", "+new", "", "odd line", "+last"]
    )
    assert numbered(lines_of(spark, section("a.ts", hunk))) == [
        (1, "removed", "old"),
        (1, "added", "new"),
        (2, "context", ""),
        (3, "added", "last"),
    ]


def test_carriage_returns_do_not_split_lines(spark):
    hunk = "@@ -1 +1,2 @@\n+one\rstill one\n+two\u2028still two"
    assert numbered(lines_of(spark, section("a.ts", hunk))) == [
        (1, "added", "one\rstill one"),
        (2, "added", "two\u2028still two"),
    ]


def test_numbers_across_blocks_of_a_long_hunk(spark):
    kinds = "+- +\\-+ "
    body = [kinds[(i * 7 + i // 5) % len(kinds)] + str(i) for i in range(3 * diff.BLOCK + 17)]
    number, expected = 5, []
    for x in body:
        kind = {"+": "added", "-": "removed", " ": "context"}.get(x[0])
        if kind:
            expected.append((number, kind, x[1:]))
            number += kind != "removed"
    hunk = "@@ -5,9 +5,9 @@\n" + "\n".join(body)
    assert numbered(lines_of(spark, section("a.ts", hunk))) == expected


def test_hunk_headers(spark):
    text = section("a.ts", "@@ -1 +1 @@\n+x", "@@ -3,0 +0,0 @@ f()\n-y", "@@ no header\n+z")
    hunks = diff.diff_hunks(diff.file_sections(raw_diffs(spark, ("r", "staged", text))))
    assert rows(hunks, "hunk_idx", "old_start", "old_count", "new_start", "new_count") == [
        (0, 1, 1, 1, 1),
        (1, 3, 0, 0, 0),
    ]


def test_paths_and_statuses(spark):
    cases = {
        "plain": section("dir/a.ts", SAMPLE),
        "new": section("b.ts", SAMPLE, header="new file mode 100644"),
        "deleted": section(
            "x.ts", "@@ -1 +0,0 @@\n-x", header="deleted file mode 100644", new_side="+++ /dev/null"
        ),
        "renamed": "diff --git a/old.ts b/new.ts\nsimilarity index 100%\nrename from old.ts\nrename to new.ts",
        "copied": "diff --git a/o.ts b/c.ts\ncopy from o.ts\ncopy to c.ts",
        "first header": section("f.ts", SAMPLE, header="rename from e.ts\nnew file mode 100644"),
        "binary": "diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ",
        "quoted": 'diff --git "a/q\\303.ts" "b/q\\303.ts"\n--- "a/q\\303.ts"\n+++ "b/q\\303.ts"\n@@ -1 +1 @@\n+x',
        "tab": section("with space.ts\t", SAMPLE),
        "empty path": "diff --git a/e.ts b/e.ts\n+++ b/\n@@ -1 +1 @@\n+x",
        "no old side": "diff --git a/n.ts b/n.ts\n+++ /dev/null\n+++ b/later.ts\n@@ -1 +1 @@\n+x",
        "crlf": "diff --git a/w.ts b/w.ts\r\nold mode 100644\r\nnew mode 100755",
        "words in lines": section("g.ts", "@@ -1 +1,2 @@\n+Binary files\n+new file mode"),
    }
    given = raw_diffs(spark, *[(name, "staged", text) for name, text in cases.items()])
    found = {r.review_id: (r.path, r.status) for r in diff.file_sections(given).collect()}
    assert found == {
        "plain": ("dir/a.ts", "modified"),
        "new": ("b.ts", "added"),
        "deleted": ("x.ts", "deleted"),
        "renamed": ("new.ts", "renamed"),
        "copied": ("c.ts", "modified"),
        "first header": ("f.ts", "renamed"),
        "tab": ("with space.ts\t", "modified"),
        "no old side": ("later.ts", "modified"),
        "crlf": ("w.ts", "modified"),
        "words in lines": ("g.ts", "modified"),
    }


def test_text_before_the_first_section(spark):
    given = raw_diffs(
        spark,
        ("plain", "staged", "warning: something\n" + section("a.ts", SAMPLE)),
        ("path", "staged", "+++ b/lost.ts\n" + section("a.ts", SAMPLE)),
        ("blank", "staged", " \n\u00a0"),
    )
    found = diff.file_sections(given)
    assert rows(found, "review_id", "path", "section_seq") == [
        ("path", "a.ts", 1),
        ("path", "lost.ts", 0),
        ("plain", "a.ts", 1),
    ]


def test_trim_of_the_whole_text_only(spark):
    text = section("a.ts", "@@ -1,2 +1,3 @@\n+x\n ") + "\n" + section("b.ts", "@@ -1 +1,2 @@\n+y\n \n")
    assert numbered(lines_of(spark, "\n" + text)) == [
        (1, "added", "x"),
        (2, "context", ""),
        (1, "added", "y"),
    ]


def test_counts_equal_exploded_lines(spark):
    text = section("a.ts", SAMPLE, "@@ -30 +29,2 @@\n++\n+-\n--\n") + "\n" + section("b.ts")
    sections = diff.file_sections(raw_diffs(spark, ("r", "staged", text)))
    assert rows(diff.section_rows(sections), "path", "additions", "deletions") == [
        ("a.ts", 3, 3),
        ("b.ts", 0, 0),
    ]


def test_repeated_paths_within_a_diff(spark):
    one, two, other = (
        section("a.ts", f"@@ -1 +{n} @@\n+{n}") for n in (1, 2, 3)
    )
    text = "\n".join([one, other.replace("a.ts", "b.ts"), two])
    given = raw_diffs(spark, ("r", "staged", text), ("r", "unstaged", text))
    found = diff.file_sections(given)
    step = diff.RANK_STEP
    assert rows(found, "src_rank", "path", "section_seq", "first_ord") == [
        (0, "a.ts", 2, 0),
        (0, "b.ts", 1, 1),
        (1, "a.ts", 0, step),
        (1, "a.ts", 2, step),
        (1, "b.ts", 1, step + 1),
    ]


def test_snapshot_is_one_added_hunk(spark):
    hunks = diff.snapshot_hunks(snapshots(spark, ("r", "a.ts", "x\ny\n", "untracked")))
    assert rows(hunks, "old_start", "old_count", "new_start", "new_count") == [(0, 0, 1, 3)]
    lines = diff.snapshot_lines(hunks)
    assert rows(lines, "line_number", "line_type", "content") == [
        (1, "added", "x"),
        (2, "added", "y"),
        (3, "added", ""),
    ]
