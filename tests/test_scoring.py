"""Risk, scores, reports and whole review jobs."""

from __future__ import annotations

import datetime

from patchwell.functions import fixed_values as fv
from patchwell.operators import history, report, scoring
from patchwell.operators.findings import number_findings
from patchwell.plans.review import ReviewInputs, review_files, review_findings, review_rows, run_review
from patchwell.settings import ReviewSettings
from patchwell.sources.tables import RESPONSES, REVIEWS
from tests.tables import added, raw_diffs, rows, section, snapshots

TALLIED = (
    "review_id string, path string, additions bigint, deletions bigint, errors bigint,"
    " warnings bigint, infos bigint, findings bigint, file_ord bigint"
)
DAY = datetime.datetime(2024, 1, 2, 3, 4)


def reviews(spark, *ids):
    return spark.createDataFrame([("repo", i, DAY) for i in ids], REVIEWS)


def test_risk_conditions_in_order(spark):
    cases = {
        ("a.md", 1, 0, 1, 0, 0): "high",
        ("src/auth/a.md", 0, 0, 0, 0, 0): "high",
        ("src/LOGIN-page/a.json", 0, 0, 0, 0, 0): "high",
        ("src/authz/a.md", 0, 0, 0, 0, 0): "low",
        ("src/auth_x/a.md", 0, 0, 0, 0, 0): "low",
        ("src/éauth/a.md", 0, 0, 0, 0, 0): "high",
        ("b.md", 1, 0, 0, 1, 0): "medium",
        ("c.json", 60, 40, 0, 0, 0): "info",
        ("d.json", 60, 41, 0, 0, 0): "medium",
        ("e.json", 1, 0, 0, 0, 1): "low",
        ("tsconfig.json", 10, 0, 0, 0, 0): "info",
        ("f.YML", 1, 0, 0, 0, 0): "low",
        ("yarn.lock", 1, 0, 0, 0, 0): "info",
    }
    table = spark.createDataFrame(
        [("r", p, a, d, e, w, i, e + w + i, n) for n, (p, a, d, e, w, i) in enumerate(cases)],
        TALLIED,
    )
    got = {r.path: r.risk for r in scoring.file_risk(table).collect()}
    assert got == {k[0]: v for k, v in cases.items()}


def test_scores_are_clamped_and_empty_reviews_are_clean(spark):
    def row(review, errors, warnings, infos, other=0):
        total = errors + warnings + infos + other
        return (review, f"{review}.ts", 1, 2, errors, warnings, infos, total, 0)

    table = spark.createDataFrame(
        [row("seven", 7, 0, 0), row("some", 1, 2, 3), row("other", 0, 0, 0, other=4)], TALLIED
    )
    got = scoring.review_rollup(table, reviews(spark, "seven", "some", "other", "none"))
    assert rows(got, "review_id", "score", "total_issues", "file_count", "additions") == [
        ("none", 100, 0, 0, 0),
        ("other", 100, 4, 1, 1),
        ("seven", 0, 7, 1, 1),
        ("some", 72, 6, 1, 1),
    ]


def test_bands(spark):
    table = spark.createDataFrame([(s,) for s in (100, 80, 79, 50, 49, 0)], "score bigint")
    got = table.withColumn("band", scoring.score_band(table.score)).collect()
    assert [r.band for r in got] == ["good", "good", "warn", "warn", "bad", "bad"]


def job(spark):
    staged = "\n".join(
        [
            added("b.ts", "debugger", "// TODO later"),
            section("m.json", "@@ -1 +1 @@\n-x\n+y"),
            "diff --git a/o.ts b/n.ts\nrename from o.ts\nrename to n.ts",
            section("d.ts", "@@ -1 +0,0 @@\n-x", header="deleted file mode 1", new_side="+++ /dev/null"),
        ]
    )
    unstaged = "\n".join([added("b.ts", "console.log(1)", start=9), added("z.py", "print(1)")])
    answers = spark.createDataFrame(
        [
            ("r", "m.json", '[{"line": 3, "severity": "note", "message": "hm"}]'),
            ("r", "b.ts", '[{"line": 1, "severity": "error", "message": "bad", "suggestion": "s"}]'),
            ("r", "gone.ts", '[{"line": 1, "severity": "error", "message": "no such file"}]'),
            ("r", "z.py", '[{"line": 1, "severity": "error", "message": "has no content"}]'),
        ],
        RESPONSES,
    )
    contents = snapshots(
        spark,
        *[("r", p, "text", "reviewed") for p in ("m.json", "b.ts", "gone.ts")],
        ("r", "z.py", "", "reviewed"),
    )
    return ReviewInputs(
        raw_diffs(spark, ("r", "staged", staged), ("r", "unstaged", unstaged)),
        snapshots(spark, ("r", "u.sh", "x", "untracked")),
        reviews(spark, "r", "empty"),
        answers,
        contents,
    )


REPORT = """## What Changed

### New Files (1)
- `u.sh` (+1 lines)

### Modified Files (3)
- `b.ts` (+3, -0)
- `m.json` (+1, -1)
- `z.py` (+1, -0)

### Deleted Files (1)
- `d.ts`

### Renamed Files (1)
- `n.ts`

## Summary

- **Files changed:** 6
- **Lines added:** 6
- **Lines removed:** 2

## Notes

The following items were flagged during pre-push review:

- 🟡 `b.ts:9` — console.log left in code
- 🔴 `b.ts:1` — debugger statement left in code
- 🔵 `b.ts:2` — TODO comment: later
- 🔴 `b.ts:1` — bad
- 🔵 `m.json:3` — hm
- 🟡 `z.py:1` — print() statement left in code"""


def test_ids_positions_and_counts(spark):
    given = job(spark)
    numbered = number_findings(review_findings(given))
    assert rows(numbered, "finding_id", "path") == [
        ("ai-1", "b.ts"),
        ("ai-2", "m.json"),
        ("console-log-1", "b.ts"),
        ("console-log-4", "z.py"),
        ("debugger-2", "b.ts"),
        ("todos-3", "b.ts"),
    ]
    files = review_files(given)
    assert rows(scoring.files_by_risk(files), "position", "path", "risk") == [
        (1, "b.ts", "high"),
        (2, "z.py", "medium"),
        (3, "m.json", "low"),
        (4, "n.ts", "low"),
        (5, "d.ts", "low"),
        (6, "u.sh", "low"),
    ]
    assert rows(review_rows(given), "review_id", "score", "errors", "warnings", "infos", "total_issues") == [
        ("empty", 100, 0, 0, 0, 0),
        ("r", 100 - 30 - 10 - 1, 2, 2, 1, 6),
    ]


def test_whole_job_writes_tables(spark, tmp_path):
    given = job(spark)
    # a run that is repeated replaces what it wrote
    for _ in range(2):
        results = run_review(given, str(tmp_path), run_id="1")
    texts: dict[str, list[str]] = {}
    for p in results["reports"].orderBy("review_id", "section", "part").collect():
        texts.setdefault(p.review_id, []).append(p.text)
    assert {k: "\n".join(v) for k, v in texts.items()} == {"r": REPORT, "empty": fv.EMPTY_REPORT}
    hits = history.rule_hit_counts(spark.read.parquet(f"{tmp_path}/rule_hits"))
    assert sum(r.hits for r in hits.collect()) == 6
    findings = spark.read.parquet(f"{tmp_path}/findings")
    assert findings.count() == 6
    assert {str(r.review_date) for r in findings.collect()} == {"2024-01-02"}
    assert "redacted_text" not in findings.columns and "secret_sha256" not in findings.columns
    past = spark.read.parquet(f"{tmp_path}/history")
    assert rows(past, "review_id", "score", "file_count") == [("empty", 100, 0), ("r", 59, 6)]


def test_one_scan_equals_separate_operators(spark):
    given = job(spark)
    files = review_files(given, ReviewSettings(large_hunk=1))
    found = review_findings(given, ReviewSettings(large_hunk=1))
    separate = scoring.severity_tallies(found)
    names = ("path", "errors", "warnings", "infos", "findings")
    assert rows(files.filter("findings > 0"), *names) == rows(separate, *names)


def test_report_parts_join_to_the_report(spark):
    given = job(spark)
    files, found = review_files(given), review_findings(given)
    parts = report.report_parts(files, found, part_lines=2).collect()
    assert len([p for p in parts if p.section == report.NOTES_SECTION + 1]) == 3
    joined = "\n".join(p.text for p in sorted(parts, key=lambda p: (p.section, p.part)))
    assert joined == REPORT


def test_reports_print_lines_as_answers_give_them(spark, tmp_path):
    lines = ('"12-14"', "3.5", "7", "1e1", '"012"')
    items = ", ".join(f'{{"line": {x}, "severity": "error", "message": "m{i}"}}' for i, x in enumerate(lines))
    given = ReviewInputs(
        raw_diffs(spark, ("r", "staged", section("m.json", "@@ -1 +1 @@\n-x\n+y"))),
        snapshots(spark),
        reviews(spark, "r"),
        spark.createDataFrame([("r", "m.json", f"[{items}]")], RESPONSES),
        snapshots(spark, ("r", "m.json", "text", "reviewed")),
    )
    parts = run_review(given, str(tmp_path))["reports"].filter(f"section = {report.NOTES_SECTION + 1}").collect()
    want = ("12-14", "3.5", "7", "10", "012")
    assert parts[0].text.split("\n") == [f"- 🔴 `m.json:{x}` — m{i}" for i, x in enumerate(want)]
