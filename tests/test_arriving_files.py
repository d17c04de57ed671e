"""Diff files that arrive in a folder: each diff once, with state that does not grow."""

from __future__ import annotations

import os
import time

from patchwell.operators.findings import scan, scanned_findings
from patchwell.sources.tables import SNAPSHOTS, read_diff_texts
from patchwell.streaming import arrivals, files
from tests.tables import added, rows

FOUND = ("repo", "review_id", "path", "line", "rule", "message")


def put(tmp_path, name: str, text: str) -> None:
    path = tmp_path / "in" / f"{name}.diff"
    os.makedirs(path.parent, exist_ok=True)
    (path.parent / ".part").write_text(text, encoding="utf-8")
    os.rename(path.parent / ".part", path)


def run(spark, tmp_path, kept_for: str = "1 day", batch_files: int = 100):
    writer = files.scan_files(
        spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", kept_for=kept_for, batch_files=batch_files
    )
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def found(spark, tmp_path):
    return rows(scanned_findings(arrivals.read_scan(spark, f"{tmp_path}/out")), *FOUND)


def expected(spark, pattern: str):
    diffs = read_diff_texts(spark, pattern)
    return rows(scanned_findings(scan(diffs, spark.createDataFrame([], SNAPSHOTS))), *FOUND)


def test_files_are_reviewed_as_they_arrive(spark, tmp_path):
    put(tmp_path, "one/r1/staged", added("a.ts", "debugger", "// TODO x") + "\n")
    put(tmp_path, "one/r1/unstaged", added("a.ts", "console.log(1)") + "\n" + added("b.py", "print(1)"))
    run(spark, tmp_path)
    first = found(spark, tmp_path)
    assert len(first) == 4
    put(tmp_path, "two/r [1]/staged", added("a.ts", "debugger"))  # a name that is a pattern
    put(tmp_path, "two/r1/staged", added("b.ts", "debugger"))
    run(spark, tmp_path)
    assert found(spark, tmp_path) == expected(spark, f"{tmp_path}/in/*/*/*.diff")
    assert len(found(spark, tmp_path)) == len(first) + 2


def test_a_diff_that_arrives_again_elsewhere_counts_once(spark, tmp_path):
    text = added("a.ts", "debugger") + "\n"
    put(tmp_path, "monday/one/r1/staged", text)
    run(spark, tmp_path)
    put(tmp_path, "tuesday/one/r1/staged", text)
    put(tmp_path, "tuesday/one/r2/staged", text)
    run(spark, tmp_path)
    assert [r[1] for r in found(spark, tmp_path)] == ["one/r1", "one/r2"]


def test_several_batches_of_few_files(spark, tmp_path):
    for i in range(5):
        put(tmp_path, f"one/r{i}/staged", added("a.ts", "debugger"))
    run(spark, tmp_path, batch_files=2)
    assert found(spark, tmp_path) == expected(spark, f"{tmp_path}/in/*/*/*.diff")


def test_old_files_are_not_late(spark, tmp_path):
    put(tmp_path, "one/r1/staged", added("a.ts", "debugger"))
    run(spark, tmp_path, kept_for="1 second")
    put(tmp_path, "one/r2/staged", added("a.ts", "debugger"))
    long_ago = time.time() - 86_400
    os.utime(tmp_path / "in" / "one" / "r2" / "staged.diff", (long_ago, long_ago))
    run(spark, tmp_path, kept_for="1 second")
    assert len(found(spark, tmp_path)) == 2


def test_state_forgets_keys(spark, tmp_path):
    most = 0
    for i in range(4):
        for j in range(10):
            put(tmp_path, f"one/r{i}-{j}/staged", added("a.ts", "debugger"))
        query = run(spark, tmp_path, kept_for="1 second")
        kept = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
        most = max(most, *kept)
        time.sleep(1.5)
    assert most <= 20  # of 40 keys
    assert len(found(spark, tmp_path)) == 40


def test_empty_folder_and_files(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    run(spark, tmp_path)
    put(tmp_path, "one/r1/staged", "")
    put(tmp_path, "one/r2/staged", "no section")
    put(tmp_path, "one/r3/staged", added("a.ts", "debugger"))
    run(spark, tmp_path)
    assert found(spark, tmp_path) == expected(spark, f"{tmp_path}/in/*/*/*.diff")
