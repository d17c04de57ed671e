"""Streams give what the batch operators give on the same rows."""

from __future__ import annotations

import datetime

from patchwell.operators import history
from patchwell.operators.diff import file_sections, reviewable_diff_lines
from patchwell.operators.findings import scan, scanned_findings, static_findings, tallied_rows
from patchwell.operators.merge import COUNTS, TALLIES, merge_files
from patchwell.sources.tables import HISTORY, RAW_DIFFS, SNAPSHOTS
from patchwell.streaming import arrivals
from tests.tables import added, raw_diffs, rows

FOUND = ("review_id", "path", "line", "rule", "message")
FILES = ("review_id", "path", "file_ord", "status", *COUNTS, *TALLIES)


def drop(spark, folder, *given):
    raw_diffs(spark, *given).coalesce(1).write.mode("append").parquet(folder)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def source(spark, folder, schema=RAW_DIFFS):
    return spark.readStream.schema(schema).parquet(folder)


def test_scan_of_arrivals(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    one = ("r1", "staged", added("a.ts", "debugger", "// TODO x"))
    two = ("r1", "unstaged", added("a.ts", "console.log(1)") + "\n" + added("b.py", "print(1)"))
    three = ("r2", "staged", added("c.md", "text"))
    drop(spark, folder, one, one, three)
    stream = source(spark, folder)
    run(arrivals.scan_arrivals(stream, out, state))
    # the second batch brings one diff again and a new channel of the same review
    drop(spark, folder, one, two)
    run(arrivals.scan_arrivals(stream, out, state))

    scanned = arrivals.read_scan(spark, out)
    whole = scan(raw_diffs(spark, one, two, three), spark.createDataFrame([], SNAPSHOTS))
    assert rows(scanned_findings(scanned), *FOUND) == rows(scanned_findings(whole), *FOUND)
    files = merge_files(tallied_rows(scanned), (*COUNTS, *TALLIES))
    expected = merge_files(tallied_rows(whole), (*COUNTS, *TALLIES))
    assert rows(files, *FILES) == rows(expected, *FILES)
    assert len(rows(files, *FILES)) == 3


def test_a_retried_batch_writes_once(spark, tmp_path):
    out = f"{tmp_path}/out"
    written = {}

    class Stream:
        def option(self, *_):
            return self

        def foreachBatch(self, write):
            written["write"] = write
            return self

        def dropDuplicates(self, _):
            return self

        @property
        def writeStream(self):
            return self

    arrivals.scan_arrivals(Stream(), out, f"{tmp_path}/state")
    batch = raw_diffs(spark, ("r", "staged", added("a.ts", "debugger")))
    for batch_id in (0, 0):
        written["write"](batch, batch_id)
    assert rows(scanned_findings(arrivals.read_scan(spark, out)), *FOUND) == [
        ("r", "a.ts", 1, "debugger-script", "debugger statement left in code")
    ]


def test_a_new_checkpoint_replaces_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    for name in ("one", "two"):
        folder = f"{tmp_path}/{name}"
        drop(spark, folder, (name, "staged", added("a.ts", "debugger")))
        run(arrivals.scan_arrivals(source(spark, folder), out, f"{tmp_path}/state-{name}"))
    found = scanned_findings(arrivals.read_scan(spark, out))
    assert [r[0] for r in rows(found, *FOUND)] == ["one", "two"]


def test_findings_need_no_state(spark, tmp_path):
    folder = f"{tmp_path}/in"
    given = [("r", "staged", added("a.ts", "debugger", "x: any")), ("s", "staged", added("b.py", "print(1)"))]
    drop(spark, folder, *given)
    found = arrivals.arriving_findings(source(spark, folder))
    query = (
        found.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    lines = reviewable_diff_lines(file_sections(raw_diffs(spark, *given)), 50)
    assert rows(spark.table("found"), *FOUND) == rows(static_findings(lines), *FOUND)


def test_running_hits(spark, tmp_path):
    folder = f"{tmp_path}/in"
    drop(spark, folder, ("r", "staged", added("a.ts", "debugger")), ("s", "staged", added("a.ts", "debugger")))
    hits = arrivals.running_rule_hits(arrivals.arriving_findings(source(spark, folder)))
    query = (
        hits.writeStream.outputMode("complete")
        .format("memory")
        .queryName("hits")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert rows(spark.table("hits"), "repo", "analyzer", "hits") == [("repo", "debugger", 2)]


def test_history_of_arriving_reviews(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    start = datetime.datetime(2024, 1, 1)

    def arrive(*given):
        table = [("repo", f"r{i}", start + datetime.timedelta(i), s, 0, 0, 0, 0, 0) for i, s in given]
        spark.createDataFrame(table, HISTORY).write.mode("append").parquet(folder)
        run(arrivals.append_history(source(spark, folder, HISTORY), out, state))

    assert arrivals.read_history(spark, out).count() == 0
    arrive((0, 90), (1, 70), (3, 80))
    arrive((1, 70), (2, 85), (4, 100))
    past = arrivals.read_history(spark, out)
    assert rows(history.clean_streaks(past), "review_id", "streak") == [
        ("r0", 1),
        ("r1", 0),
        ("r2", 1),
        ("r3", 2),
        ("r4", 3),
    ]
