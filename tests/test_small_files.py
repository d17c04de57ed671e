"""Many small diff files take few tasks to list and to read."""

from __future__ import annotations

import os

from patchwell.operators import merge
from patchwell.operators.findings import scan, scanned_findings
from patchwell.plans.review import store_sections
from patchwell.sources.tables import (
    KEYS,
    RAW_DIFFS,
    SMALL_FILES,
    SNAPSHOTS,
    read_diff_files,
    read_diff_sections,
    read_diff_texts,
    small_files,
    write_diff_files,
)
from patchwell.streaming import arrivals, files
from tests.tables import added, rows


def test_few_tasks_read_many_files(spark, tmp_path):
    for i in range(100):
        folder = tmp_path / "in" / "repo=a" / f"review_id=r{i}" / "channel=staged"
        os.makedirs(folder)
        (folder / "part.txt").write_text(added("a.ts", "debugger") + "\n", encoding="utf-8")
    before = dict(spark.conf.getAll)
    sections = store_sections(spark, f"{tmp_path}/in", f"{tmp_path}/out", "one")
    assert dict(spark.conf.getAll) == before and not set(SMALL_FILES) & set(before)
    assert sections.count() == 100
    assert len([x for x in os.listdir(f"{tmp_path}/out/run_id=one") if x.startswith("part-")]) <= 16


def test_few_tasks_read_a_batch_of_arriving_files(spark, tmp_path):
    for i in range(100):
        folder = tmp_path / "in" / "a" / f"r{i}"
        os.makedirs(folder)
        (folder / "staged.diff").write_text(added("a.ts", "debugger") + "\n", encoding="utf-8")
    writer = files.scan_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", kept_for="1 day")
    writer.trigger(availableNow=True).start().awaitTermination()
    parts = [x for _, _, names in os.walk(tmp_path / "out") for x in names if x.startswith("part-")]
    assert arrivals.read_scan(spark, f"{tmp_path}/out").where("f IS NOT NULL").count() == 100
    assert len(parts) <= 16


def put(tmp_path, **texts: str) -> str:
    for name, text in texts.items():
        folder = tmp_path / "in" / "repo" / name
        os.makedirs(folder)
        (folder / "staged.diff").write_text(text, encoding="utf-8")
    return f"{tmp_path}/in"


def stages(spark, group: str) -> list[int]:
    """Numbers of tasks of the stages of a stream."""
    tracker = spark.sparkContext.statusTracker()
    found = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return [x.numTasks for x in found if x]


def test_a_stream_lists_its_files_by_few_tasks(spark, tmp_path):
    folder = put(tmp_path, **{f"r{i}": added("a.ts", "debugger") for i in range(100)})
    with small_files(spark):
        writer = files.scan_files(spark, folder, f"{tmp_path}/out", f"{tmp_path}/state", kept_for="1 day")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    found = stages(spark, str(query.runId))
    assert found and max(found) <= 32
    assert arrivals.read_scan(spark, f"{tmp_path}/out").where("f IS NOT NULL").count() == 100


def test_small_files_are_read_without_a_shuffle(spark, tmp_path, capsys):
    folder = put(tmp_path, one=added("a.ts", "debugger") + "\n", two=added("b.ts", "x") + "\n \n")
    whole, larger = read_diff_files(spark, f"{folder}/*/*/*.diff")
    assert larger is None
    scan(whole, spark.createDataFrame([], SNAPSHOTS)).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_small_and_large_files_of_a_batch(spark, tmp_path):
    lines = [f"const x{i} = 1 // TODO {i}" for i in range(40)]
    texts = {f"r{i}": "\n".join(added(f"f{j}.ts", *lines[: i * 3], "debugger") for j in (1, 2, 1)) + "\n" for i in range(8)}
    folder = put(tmp_path, **texts)
    sizes = sorted(len(x) for x in texts.values())
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, str(sizes[4]))
    try:
        files.scan_files(spark, folder, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        found = scanned_findings(arrivals.read_scan(spark, f"{tmp_path}/out"))
        columns = ("repo", "review_id", "path", "line", "rule", "message")
        want = scanned_findings(scan(read_diff_texts(spark, f"{folder}/*/*/*.diff"), spark.createDataFrame([], SNAPSHOTS)))
        assert rows(found, *columns) == rows(want, *columns)
    finally:
        spark.conf.set(size, before)


def test_keys_that_folders_name_are_texts(spark, tmp_path):
    keys = [("007", "1e3", "staged"), ("008", "2024-1-2", "unstaged"), ("c++", "r 1/é: 100%41", "staged"), ("x", None, "staged")]
    diffs = spark.createDataFrame([(*k, added("a.ts", "debugger")) for k in keys], RAW_DIFFS)
    write_diff_files(diffs, f"file://{tmp_path}/in")
    for sections in (
        store_sections(spark, f"{tmp_path}/in", f"{tmp_path}/out", "one"),
        read_diff_sections(spark, f"{tmp_path}/in"),
    ):
        assert rows(sections, *KEYS) == sorted(keys, key=repr)


def test_sections_are_stored_by_one_read_without_a_shuffle(spark, tmp_path):
    texts = [added(f"f{i}.ts", "x") + "\n" for i in range(6)]
    folder = put(tmp_path, **{f"r{i}": x + texts[i] for i, x in enumerate(reversed(texts))})
    store_sections(spark, f"{folder}/*/*/*.diff", f"{tmp_path}/warm", "one")
    spark.sparkContext.setJobGroup("stored", "sections stored")
    sections = store_sections(spark, f"{folder}/*/*/*.diff", f"{tmp_path}/out", "one")
    spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("stored")]
    assert jobs and all(len(j.stageIds) == 1 for j in jobs)
    none = spark.createDataFrame([], SNAPSHOTS)
    columns = ("review_id", "path", "status", "additions")
    want = merge.changed_files(read_diff_texts(spark, f"{folder}/*/*/*.diff"), none)
    assert rows(merge.changed_files(sections, none), *columns) == rows(want, *columns)


def contents(folder) -> dict[str, bytes]:
    """Texts by the names of their folders."""
    found = {}
    for at, _, names in os.walk(folder):
        for name in names:
            if name.startswith("part-"):
                with open(os.path.join(at, name), "rb") as file:
                    found[os.path.relpath(at, folder)] = file.read()
    return found


def test_written_files_are_those_of_the_text_writer(spark, tmp_path):
    given = [
        ("a", "r1", "staged", added("a.ts", "x")),
        ("a", "r 1/é: 100%", "staged", "é\r\n\n"),
        ("x=y'\"#*?[b]{c}^\\\x01\x7f", "r1", "unstaged", ""),
        ("a", "r2", "staged", None),
        ("a", None, "staged", "text"),
        ("a", "", "unstaged", "text"),
    ]
    diffs = spark.createDataFrame(given, RAW_DIFFS)
    diffs.write.partitionBy("repo", "review_id", "channel").text(f"{tmp_path}/spark")
    write_diff_files(diffs, f"file://{tmp_path}/own")
    want = contents(f"{tmp_path}/spark")
    assert contents(f"{tmp_path}/own") == want and len(want) == len(given)
    one, two = (rows(spark.read.text(f"{tmp_path}/{x}"), "repo", "review_id", "channel", "value") for x in ("spark", "own"))
    assert one == two
    write_diff_files(diffs.where("review_id = 'r2'"), f"{tmp_path}/own")  # appends
    assert spark.read.text(f"{tmp_path}/own").count() == len(two) + 1
