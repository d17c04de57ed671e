"""Diff files read section by section give what they give read whole."""

from __future__ import annotations

import os

import pytest

from patchwell.operators import diff, merge
from patchwell.operators.findings import scan, scanned_findings
from patchwell.plans.review import ReviewInputs, run_review, store_sections
from patchwell.sources.tables import REVIEWS, read_diff_sections, read_diff_texts
from tests.tables import added, rows, snapshots

SIZE = "spark.sql.files.maxPartitionBytes"
OPEN = "spark.sql.files.openCostInBytes"


@pytest.fixture
def small_splits(spark):
    """Files are cut every few hundred bytes, within lines and section starts."""
    before = {k: spark.conf.get(k) for k in (SIZE, OPEN)}
    spark.conf.set(SIZE, "150")
    spark.conf.set(OPEN, "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def put(tmp_path, **texts: str) -> str:
    """Files of review r, named by channel, or ``review__channel``."""
    for name, text in texts.items():
        review, channel = name.split("__") if "__" in name else ("r", name)
        folder = tmp_path / "in" / "repo" / review
        os.makedirs(folder, exist_ok=True)
        (folder / f"{channel}.diff").write_bytes(text.encode())
    return f"{tmp_path}/in/*/*/*.diff"


def many(n: int, channel: str) -> str:
    return "\n".join(added(f"{channel}/f{i % (n - 3)}.ts", *[f"const x{j} = {i} // TODO é" for j in range(i % 7)]) for i in range(n))


ODD = {
    "plain": added("a.ts", "debugger") + "\n" + added("b.ts", "x") + "\n",
    "blank_ends": added("a.ts", "x") + "\n \n" + added("b.ts", "y") + "\n \n\n \n",
    "preface": "From: someone\nSubject: x\n\n+++ b/from-preface.ts\n" + added("a.ts", "x") + "\n",
    "indented": " \n\n" + added("a.ts", "x") + "\n",
    "indented_preface": "\n  text in front\n" + added("a.ts", "x"),
    "inner": added("a.ts", "diff --git a/x b/x", " diff --git a/y b/y") + "\n" + added("c.ts", "z"),
    "binary": "diff --git a/x.bin b/x.bin\nBinary files a/x.bin and b/x.bin differ\n" + added("c.ts", "z") + "\n",
    "quoted": 'diff --git "a/\\303\\251" "b/\\303\\251"\nnew file mode 100644\n' + added("c.ts", "z") + "\n",
    "returns": added("a.ts", "x\r") + "\r\n" + added("b.ts", "y z") + "\r\n",
    "empty": "",
    "blank": " \n\n",
    "only_text": "nothing to see",
    "repeats": "\n".join([added("a.ts", "one"), added("b.ts", "two"), added("a.ts", "three", "four")]) + "\n",
}


def ordered(sections) -> list[tuple]:
    """Sections in their order, whatever their ordinals are."""
    found = sections.select("review_id", "channel", "section_seq", "section").collect()
    return [(r[0], r[1], r[3]) for r in sorted(found)]


@pytest.mark.parametrize("name", list(ODD))
def test_odd_files(spark, tmp_path, small_splits, name):
    path = put(tmp_path, staged=ODD[name], r2__unstaged=ODD["plain"])
    whole = diff.diff_sections(read_diff_texts(spark, path))
    want = [x for x in ordered(whole) if x[2]]  # the only section of a blank text is empty
    assert ordered(read_diff_sections(spark, path)) == want


def both(spark, tmp_path, path):
    texts = read_diff_texts(spark, path)
    return texts, store_sections(spark, path, f"{tmp_path}/sections", "one")


FILES = ("review_id", "path", "status", "src_class", *merge.COUNTS)
FOUND = ("review_id", "path", "line", "rule", "message")


def test_files_findings_and_order(spark, tmp_path, small_splits):
    path = put(tmp_path, staged=many(30, "s"), unstaged=many(25, "u") + "\n" + many(12, "s") + "\n", r2__unstaged=ODD["repeats"])
    texts, sections = both(spark, tmp_path, path)
    none = snapshots(spark)
    assert sections.rdd.getNumPartitions() > 5
    one, two = (merge.changed_files(d, none) for d in (texts, sections))
    assert rows(one, *FILES) == rows(two, *FILES)
    place = lambda files: [r[1:] for r in sorted(tuple(r) for r in files.select("file_ord", "review_id", "path").collect())]
    assert place(one.where("review_id = 'repo/r'")) == place(two.where("review_id = 'repo/r'"))
    assert rows(scanned_findings(scan(texts, none)), *FOUND) == rows(scanned_findings(scan(sections, none)), *FOUND)


def test_whole_review_from_sections(spark, tmp_path, small_splits):
    path = put(tmp_path, staged=many(20, "s"), r2__unstaged=ODD["repeats"])
    texts, sections = both(spark, tmp_path, path)
    reviews = spark.createDataFrame([("repo", "repo/r", None), ("repo", "repo/r2", None)], REVIEWS)
    got = [run_review(ReviewInputs(d, snapshots(spark), reviews), f"{tmp_path}/{i}") for i, d in enumerate((texts, sections))]
    columns = ("review_id", "score", "total_issues", "file_count")
    assert rows(got[0]["reviews"], *columns) == rows(got[1]["reviews"], *columns)
    report = ("review_id", "part", "report")
    names = [c for c in report if c in got[0]["reports"].columns]
    assert rows(got[0]["reports"], *names) == rows(got[1]["reports"], *names)


def test_folders_that_name_the_keys(spark, tmp_path):
    texts = spark.createDataFrame([("007", "r 1", "staged", added("a.ts", "x"))], "repo string, review_id string, channel string, value string")
    texts.write.partitionBy("repo", "review_id", "channel").text(f"{tmp_path}/files")
    found = read_diff_sections(spark, f"{tmp_path}/files")
    assert rows(found, "review_id", "channel", "section") == [("r 1", "staged", added("a.ts", "x"))]
