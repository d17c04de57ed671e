"""Registry: one query per operator, each over whole driver tables."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from patchwell.functions.paths import gates
from patchwell.functions.rules import Rule, text
from patchwell.functions.text import trim
from patchwell.operators import diff, findings, history, locate, merge, prompts, report, scoring, summaries
from patchwell.operators.ordered import ordinal_within
from patchwell.plans import publish
from patchwell.plans.review import (
    ReviewInputs,
    review_files,
    review_findings,
    review_rows,
    review_tables,
    store_sections,
)
from patchwell.settings import ReviewSettings
from patchwell.sources import derived
from patchwell.sources.published import read_published
from patchwell.sources.tables import RULE_HITS, scratch_folder, small_files, write_diff_files
from patchwell.streaming import arrivals, running
from patchwell.streaming import files as incoming

Query = Callable[[SparkSession, str], DataFrame]

#: the derived diffs have hunks of at most six lines
SETTINGS = ReviewSettings(large_hunk=4)
ALL_OFF = ReviewSettings(
    console_log=False,
    debugger=False,
    secrets=False,
    todos=False,
    large_functions=False,
    type_any=False,
    ts_directive=False,
    large_hunk=4,
)
#: characters from which on the rule of ``added_rule_findings`` hits
LONG_LINE = 60
FINDING = (
    "review_id",
    "path",
    "line",
    "end_line",
    "severity",
    "analyzer",
    "rule",
    "message",
    "suggestion",
    "fix_kind",
    "fix_label",
    "fix_env_key",
)

QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def inputs(spark: SparkSession, sf_dir: str, answers: bool = False) -> ReviewInputs:
    return ReviewInputs(
        raw_diffs=derived.merge_raw_diffs(spark, sf_dir),
        snapshots=derived.snapshots(spark, sf_dir),
        reviews=derived.review_dimension(spark, sf_dir),
        responses=derived.responses(spark, sf_dir) if answers else None,
        contents=derived.reviewed_contents(spark, sf_dir) if answers else None,
    )


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.file_sections(derived.raw_diffs(spark, sf_dir))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = inputs(spark, sf_dir)
    return merge.changed_files(given.raw_diffs, given.snapshots)


# --- sources ------------------------------------------------------------------


@query
def trimmed_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived.raw_diffs(spark, sf_dir)
    return raw.select("repo", "review_id", "channel", trim(F.col("raw_diff")).alias("raw_diff"))


@query
def snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hunks = diff.snapshot_hunks(derived.snapshots(spark, sf_dir, every=True))
    return diff.snapshot_lines(hunks).select(
        "review_id", "path", "src_ord", "pos", "line_number", "line_type", "content"
    )


# --- diff decomposition -------------------------------------------------------


@query
def diff_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = diff.diff_sections(derived.raw_diffs(spark, sf_dir))
    return sections.withColumn("section_seq", F.col("section_seq").cast("bigint"))


@query
def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("repo", "review_id", "path", "status", "src_ord")


@query
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_hunks(_sections(spark, sf_dir)).select(
        "review_id",
        "path",
        "src_ord",
        "hunk_idx",
        "old_start",
        "old_count",
        "new_start",
        "new_count",
    )


LINE = ("review_id", "path", "src_ord", "hunk_idx", "pos", "line_number", "line_type", "content")


@query
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_lines(diff.diff_hunks(_sections(spark, sf_dir))).select(*LINE)


@query
def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = diff.diff_lines(diff.diff_hunks(_sections(spark, sf_dir)))
    return diff.added_lines(lines).select(*LINE)


@query
def file_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diff.section_rows(_sections(spark, sf_dir))
    return rows.select("review_id", "path", "src_ord", "additions", "deletions")


CHANGED = ("review_id", "path", "file_ord", "status", "additions", "deletions")


@query
def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived.merge_raw_diffs(spark, sf_dir, every=True)
    return merge.merge_files(diff.section_rows(diff.file_sections(raw))).select(*CHANGED)


@query
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).select(*CHANGED)


def _filled_in(spark: SparkSession, sf_dir: str, rank: int) -> DataFrame:
    given = inputs(spark, sf_dir)
    files = merge.covering_files(given.raw_diffs, given.snapshots)
    return merge.added_by_snapshot(files, rank).select(*CHANGED)


@query
def untracked_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled_in(spark, sf_dir, diff.FIRST_SNAPSHOT_RANK)


@query
def staged_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled_in(spark, sf_dir, diff.FIRST_SNAPSHOT_RANK + 1)


# --- rules --------------------------------------------------------------------


@query
def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).select("review_id", "path", *gates(F.col("path")))


def _only(**switch: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return review_findings(inputs(spark, sf_dir), replace(ALL_OFF, **switch)).select(*FINDING)

    return run


QUERIES["console_findings"] = _only(console_log=True)
QUERIES["debugger_findings"] = _only(debugger=True)
QUERIES["secret_findings"] = _only(secrets=True)
QUERIES["todo_findings"] = _only(todos=True)
QUERIES["large_hunk_findings"] = _only(large_functions=True)
QUERIES["type_any_findings"] = _only(type_any=True)
QUERIES["ts_directive_findings"] = _only(ts_directive=True)


def _long_lines(most: int) -> Rule:
    """A rule as a user adds one: code lines of more characters than ``most``."""
    return Rule(
        "long-line",
        "line-length",
        hint=lambda n: n.is_code & (F.length(n.content) > most),
        hit=lambda n: F.length(n.content) > most,
        severity=lambda n: F.when(F.length(n.content) > 2 * most, "warning").otherwise("info"),
        message=lambda n: F.concat(F.length(n.content).cast("string"), F.lit(" characters in a line")),
        suggestion=text("Break the line."),
    )


ADDED = replace(SETTINGS, added_rules=(_long_lines(LONG_LINE),))


@query
def added_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings with a rule added to the built-in ones, with their ids."""
    found = findings.number_findings(review_findings(inputs(spark, sf_dir), ADDED))
    return found.select("finding_id", *FINDING)


@query
def added_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by analyzer with a rule added."""
    given = inputs(spark, sf_dir)
    files, found = review_tables(given, ADDED)
    hits = history.rule_hits_of(found, scoring.files_by_risk(files), given.reviews)
    return history.rule_hit_counts(hits).select("repo", "analyzer", "hits")


@query
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_findings(inputs(spark, sf_dir), SETTINGS).select(*FINDING)


@query
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = review_tables(inputs(spark, sf_dir), SETTINGS)
    numbered = findings.number_findings(found)
    return numbered.select("review_id", "finding_id", "path", "line", "rule")


@query
def rule_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with three of the seven rules switched on."""
    some = replace(ALL_OFF, console_log=True, todos=True, type_any=True)
    rows = review_rows(inputs(spark, sf_dir), some)
    return rows.select("review_id", "score", "total_issues", "errors", "warnings", "infos")


# --- scoring ------------------------------------------------------------------


@query
def file_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = review_files(inputs(spark, sf_dir), SETTINGS)
    return files.select("review_id", "path", "risk", "errors", "warnings", "infos", "findings")


@query
def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(inputs(spark, sf_dir), SETTINGS)
    return rows.select("repo", "review_id", "score")


@query
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(inputs(spark, sf_dir), SETTINGS)
    return rows.select("review_id", "total_issues", "errors", "warnings", "infos")


@query
def review_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_rows(inputs(spark, sf_dir), SETTINGS)


@query
def empty_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews without a file: no rule is run to find them."""
    given = inputs(spark, sf_dir)
    with_files = merge.covering_files(given.raw_diffs, given.snapshots).select("review_id")
    zero = F.lit(0).cast("bigint")
    return given.reviews.join(with_files, "review_id", "left_anti").select(
        "repo",
        "review_id",
        scoring.review_score(zero, zero, zero).alias("score"),
        zero.alias("total_issues"),
        F.lit(report.fv.EMPTY_REPORT).alias("report"),
    )


@query
def files_by_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = review_files(inputs(spark, sf_dir), SETTINGS)
    return scoring.files_by_risk(files).select("review_id", "path", "risk", "position")


@query
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of all reviews in their parts."""
    given = inputs(spark, sf_dir)
    files, found = review_tables(given, SETTINGS)
    parts = report.markdown_reports(given.reviews, files, found)
    return parts.withColumn("section", F.col("section").cast("bigint"))


@query
def report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in parts of eight lines."""
    files, found = review_tables(inputs(spark, sf_dir), SETTINGS)
    parts = report.report_parts(files, found, part_lines=8)
    return parts.withColumn("section", F.col("section").cast("bigint"))


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.status_counts(_changed(spark, sf_dir))


@query
def change_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.change_totals(_changed(spark, sf_dir))


@query
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors, with the place of their file in risk order."""
    files, found = review_tables(inputs(spark, sf_dir), SETTINGS)
    listed = scoring.findings_list(found, scoring.files_by_risk(files), "error")
    return listed.select("review_id", "file_position", "path", "line", "analyzer", "message")


@query
def file_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.file_rollup(review_files(inputs(spark, sf_dir), SETTINGS))


# --- history ------------------------------------------------------------------


@query
def history_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.snapshots_of(review_rows(inputs(spark, sf_dir), SETTINGS))


@query
def history_last50(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = history.last_reviews(derived.review_history(spark, sf_dir))
    return recent.select("repo", "review_id", "recency", "ts", "score", "total_issues", "file_count")


@query
def clean_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    streaks = history.clean_streaks(derived.review_history(spark, sf_dir))
    return streaks.select("repo", "review_id", "score", "streak")


@query
def current_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.current_streaks(derived.review_history(spark, sf_dir))


@query
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = history.rule_hit_counts(derived.rule_hits(spark, sf_dir))
    return counts.select("repo", "analyzer", "hits")


@query
def top_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.top_rule(derived.rule_hits(spark, sf_dir))


def _review_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = inputs(spark, sf_dir)
    files, found = review_tables(given, SETTINGS)
    return history.rule_hits_of(found, scoring.files_by_risk(files), given.reviews)


@query
def review_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the findings of all reviews."""
    return history.rule_hit_counts(_review_hits(spark, sf_dir)).select("repo", "analyzer", "hits")


@query
def review_top_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.top_rule(_review_hits(spark, sf_dir))


@query
def rule_hit_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of each repository as one text of its map, as maps do not compare."""
    maps = history.rule_hit_map(_review_hits(spark, sf_dir))
    return maps.select("repo", F.to_json("hit_counts").alias("hit_counts"))


@query
def score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = history.score_changes(derived.review_history(spark, sf_dir))
    return changes.select("repo", "review_id", "score", "previous_score", "score_change")


@query
def score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = history.banded(derived.review_history(spark, sf_dir))
    return banded.select("repo", "review_id", "score", "band")


@query
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of the documents and of the events; the former lack history."""
    past = derived.review_history(spark, sf_dir)
    repos = past.select("repo").unionByName(
        derived.review_dimension(spark, sf_dir).select("repo")
    )
    return history.history_summary(past, derived.rule_hits(spark, sf_dir), repos)


# --- location and fixes -------------------------------------------------------


@query
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.diagnostics(review_findings(inputs(spark, sf_dir, answers=True), SETTINGS))


@query
def proximity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = locate.proximity_groups(review_findings(inputs(spark, sf_dir), SETTINGS))
    return groups.select("review_id", "path", "start_line", "end_line", "line_count")


@query
def group_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = locate.proximity_groups(review_findings(inputs(spark, sf_dir), SETTINGS))
    return groups.select("review_id", "path", "start_line", "errors", "warnings")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.fix_candidates(review_findings(inputs(spark, sf_dir, answers=True), SETTINGS))


@query
def fix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select(
        "review_id", "path", "line", "rule", "fix_kind", "fix_label", "fix_env_key"
    )


@query
def fix_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.fix_edits(_candidates(spark, sf_dir))


@query
def redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.redacted_lines(_candidates(spark, sf_dir))


@query
def env_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.env_entries(_candidates(spark, sf_dir))


@query
def ignore_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = locate.env_entries(_candidates(spark, sf_dir))
    return locate.ignore_updates(entries, derived.ignore_files(spark, sf_dir))


# --- prompts and answers ------------------------------------------------------


def _hunks_and_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    given = inputs(spark, sf_dir)
    files = merge.changed_files(given.raw_diffs, given.snapshots)
    return prompts.review_hunks(given.raw_diffs, given.snapshots), files


@query
def change_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.change_details(*_hunks_and_files(spark, sf_dir))


@query
def context_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    hunks, files = _hunks_and_files(spark, sf_dir)
    return prompts.context_lines(hunks, files, derived.reviewed_contents(spark, sf_dir))


@query
def review_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hunks, files = _hunks_and_files(spark, sf_dir)
    return prompts.review_prompts(files, hunks, derived.reviewed_contents(spark, sf_dir))


@query
def llm_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = inputs(spark, sf_dir, answers=True)
    answers = prompts.assistant_findings(prompts.answered_files(given.responses, given.contents))
    files = merge.changed_files(given.raw_diffs, given.snapshots)
    numbered = findings.number_findings(findings.reviewed_findings(answers, files))
    return numbered.select(
        "review_id", "finding_id", "path", "line", "line_given", "severity", "message", "suggestion"
    )


@query
def ai_review_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with the assistant's findings counted in."""
    return review_rows(inputs(spark, sf_dir, answers=True), SETTINGS)


# --- published tables ---------------------------------------------------------


def _published(spark: SparkSession, sf_dir: str) -> str:
    """The events' history in two runs that share all days, the first of them repeated."""
    out = f"{scratch_folder(spark)}/published-{uuid.uuid4().hex}"
    past, hits = derived.review_history(spark, sf_dir), derived.rule_hits(spark, sf_dir)
    even = F.col("review_id").cast("bigint") % 2 == 0
    some = F.col("review_id").cast("bigint") % 3 == 0
    publish.publish(spark, out, "even", past.where(even & some), hits.where(even & some))
    publish.publish(spark, out, "odd", past.where(~even), hits.where(~even))
    publish.publish(spark, out, "even", past.where(even), hits.where(even))
    return out


@query
def published_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every repository from the summaries of days alone."""
    out = _published(spark, sf_dir)
    repos = derived.review_history(spark, sf_dir).select("repo").unionByName(
        derived.review_dimension(spark, sf_dir).select("repo")
    )
    return summaries.summary(publish.read_days(spark, out), publish.read_day_hits(spark, out), repos)


#: a day in the middle of the events
TREND_DAY = datetime.date(2024, 1, 16)


@query
def published_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks and score changes from a day on, by that range and the summaries before it."""
    traced = publish.trends_since(spark, _published(spark, sf_dir), TREND_DAY)
    return traced.select("repo", "review_id", "score", "streak", "score_change")


@query
def published_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as published by a run that was repeated, read back."""
    out = f"{scratch_folder(spark)}/published-{uuid.uuid4().hex}"
    given = inputs(spark, sf_dir)
    # one scan of the diffs for rows and findings, kept for both publications
    files, found = review_tables(given, SETTINGS)
    rows = scoring.review_rollup(files, given.reviews, SETTINGS).persist()
    found = found.join(given.reviews.select("review_id", "ts"), "review_id", "left")
    none = spark.createDataFrame([], RULE_HITS)
    for _ in range(2):
        publish.publish(spark, out, "one", rows, none, found)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*FINDING).schema)
    return read_published(spark, out, "findings", schema).select(*FINDING)


# --- files of any size --------------------------------------------------------


def _split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge variant's diffs as files, read back section by section."""
    folder = f"{scratch_folder(spark)}/diffs-{uuid.uuid4().hex}"
    write_diff_files(derived.merge_raw_diffs(spark, sf_dir), f"{folder}/files")
    return store_sections(spark, f"{folder}/files", f"{folder}/sections", "all")


@query
def split_diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files of diffs that were read from files, a row for each section."""
    files = merge.changed_files(_split_files(spark, sf_dir), derived.snapshots(spark, sf_dir))
    placed = ordinal_within(files, ["review_id"], F.col("file_ord"), [], "place")
    return placed.select("review_id", "path", "place", "status", "additions", "deletions")


@query
def split_diff_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the same files."""
    given = replace(inputs(spark, sf_dir), raw_diffs=_split_files(spark, sf_dir))
    return review_findings(given, SETTINGS).select(*FINDING)


# --- streams ------------------------------------------------------------------

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def _stream_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"


def _run(stream: DataStreamWriter) -> None:
    stream.trigger(availableNow=True).start().awaitTermination()


@query
def streamed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a stream in which every document arrives as a diff of its own, every
    third one twice."""
    folder = _stream_folder(spark)
    arriving = derived.arriving(spark, sf_dir, "documents", "doc_id bigint, text string, source string")
    parts = derived.sections(derived.as_files(arriving))
    times = F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)
    twice = parts.withColumn("again", F.explode(F.sequence(F.lit(1), times)))
    diffs = twice.select(
        "repo",
        F.concat("review_id", F.lit("/"), F.col("doc_id").cast("string")).alias("review_id"),
        F.lit("staged").alias("channel"),
        F.col("section").alias("raw_diff"),
    )
    _run(arrivals.scan_arrivals(diffs, f"{folder}/out", f"{folder}/state", SETTINGS))
    found = findings.scanned_findings(arrivals.read_scan(spark, f"{folder}/out"))
    return found.select("review_id", "path", "line", "severity", "rule", "message")


@query
def arriving_file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a folder into which every diff was put, some of them again later."""
    folder = _stream_folder(spark)
    files = f"{folder}/files"
    diffs = derived.raw_diffs(spark, sf_dir).repartition("repo", "review_id", "channel")

    def arrive(some: DataFrame) -> None:
        write_diff_files(some, files)
        with small_files(spark):
            _run(incoming.scan_files(spark, files, f"{folder}/out", f"{folder}/state", SETTINGS, "1 day"))

    arrive(diffs.where("channel = 'staged'"))
    arrive(diffs.where("channel = 'unstaged'").unionByName(diffs.where("channel = 'staged' AND review_id LIKE '%0'")))
    found = findings.scanned_findings(arrivals.read_scan(spark, f"{folder}/out"))
    return found.select("review_id", "path", "line", "severity", "rule", "message")


@query
def streamed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks and recency in a history that arrived as a stream, every fifth review twice."""
    folder = _stream_folder(spark)
    arriving = derived.arriving(spark, sf_dir, "events", EVENTS)
    times = F.when(F.col("event_id") % 5 == 0, 2).otherwise(1)
    twice = arriving.withColumn("again", F.explode(F.sequence(F.lit(1), times)))
    reviews = derived.as_history(twice)
    _run(arrivals.append_history(reviews, f"{folder}/history", f"{folder}/state"))
    past = history.clean_streaks(arrivals.read_history(spark, f"{folder}/history"))
    return history.last_reviews(past).select("repo", "review_id", "recency", "score", "streak")


@query
def streamed_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running hits of a stream of findings, as it ends."""
    folder = _stream_folder(spark)
    arriving = derived.arriving(spark, sf_dir, "events", "event_id bigint, user_id bigint, event_type string")
    hits = arrivals.running_rule_hits(
        arriving.select(F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("analyzer"))
    )
    _run(arrivals.replaced(hits, f"{folder}/hits", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/hits")


def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of all events, kept as state; an event is a review with one hit, every
    fifth arrives twice."""
    folder = _stream_folder(spark)
    arriving = derived.arriving(spark, sf_dir, "events", EVENTS)
    times = F.when(F.col("event_id") % 5 == 0, 2).otherwise(1)
    twice = arriving.withColumn("again", F.explode(F.sequence(F.lit(1), times)))
    hit = F.struct(
        F.col("event_type").alias("analyzer"), F.lit(1).cast("bigint").alias("hits"), F.col("event_id").alias("seq")
    )
    reviews = derived.as_history(twice, hits=F.array(hit))
    with _state_store(spark):
        _run(running.keep_running(reviews, f"{folder}/running", f"{folder}/state"))
    return running.read_running(spark, f"{folder}/running")


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs its store; the session's own choice comes back afterwards."""
    before = spark.conf.get(running.PROVIDER)
    spark.conf.set(running.PROVIDER, running.ROCKS)
    try:
        yield
    finally:
        spark.conf.set(running.PROVIDER, before)


@query
def running_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streak and score change of the newest reviews, as the state holds them."""
    newest = running.current_reviews(_running(spark, sf_dir))
    return newest.select("repo", "review_id", "recency", "score", "streak", "score_change")


@query
def running_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every repository of documents and events; the former lack history."""
    repos = derived.review_history(spark, sf_dir).select("repo").unionByName(
        derived.review_dimension(spark, sf_dir).select("repo")
    )
    return running.current_summary(_running(spark, sf_dir), repos)
