"""The history of each repository as keyed state, updated by every review that arrives.

What a repository's state holds is bounded: counters (a value), its newest reviews (a value of
arrays, as long as the recent view, so that they are read and written at once), and one entry per
analyzer (a map). A review costs its own row, however long the history is.

Reviews count in order of (time, id). Within a batch they are sorted. One that arrives after newer
ones is put in its place among the kept reviews, and the streaks after it are set right; one older
than all that is kept still counts, with its hits, but has no place any more: it is reported as
``unplaced``, and exact trends over such a history are those of the stored tables (``history``)
or of day summaries (``summaries``).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from patchwell.settings import DEFAULTS, ReviewSettings
from patchwell.sources.tables import read_or_empty, workers_find_package
from patchwell.streaming.arrivals import appended, batch_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

KEPT = "review_id string, ts timestamp_ntz, score bigint, streak bigint, score_change bigint"
NEWEST = (
    "review_ids array<string>, times array<timestamp_ntz>, scores array<bigint>, streaks array<bigint>,"
    " score_changes array<bigint>"
)
COUNTERS = "reviews bigint, unplaced bigint"
HITS = "hits bigint, ts timestamp_ntz, review_id string, seq bigint"
RUNNING = (
    "repo string, review_id string, ts timestamp_ntz, score bigint, streak bigint, score_change bigint,"
    " reviews bigint, unplaced bigint, analyzer string, top_hits bigint,"
    f" hit_counts map<string,bigint>, recent array<struct<{KEPT.replace(' ', ':').replace(',:', ',')}>>"
)


#: hits as the state's rows carry them: one text is quicker to hand to Python than an array of structs
HIT_TEXT = "array<struct<analyzer:string,hits:bigint,seq:bigint>>"
OUT = Row(*[c.split()[0] for c in RUNNING.split(", recent")[0].split(", ")], "recent")


def reviews_with_hits(reviews: DataFrame, hits: DataFrame) -> DataFrame:
    """Review rows with their hits per analyzer, as :func:`running_history` takes them."""
    counts = hits.groupBy("review_id", "analyzer").agg(F.count(F.lit(1)).alias("hits"), F.min("seq").alias("seq"))
    listed = counts.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("analyzer", "hits", "seq"))).alias("hits"))
    return reviews.join(listed, "review_id", "left")


class RepositoryState(StatefulProcessor):
    """Streak, newest reviews and hits of one repository."""

    def __init__(self, good_score: int, keep: int) -> None:
        self.good_score, self.keep = good_score, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", COUNTERS)
        self.recent = handle.getValueState("newest", NEWEST)
        self.hits = handle.getMapState("hits", "analyzer string", HITS)

    def close(self) -> None:
        pass

    def _traced(self, entry: list, before: list | None) -> list:
        """A kept review with the streak and score change that follow from the one before it."""
        key, ts, score, _, _ = entry
        broken = score is not None and score < self.good_score
        streak = 0 if broken else (before[3] if before else 0) + 1
        known = before is not None and score is not None and before[2] is not None
        return [key, ts, score, streak, score - before[2] if known else None]

    def _place(self, kept: list[list], key: str, ts: Any, score: int | None, whole: bool) -> list | None:
        """Put a review among the kept ones; None if it is older than all of a longer history."""
        at = len(kept)
        while at and (kept[at - 1][1], kept[at - 1][0]) > (ts, key):
            at -= 1
        if at == 0 and kept and not whole:
            return None
        kept.insert(at, [key, ts, score, 0, None])
        for i in range(at, len(kept)):
            kept[i] = self._traced(kept[i], kept[i - 1] if i else None)
        return kept[at]

    def _count(self, totals: dict[str, tuple], key: str, ts: Any, hits: str | None) -> None:
        for hit in json.loads(hits) if hits else ():
            analyzer, seq = hit["analyzer"], hit["seq"]
            first = (ts, key, seq)
            n, *seen = totals.get(analyzer, (0, *first))
            totals[analyzer] = (n + hit["hits"], *min(tuple(seen), first))

    def handleInputRows(self, key: Any, rows: Iterable[Row], timerValues: Any) -> Iterator[Row]:
        repo = key[0]
        reviews, unplaced = self.counters.get() or (0, 0)
        kept = [list(x) for x in zip(*(self.recent.get() or ()))]
        before = {k[0]: tuple(v) for k, v in self.hits.iterator()} if reviews else {}
        totals, known = dict(before), {x[0] for x in kept}
        out: list[tuple] = []
        # by position: a field of a Row that is asked for by name is searched for
        for ts, review, score, hits in sorted(((r[2], r[1], r[3], r[4]) for r in rows), key=itemgetter(0, 1)):
            if review in known:
                continue  # arrived before
            entry = self._place(kept, review, ts, score, whole=reviews == len(kept))
            reviews, unplaced = reviews + 1, unplaced + (entry is None)
            if entry:
                known.add(review)
            self._count(totals, review, ts, hits)
            top = min(totals.items(), key=lambda x: (-x[1][0], x[1][1:]), default=("", (0,)))
            streak, change = (entry[3], entry[4]) if entry else (None, None)
            out.append((repo, review, ts, score, streak, change, reviews, unplaced, top[0], top[1][0], None, None))
            if (over := len(kept) - self.keep) > 0:
                known.difference_update(x[0] for x in kept[:over])
                del kept[:over]
        if not out:
            return
        self.counters.update((reviews, unplaced))
        self.recent.update(tuple(map(list, zip(*kept))) or ([],) * 5)
        for analyzer, total in totals.items():
            if before.get(analyzer) != total:
                self.hits.updateValue((analyzer,), total)
        names = [c.split()[0] for c in KEPT.split(", ")]
        recent = [dict(zip(names, x)) for x in reversed(kept)]
        out[-1] = (*out[-1][:-2], {a: t[0] for a, t in totals.items()}, recent)
        yield from (OUT(*x) for x in out)


def running_history(reviews: DataFrame, settings: ReviewSettings = DEFAULTS) -> DataFrame:
    """A row for every arriving review: the trends of its repository right after it.

    ``reviews`` has ``repo, review_id, ts, score`` and ``hits``, an array of (analyzer, hits, seq).
    The last row of a repository in a batch also has ``recent``, its newest reviews, newest first,
    each with its streak and score change, and ``hit_counts``. A null score breaks no streak. A
    review without time or id is not counted. The session needs the RocksDB state store, which
    :func:`keep_running` sets for its query."""
    placed = reviews.where("ts IS NOT NULL AND review_id IS NOT NULL")
    hits = F.to_json(F.col("hits").cast(HIT_TEXT), {"ignoreNullFields": "false"})
    given = placed.select("repo", "review_id", "ts", F.col("score").cast("bigint").alias("score"), hits.alias("hits"))
    state = RepositoryState(settings.good_score, settings.keep_reviews)
    return given.groupBy("repo").transformWithState(state, RUNNING, "Append", "None")


def keep_running(reviews: DataFrame, out: str, checkpoint: str, settings: ReviewSettings = DEFAULTS) -> DataStreamWriter:
    """Append the running history of arriving reviews to ``out``."""
    _require_state_store(reviews.sparkSession)
    workers_find_package(reviews.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(batch, out, batch_id))

    return appended(running_history(reviews, settings), checkpoint, write)


def _require_state_store(spark: SparkSession) -> None:
    if spark.conf.get(PROVIDER) != ROCKS:
        raise ValueError(f"keyed history needs {PROVIDER}={ROCKS}")


def read_running(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all batches, each with its batch; empty before the first."""
    return read_or_empty(spark, out, f"{RUNNING}, query_id string, batch_id bigint")


def current_state(running: DataFrame) -> DataFrame:
    """One row per repository: its trends now, the newest reviews and the hits.

    Counters only grow, so the row that has counted most is the newest."""
    newest = F.max_by(F.struct(*[c for c in running.columns if c != "repo"]), "reviews").alias("now")
    return running.where("recent IS NOT NULL").groupBy("repo").agg(newest).select("repo", "now.*")


def current_reviews(running: DataFrame) -> DataFrame:
    """The newest reviews of each repository with streak and score change, newest first."""
    entries = current_state(running).select("repo", F.posexplode("recent").alias("at", "r"))
    return entries.select("repo", (F.col("at") + 1).cast("bigint").alias("recency"), "r.*")


def current_summary(running: DataFrame, repos: DataFrame) -> DataFrame:
    """State of every repository, with defaults for those without history."""
    now = current_state(running)
    latest = F.col("recent")[0]
    known = now.select(
        "repo", "reviews", latest["score"].alias("last_score"), latest["streak"].alias("streak"),
        F.col("analyzer").alias("most_common_analyzer"), "top_hits",
    )
    zero = F.lit(0).cast("bigint")
    return repos.select("repo").distinct().join(known, "repo", "left").select(
        "repo", F.coalesce("reviews", zero).alias("reviews"), "last_score", F.coalesce("streak", zero).alias("streak"),
        F.coalesce("most_common_analyzer", F.lit("")).alias("most_common_analyzer"), F.coalesce("top_hits", zero).alias("top_hits"),
    )
