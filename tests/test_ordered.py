"""Running totals in buckets equal plain sequential ones, also for one hot key."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from patchwell.operators.ordered import FILE_SHIFTS, Running, ordinal_within, running, since_last


def events(spark, n=3000):
    # a third of the rows share one key; orders are sparse and repeat
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (i % 7).cast("string"))).alias("k"),
        ((i * 7919) % 1009 * 37 + F.when(i % 5 == 0, 1 << 40).otherwise(0)).alias("o"),
        i.alias("tie"),
        ((i * 31) % 17 - 5).alias("v"),
    )


def sequential(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.k].append(r)
    out = {}
    for k, members in groups.items():
        total, best = 0, None
        for n, r in enumerate(sorted(members, key=lambda r: (r.o, r.tie)), 1):
            before = best
            total += r.v
            best = r.v if best is None else max(best, r.v)
            out[k, r.tie] = (n, total, best, before)
    return out


def test_running_totals(spark):
    table = events(spark)
    totals = [
        Running("total", F.col("v")),
        Running("best", F.col("v"), "max"),
        Running("before", F.col("v"), "max", inclusive=False),
    ]
    for shifts in (FILE_SHIFTS, (3, 9)):
        ranked = ordinal_within(table, ["k"], F.col("o"), [F.col("tie")], "n", shifts)
        got = running(ranked, ["k"], F.col("o"), [F.col("tie")], totals, shifts).collect()
        assert {(r.k, r.tie): (r.n, r.total, r.best, r.before) for r in got} == sequential(
            table.collect()
        )


def test_no_window_spans_a_whole_group(spark):
    plan = ordinal_within(events(spark), ["k"], F.col("o"), [F.col("tie")], "n")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    specs = [line for line in text.splitlines() if "Window [" in line]
    over_rows = [s for s in specs if "_l_n" in s]
    assert over_rows and all("_small" in s for s in over_rows)


def test_since_last_with_nulls_and_small_buckets(spark):
    table = [(r, t, t in (3, 40, 41)) for r in ("a", None) for t in (None, *range(0, 60, 1))]
    df = spark.createDataFrame(table, "repo string, t long, bad boolean")
    out = since_last(df, ["repo"], F.col("t"), [F.col("t")], F.col("bad"), "since", shifts=(2, 4))
    want = {}
    for r in ("a", None):
        n = 0
        for t in (None, *range(60)):
            n = 0 if t in (3, 40, 41) else n + 1
            want[(r, t)] = n
    assert {(x.repo, x.t): x.since for x in out.collect()} == want
