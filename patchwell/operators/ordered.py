"""Running totals over groups of any size.

A window over one review or one repository would put that whole group into one
task. These running totals are computed in three levels instead. The ordering
value is a number, cut into buckets by dropping low bits: rows are totalled
within small buckets, small buckets within large ones, and large ones within the
group. Each window then sees one bucket's rows, a bounded number of bucket
totals, or a bounded number of large-bucket totals, and a group spreads over as
many tasks as it has buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: bits dropped for ordinals of files within a review: 64 files, 262,144 files
FILE_SHIFTS = (6, 18)
#: bits dropped for times in microseconds: about a minute, about 19 hours
TIME_SHIFTS = (26, 36)


@dataclass(frozen=True)
class Running:
    """A running sum or maximum; ``inclusive`` counts the row itself."""

    name: str
    value: Column
    kind: str = "sum"
    inclusive: bool = True

    def total(self, value: Column) -> Column:
        return F.sum(value) if self.kind == "sum" else F.max(value)

    def combine(self, *parts: Column) -> Column:
        if self.kind == "max":
            return F.greatest(*parts)
        zero = F.lit(0).cast("bigint")
        total = zero
        for part in parts:
            total = total + F.coalesce(part, zero)
        return total


def _up_to(spec: WindowSpec, inclusive: bool) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join on columns in which a null equals a null."""
    renamed = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(renamed, same).drop(*[f"_on_{c}" for c in on])


def running(
    rows: DataFrame,
    keys: list[str],
    order: Column,
    ties: list[Column],
    totals: list[Running],
    shifts: tuple[int, int] = FILE_SHIFTS,
) -> DataFrame:
    """Add running totals per ``keys`` in (``order``, ``ties``) order."""
    small, large = shifts
    bucketed = rows.withColumns(
        {
            "_order": order.cast("bigint"),
            "_small": F.shiftright(order.cast("bigint"), small),
            "_large": F.shiftright(order.cast("bigint"), large),
        }
    ).withColumns({f"_v_{t.name}": t.value for t in totals})

    within = Window.partitionBy(*keys, "_small").orderBy("_order", *ties)
    local = bucketed.withColumns(
        {
            f"_l_{t.name}": t.total(F.col(f"_v_{t.name}")).over(_up_to(within, t.inclusive))
            for t in totals
        }
    )

    smalls = bucketed.groupBy(*keys, "_large", "_small").agg(
        *[t.total(F.col(f"_v_{t.name}")).alias(f"_s_{t.name}") for t in totals]
    )
    over_smalls = _up_to(Window.partitionBy(*keys, "_large").orderBy("_small"), False)
    smalls = smalls.withColumns(
        {f"_b_{t.name}": t.total(F.col(f"_s_{t.name}")).over(over_smalls) for t in totals}
    )
    larges = smalls.groupBy(*keys, "_large").agg(
        *[t.total(F.col(f"_s_{t.name}")).alias(f"_t_{t.name}") for t in totals]
    )
    over_larges = _up_to(Window.partitionBy(*keys).orderBy("_large"), False)
    larges = larges.withColumns(
        {f"_a_{t.name}": t.total(F.col(f"_t_{t.name}")).over(over_larges) for t in totals}
    )
    before = null_safe_join(smalls, larges, [*keys, "_large"]).select(
        *keys,
        "_small",
        *[
            t.combine(F.col(f"_a_{t.name}"), F.col(f"_b_{t.name}")).alias(f"_p_{t.name}")
            for t in totals
        ],
    )
    joined = null_safe_join(local, before, [*keys, "_small"])
    return joined.select(
        *rows.columns,
        *[
            t.combine(F.col(f"_p_{t.name}"), F.col(f"_l_{t.name}")).alias(t.name) for t in totals
        ],
    )


def ordinal_within(
    rows: DataFrame,
    keys: list[str],
    order: Column,
    ties: list[Column],
    name: str,
    shifts: tuple[int, int] = FILE_SHIFTS,
) -> DataFrame:
    """Number rows from 1 within ``keys``."""
    one = F.lit(1).cast("bigint")
    return running(rows, keys, order, ties, [Running(name, one)], shifts)


def since_last(
    rows: DataFrame,
    keys: list[str],
    order: Column,
    ties: list[Column],
    broken: Column,
    name: str,
    shifts: tuple[int, int] = TIME_SHIFTS,
) -> DataFrame:
    """Add the number of rows since the latest one that is ``broken``, itself not counted.

    One pass over the rows: each level carries how many rows it has and which of
    them, by number, was the last broken one.
    """
    small, large = shifts
    number = order.cast("bigint")
    bucketed = rows.withColumns(
        {
            "_order": number,
            "_small": F.shiftright(number, small),
            "_large": F.shiftright(number, large),
            "_broken": broken,
        }
    )
    within = _up_to(Window.partitionBy(*keys, "_small").orderBy("_order", *ties), True)
    local = bucketed.withColumn("_n", F.count(F.lit(1)).over(within))
    local = local.withColumn("_last", F.max(F.when(F.col("_broken"), F.col("_n"))).over(within))

    def level(totals: DataFrame, group: list[str], by: str, to: str) -> DataFrame:
        """What lies before each bucket of a group: rows and the number of the last broken."""
        earlier = _up_to(Window.partitionBy(*group).orderBy(by), False)
        counted = totals.withColumn(f"{to}_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        placed = counted.withColumn("_last", F.col(f"{to}_n") + F.col("_last"))
        return placed.withColumn(f"{to}_last", F.max("_last").over(earlier))

    def totalled(parts: DataFrame, group: list[str], count: Column) -> DataFrame:
        return parts.groupBy(*group).agg(count.alias("_n"), F.max("_last").alias("_last"))

    smalls = totalled(local, [*keys, "_large", "_small"], F.count(F.lit(1)))
    smalls = level(smalls, [*keys, "_large"], "_small", "_s")
    larges = totalled(smalls, [*keys, "_large"], F.sum("_n"))
    larges = level(larges, keys, "_large", "_l").select(*keys, "_large", "_l_n", "_l_last")
    before = null_safe_join(smalls.select(*keys, "_large", "_small", "_s_n", "_s_last"), larges, [*keys, "_large"])
    joined = null_safe_join(local, before.drop("_large"), [*keys, "_small"])
    ahead = F.col("_l_n") + F.col("_s_n")
    last = F.greatest("_l_last", F.col("_l_n") + F.col("_s_last"), ahead + F.col("_last"))
    since = (ahead + F.col("_n") - F.coalesce(last, F.lit(0))).cast("bigint")
    return joined.select(*rows.columns, since.alias(name))
