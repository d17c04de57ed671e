"""Connected components of a link table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchwell.llm.common import written


def _settled(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table in the shared folder, and a summary that tells two tables apart."""
    links = written(links, "links")
    code = F.xxhash64("a", "b").cast("decimal(20,0)")
    return links, tuple(links.agg(F.count("*"), F.sum(code)).first())


def _least(links: DataFrame, node: str, other: str) -> DataFrame:
    """Of each node the least of itself and its neighbours; aggregated before it is shuffled."""
    least = links.groupBy(node).agg(F.min(other).alias("least"))
    return least.select(node, F.least(node, "least").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; the root is the component's least node.

    Alternating stars: a large star ties a node's larger neighbours to the least node it knows, a
    small star ties the smaller ones and the node itself. Both keep components and end in stars.
    Each round is written to the shared folder, so that lineage stays short. A hot node costs
    rows, not a task: neighbours are aggregated in parts and joins on it are split by Spark.
    Null ends are no links; a node linked to itself alone has no row."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links, before = _settled(links.distinct())
    while True:
        both = links.union(links.select("b", "a"))
        larger = both.join(_least(both, "a", "b"), "a").where("b > a")
        large = larger.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        star = large.join(_least(large, "a", "b"), "a")
        small = star.select(F.col("b").alias("a"), F.col("least").alias("b")).union(star.select("a", F.col("least").alias("b")))
        links, now = _settled(small.where("a <> b").distinct())
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
