"""Connected components of a table of links, by alternating stars; no link or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import forget, saved


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node itself, are tied to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    tied = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component): for every node of a link (a, b) the smallest node that it reaches. Written to the shared folder."""
    now = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links", files)
    mark = None
    while True:
        after = saved(_small_star(_large_star(now).where("a <> b").distinct()), "links", files)
        forget(now)
        now = after
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = seen
