"""Connected components of a table of links, by alternating large-star and small-star rounds.

A round is two aggregations with partial sums and two equi-joins, so a node with
very many links is split by Spark like any skewed join key and no task gathers
the links of a node.  Each round is written to the shared folder, and
the one before it goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u, v (u > v).  large: every larger neighbour of u gets u's least; else u and its smaller neighbours do."""
    both = links if not large else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    j = both.join(least, F.col("u") == F.col("k"))
    out = j.where(F.col("v") > F.col("u")).select("v", "m") if large else j.select("v", "m").unionByName(least.select(F.col("k").alias("v"), "m"))
    return out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long, any order, repeats and self-links allowed, no nulls).

    One row for each node that has a link to another: node, root (the least node
    of its component).
    """
    now = common.kept(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    old, new = None, mark(now)
    while new != old and new[0]:
        before, large = now, common.kept(_star(now, True), "large")
        now = common.kept(_star(large, False), "small")
        common.dropped(before, large)
        old, new = new, mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
