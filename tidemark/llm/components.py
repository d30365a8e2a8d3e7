"""Connected components of a table of links, by alternating large and small stars.

Each round is a few aggregates and joins over the links; a node of a very high degree is one row of an aggregate that combines before the
shuffle, and one side of a join that Spark may split.  Rounds are written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) of integers to (node, component): the least node that can be reached. Nodes without links do not appear."""
    current = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    current, seen = materialise(current, "links"), None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        current = materialise(_small_star(_large_star(current)), "links")
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
