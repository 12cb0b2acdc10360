"""Connected components of links that no machine can hold: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm._common import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u, v, u <> v, each once. Hangs neighbours of each node onto its smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else both.where("v < u")
    least = side.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = side.join(least, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.where("m <> u").select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """links: a, b. Gives node, component (its smallest member) for every node that has a link.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path."""
    now = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = None
    while True:
        now = materialise(_star(_star(now, True), False), name)
        # every node hangs on its component's smallest exactly when nothing moves any more
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = (row.n, row.h)
