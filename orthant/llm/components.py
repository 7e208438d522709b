"""Connected components by alternating large-star and small-star rounds, entirely in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, skew_join


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return skew_join(both, least, ["u"], "n", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Edges lead from u to smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = skew_join(edges, least, ["u"], "n", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v for each node u that isn't the least of its component: v is that least node.

    edges: bigint columns u and v. The rounds end once every edge leads to its component's least node, which is
    seen by the edge set staying the same (row count and sum of hashes). A node with more than a 1024th of the edges
    is joined by broadcast (a round has no more edges than the one before), so a hub is no hot key.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = digest(now)
    while before[0]:
        stars = materialize(_large_star(now, before[0]), "stars")
        last, now = now, materialize(_small_star(stars, before[0]), "edges")
        discard(last, stars)
        after = digest(now)
        if after == before:
            break
        before = after
    return now
