"""Connected components by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, scratch


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``edges(a long, b long)`` to (node, component) of every node but the smallest
    of its component: the smallest node that it reaches.

    Null ends and loops are ignored.  Minima are pre-aggregated where they are read, and joins
    read written tables only, so Spark can split a node of very many edges.  The steps halve
    distances, so ``most`` of them would do for any graph; beyond it an error says so."""
    spark = edges.sparkSession
    with scratch(spark) as keep:
        now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        for _ in range(most):
            if _settled(now):
                break
            with scratch(spark) as keep_step:
                both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
                low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "large-star")
                # Large star: every larger neighbour is tied to the smallest.
                now = saved(both.join(low, "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
                low = saved(now.groupBy("u").agg(F.min("v").alias("m")), "small-star")
                # Small star: smaller neighbours and the node itself are tied to the smallest of them.
                tied = now.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                now = keep_step(saved(tied.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges"))
        else:
            raise RuntimeError("the components did not settle")
        keep(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars already: each node is tied to one, which is tied to none."""
    once = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    return once.filter("n > 1").isEmpty() and once.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
