"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import durable
from sparkloom.storage import forget


def _settled(e: DataFrame) -> bool:
    """Whether the edges are stars: each node has one edge down, to a node that has none."""
    twice = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    on = e.join(e.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return twice.unionByName(on).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: of one type that has an order); the root is the least node of its component.

    Each step groups and joins by node, so a node of many neighbours is an ordinary skewed key that AQE can split.
    The edges are cut from their lineage in the shared folder after each round, and the round before is removed.
    """
    e = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, e = e, durable(small)
        forget(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
