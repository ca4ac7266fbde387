"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import drop, store


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(directed: DataFrame, keep) -> DataFrame:
    """Each node's kept neighbours, and the node itself, get the smallest of them all as their parent; with repeats."""
    least = directed.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
    met = directed.join(least, F.col("a") == F.col("u"))
    return met.filter(keep & (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``); the component is its smallest node.

    Rounds grow with the logarithm of the longest path.  Each round is written to the shared folder, so a lost
    executor costs one round at most; nothing but the answer whether it was the last comes to the driver.
    """
    e, last = edges.filter("a <> b").select("a", "b"), None
    while True:
        large = _star(_both_ways(e), F.col("b") > F.col("a"))
        small = _star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), F.lit(True))
        e = store(small.distinct(), "cc-round")
        if last is not None:
            drop(last)
        last = e
        # done when every node has one parent, and no parent has one
        ends = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").isEmpty():
            break
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
