"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import dropped, written


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links (a, b: two different longs) to (node, root), root being the smallest node reached; every node of a link is there.

    Each step is written to the shared folder, so that lineage stays short and a lost executor costs one step; so are the
    minima that it joins with, since a join of two scans is dealt anew and can split the rows of a node with very many
    links. The number of steps grows with the logarithm of the longest chain. Only row count and checksum reach the driver.
    """
    state, path = written(spark, links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, low_path = written(spark, both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large, large_path = written(spark, both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large")
        dropped(spark, low_path)
        low, low_path = written(spark, large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        new, new_path = written(spark, small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        for old in (low_path, large_path):
            dropped(spark, old)
        # decimals, so that the sum of hashes cannot overflow
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        dropped(spark, path)
        state, path = new, new_path
        if now == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
