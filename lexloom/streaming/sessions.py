"""Live sessions: how many there are after each that begins or ends, and when there are none for the first time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096  # numbers of a block, on each level


def before_blocks(sums: DataFrame, last: int, block: int) -> DataFrame:
    """sums (b, s: a row a block, b from 0 to last) with what all blocks before it add up to: inside its own block of blocks by a
    window, and before that by the same on the level above, until one block holds them all."""
    up = sums.withColumn("_up", F.floor(F.col("b") / block))
    own = F.sum("s").over(Window.partitionBy("_up").orderBy("b")) - F.col("s")
    up = up.withColumn("_own", own)
    if last < block:
        return up.select("b", F.col("_own").alias("before"))
    above = up.groupBy(F.col("_up").alias("b")).agg(F.sum("s").alias("s"))
    above = before_blocks(above, last // block, block).select(F.col("b").alias("_b"), F.col("before").alias("_before"))
    return up.join(above, F.col("_up") == F.col("_b")).select("b", (F.col("_before") + F.col("_own")).alias("before"))


def live(changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """changes (seq: different longs, delta: 1 or -1) with live, the running count. A tree of sums: each block adds up its own changes, and
    what comes before a block is added up in the same way on the level above, so that no task holds more than a block of anything."""
    low, high = changes.agg(F.min("seq"), F.max("seq")).first()
    low, high = low or 0, high or 0
    c = changes.withColumn("_block", F.floor((F.col("seq") - low) / block))
    sums = c.groupBy(F.col("_block").alias("b")).agg(F.sum("delta").alias("s"))
    before = before_blocks(sums, (high - low) // block, block).select(F.col("b").alias("_b"), "before")
    own = F.sum("delta").over(Window.partitionBy("_block").orderBy("seq"))
    return c.withColumn("_own", own).join(before, F.col("_block") == F.col("_b")).select("seq", "delta", (F.col("before") + F.col("_own")).alias("live"))


def first_without(changes: DataFrame) -> DataFrame:
    """seq of the end of a session that leaves none; at most one row."""
    return live(changes).where("live = 0 and delta < 0").agg(F.min("seq").alias("seq")).where("seq is not null")
