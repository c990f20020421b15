"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A document's shard is a function of its doc_id and the shard count alone, so no ring table is kept, and going from n to
n + 1 shards moves only the 1/(n + 1) of the keys that the new shard takes.

Slots (a gapless numbering inside each shard) need no order, so that no row is moved to get one: each task of the scan counts
its own rows of each shard, and the rows are written with these counts; a running total of the tasks' counts then gives
each task its first slot in each shard. A hot or null doc_id is numbered by the tasks that read it. Text never leaves the
scan, which is made once.

Defined cases: a null text has size 1 and crc 0; null doc_ids share one key and so one shard; repeated rows all get slots
of their own; an empty table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import fresh, table, written

MULTIPLIER, ADDEND = np.uint64(2862933555777941757), np.uint64(1)  # fixed values of the published generator


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard 0 to n - 1 of each unsigned 64-bit key."""
    key, last, ahead = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    while len(going):
        last[going] = ahead[going]
        key[going] = key[going] * MULTIPLIER + ADDEND
        scale = float(1 << 31) / ((key[going] >> np.uint64(33)).astype(np.float64) + 1)
        ahead[going] = ((last[going] + 1) * scale).astype(np.int64)
        going = going[ahead[going] < n]
    return last.astype(np.int32)


def numbered(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """df with a struct column `place`: shard (of n), grown_shard (of n + 1), the task, and the row's place among that task's rows
    of its shard. To be written at once, as a task that is run again may meet its rows in another order."""

    @F.arrow_udf("shard int, grown_shard int, task int, at long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        task, before = TaskContext.get().partitionId(), np.zeros(n, np.int64)
        for b in batches:
            keys = b.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            shard = jump_hash(keys, n)
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=n)
            at = np.empty(len(keys), np.int64)
            at[order] = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(before, count)
            before += count
            yield pa.StructArray.from_arrays([pa.array(shard), pa.array(jump_hash(keys, n + 1)), pa.array(np.full(len(keys), task, np.int32)), pa.array(at)], ["shard", "grown_shard", "task", "at"])

    (place,) = fresh(df, "place")
    return df.withColumn(place, run.asNondeterministic()(F.xxhash64(key)))


def sharded(spark: SparkSession, df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """df's columns with shard, grown_shard and slot, as columns of these names or, where df has one itself, with "_" behind it."""
    (place,) = fresh(df, "place")
    rows, _ = written(spark, numbered(df, n, key), "numbered")
    counts = rows.groupBy(F.col(place)["shard"].alias("s"), F.col(place)["task"].alias("t")).agg(F.count("*").alias("n"))
    firsts = counts.select("s", "t", (F.sum("n").over(Window.partitionBy("s").orderBy("t")) - F.col("n")).alias("first"))  # a row a task and shard
    s, t, first = fresh(rows, "_s", "_t", "_first")
    firsts = firsts.toDF(s, t, first)
    out = rows.join(firsts, (rows[place]["shard"] == F.col(s)) & (rows[place]["task"] == F.col(t)))
    shard, grown, slot = fresh(df, "shard", "grown_shard", "slot")
    return out.select(*df.columns, rows[place]["shard"].alias(shard), rows[place]["grown_shard"].alias(grown), (F.col(first) + rows[place]["at"]).alias(slot))


def op9(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharded(spark, docs, shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
