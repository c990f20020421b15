"""Numbering rows in an order that is given, inside keys of any size.

Rows are dealt out by ranges of (keys, order), so that a hot key is cut where its order allows, and repeated rows, too, by a
number of their own. Each task sorts its range, and a row's place in it is written with the row. Of each task's part of a key
one row of counts is left; a running total of these gives the rows that come before. Nothing is collected, and no window sees
more rows of a key than there are tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import fresh, small, written

PLACE_BITS = 33  # Spark's own: task number above, place in the task below


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality of columns by pairs of names, nulls equal to nulls."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[a].eqNullSafe(right[b])
    return out


def numbered(spark: SparkSession, df: DataFrame, keys: list[str], order: list[Column], number: str = "number", of: str = "of") -> DataFrame:
    """df with each row's number (from 0) in the given order among the rows of its keys, and the number of these. df must
    be a table: its tasks have to meet the same rows each time. Rows that are equal in keys and order come in any order."""
    salt, place, task, at, least, n, before, total = fresh(df, "_salt", "_place", "_task", "_at", "_least", "_n", "_before", "_total")
    by = [*(F.col(k).asc() for k in keys), *order, F.col(salt).asc()]
    ranged = df.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    rows, _ = written(spark, ranged.drop(salt).withColumn(place, F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn(task, F.shiftright(place, PLACE_BITS)).withColumn(at, F.col(place).bitwiseAND((1 << PLACE_BITS) - 1)).drop(place)
    key_names = fresh(rows, *(f"_key_{k}" for k in keys), "_of_task")
    parts = rows.groupBy(*(F.col(k).alias(name) for k, name in zip(keys, key_names)), F.col(task).alias(key_names[-1])).agg(F.min(at).alias(least), F.count("*").alias(n))
    whole = Window.partitionBy(*key_names[:-1])
    parts = parts.select(*key_names, least, (F.sum(n).over(whole.orderBy(key_names[-1])) - F.col(n)).alias(before), F.sum(n).over(whole).alias(total))
    parts = small(spark, parts, "parts")  # a row a task and key in it
    out = rows.join(parts, same(rows, parts, [*zip(keys, key_names), (task, key_names[-1])]))
    return out.select(*df.columns, (F.col(at) - F.col(least) + F.col(before)).alias(number), F.col(total).alias(of))
