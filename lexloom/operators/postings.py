"""Stored posting lists for symbol search: which names hold a gram.

A table of (gram, name_key) in buckets by gram, sorted by gram inside each, so that a search opens only the buckets of the grams that it
asks for and skips the row groups of others. It is kept current by appending the names that are new; a name that no file
defines any more stays listed, and drops out where found names meet their definitions, until compacted() writes the lists anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.index import GRAM, grams

BUCKETS = 64  # about one for every 128 MB of the table


def _bucket(gram: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def listed(names: DataFrame, buckets: int) -> DataFrame:
    """names (name_key) to gram, name_key, bucket."""
    return names.select(F.explode(grams("name_key")).alias("gram"), "name_key").withColumn("bucket", _bucket("gram", buckets))


def _write(names: DataFrame, path: str, buckets: int, mode: str) -> None:
    # the empty gram lists every name: it is dealt out by name, too, so that no task writes all of them
    salt = F.when(F.col("gram") == "", F.pmod(F.xxhash64("name_key"), F.lit(buckets))).otherwise(0)
    listed(names, buckets).repartition("bucket", salt).sortWithinPartitions("bucket", "gram").write.mode(mode).partitionBy("bucket").parquet(path)


def write_postings(defs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    _write(defs.select("name_key").distinct(), path, buckets, "overwrite")


def read_postings(spark: SparkSession, path: str, buckets: int, only: DataFrame | None = None) -> DataFrame:
    """The lists, or those of the buckets that the grams in `only` (gram) fall into: at most all buckets come to the driver."""
    p = spark.read.schema("gram string, name_key string, bucket int").parquet(path)
    if only is None:
        return p
    wanted = [r[0] for r in only.select(_bucket("gram", buckets)).distinct().collect()]
    return p.where(F.col("bucket").isin(wanted))


def extend_postings(spark: SparkSession, path: str, changed: DataFrame, buckets: int = BUCKETS) -> None:
    """Append the names of changed definitions that are not listed yet. Run twice, it appends nothing the second time."""
    empty = spark.sql("select '' as gram")
    there = read_postings(spark, path, buckets, empty).where("gram = ''").select("name_key")
    new = changed.select("name_key").distinct().join(there, "name_key", "left_anti")
    if not new.isEmpty():
        _write(new, path, buckets, "append")


def compacted(spark: SparkSession, path: str, defs: DataFrame, target: str, buckets: int = BUCKETS) -> None:
    """The lists of the names that are still defined, written anew."""
    names = read_postings(spark, path, buckets, spark.sql("select '' as gram")).where("gram = ''").select("name_key").distinct()
    _write(names.join(defs.select("name_key").distinct(), "name_key", "left_semi"), target, buckets, "overwrite")


def search(queries: DataFrame, defs: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """index.symbol_search() by stored lists: queries (req_id, query) to req_id, name, uri, line."""
    q = queries.where("query is not null").select("req_id", F.lower("query").alias("_q"))
    q = q.withColumn("gram", F.when(F.length("_q") <= GRAM, F.col("_q")).otherwise(F.substring("_q", -GRAM, GRAM)))
    p = read_postings(queries.sparkSession, path, buckets, q).withColumnRenamed("gram", "_gram")
    found = q.join(p, (F.col("gram") == F.col("_gram")) & (_bucket("gram", buckets) == F.col("bucket"))).where(F.contains("name_key", "_q"))
    return found.select("req_id", "name_key").distinct().join(defs, "name_key").select("req_id", "name", "uri", "line")
