"""What the operators share: reading a table, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.work import shared_dir


_HELD: list = [None, None]


def held(key, make):
    """What a Python worker keeps from task to task for one operator: made anew, and the last operator's let go, where the
    key differs. So the operators of a pipeline, which share workers, never add up their tables."""
    if _HELD[0] != key:
        _HELD[:] = [None, None]
        _HELD[:] = [key, make()]
    return _HELD[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Written(threading.local):
    """The tables that this thread has written and not deleted: queries that run beside each other never clear each other's."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = Written()


def written(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it again: later steps then depend on the files alone."""
    path = f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _WRITTEN.paths.append(path)
    return spark.read.schema(schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that written() made and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _WRITTEN.paths:
        _WRITTEN.paths.remove(path)


def mark() -> int:
    """For cleared(): the tables written so far."""
    return len(_WRITTEN.paths)


def cleared(spark: SparkSession, since: int, *kept: str) -> None:
    """Delete the tables written since a mark, but for those that a result still reads."""
    for path in [p for p in _WRITTEN.paths[since:] if p not in kept]:
        dropped(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


SMALL = 200_000  # rows of a few numbers


def small(spark: SparkSession, df: DataFrame, name: str, most: int = SMALL) -> DataFrame:
    """df as a table of its own, with the hint to broadcast it if it turns out to have at most so many rows; else joins deal it out."""
    df, _ = written(spark, df, name)
    return F.broadcast(df) if df.count() <= most else df
