"""The folder that driver and executors share, for tables and files made on the way; and what is sent to Python processes whole."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import SparkSession

from lexloom.sources.files import opened


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, as in tests, one of our own for this session, but only if driver
    and executors are one process: on a cluster a local folder would be another one on each machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = os.path.join(tempfile.gettempdir(), f"lexloom-{os.getpid()}")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = "file://" + own
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_OWN: list[str] = []


def own_folder(spark: SparkSession, name: str) -> str:
    """A folder of this process's own on the shared file system, for what is written on the way and then read by a result; it is
    deleted when the process ends, as the result may be read until then."""
    if not _OWN:
        atexit.register(clear_own)
    _OWN.append(f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}")
    return _OWN[-1]


def clear_own() -> None:
    while _OWN:
        try:
            fs, path, _ = opened(_OWN.pop())
            fs.delete_dir(path)
        except (OSError, ValueError):  # never written, or on a file system that only Spark can reach
            continue


@contextmanager
def by_value(*modules: str) -> Iterator[None]:
    """What is sent from these modules in this block takes their code along: the processes that Spark starts beside the driver for
    streams need not find this package."""
    for m in modules:
        cloudpickle.register_pickle_by_value(sys.modules[m])
    try:
        yield
    finally:
        for m in modules:
            cloudpickle.unregister_pickle_by_value(sys.modules[m])
