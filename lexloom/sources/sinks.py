"""Sinks: the catalog and the index as tables, and texts as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.catalog import in_order, placed
from lexloom.sources.files import opened


def write_catalog(catalog: DataFrame, path: str) -> None:
    """The catalog in its order, tags first, each entry with its place in it."""
    in_order(placed(catalog)).write.mode("overwrite").parquet(path)


def write_index(defs: DataFrame, table: str, buckets: int = 64) -> None:
    """The index as a table bucketed by name, so that lookups by name need no exchange of it. The number of buckets is for the
    table's size: about one for every 128 MB."""
    defs.write.mode("overwrite").bucketBy(buckets, "name_key").sortBy("name_key").saveAsTable(table)


def write_files(files: DataFrame, root: str) -> int:
    """files (path, text) as files below a root on any Arrow file system; returns their number. A file that is there is
    replaced, so that a task may be run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base, _ = opened(root)
        n = 0
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = f"{base.rstrip('/')}/{path}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(target) as out:
                    out.write((text or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return files.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
