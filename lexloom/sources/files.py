"""Scans of source files into (uri, text).

`scan` goes through a Python data source, because Spark's own file sources hide files whose name starts with "." or "_" and
give no row for an empty file, which must still purge its old definitions. It reads any file system that Arrow knows by a
path's scheme. The driver lists folders only until there are enough of them to deal out; each task then lists and reads
its own. Globs without "**" are expanded as a frontier, a table of paths: each component of the patterns is a step, in which tasks list the
folders they have been dealt, and the files that are left are dealt out and read in the same way. `scan_fast` is Spark's text source for trees that have neither hidden nor empty files.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator
from functools import cached_property
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexloom.schemas import FILES
from lexloom.sources.globs import META, SCHEME, components, listed, or_none, split_pattern, to_regex, whole_regex

EXTENSION = ".cfc"


def file_uri(path: str) -> str:
    return "file://" + os.path.abspath(path)


def is_component(path: str) -> bool:
    return os.path.splitext(os.path.basename(path))[1].lower() == EXTENSION or os.path.basename(path).lower() == EXTENSION


def opened(path: str) -> tuple[arrow_fs.FileSystem, str, str]:
    """A path's file system, the path on it, and what makes such a path a uri again."""
    if m := SCHEME.match(path):
        fs, inner = arrow_fs.FileSystem.from_uri(path if m[1] != "file://" else "file://" + quote(path[7:]))
        return fs, inner, "file://" if m[1] == "file://" else m[1] if inner else path
    return arrow_fs.LocalFileSystem(), os.path.abspath(path), "file://"


class Entry:
    """One of the scan's paths: a folder or the part of a "**" glob below its folder, a file, or a glob of other kinds."""

    def __init__(self, path: str):
        split = split_pattern(path)
        self.suffix = self.glob = None
        self.path, self.files = path, None
        if split is not None:
            self.path, self.suffix = split
        elif META.search(SCHEME.sub("", path)) and self.kind(path) == arrow_fs.FileType.NotFound:
            self.glob = opened(path)[1]
        elif self.kind(path) == arrow_fs.FileType.File:
            self.files = [opened(path)[1]]

    @staticmethod
    def kind(path: str) -> arrow_fs.FileType:
        try:
            fs, inner, _ = opened(path)
            return fs.get_file_info(inner).type
        except OSError:
            return arrow_fs.FileType.NotFound

    @cached_property
    def root(self) -> str:
        return opened(self.path)[1].rstrip("/")

    @cached_property
    def base_name(self) -> re.Pattern | None:
        """What a file's base name must be; None for any."""
        regex = or_none(self.suffix) if self.suffix else None
        return None if not self.suffix else re.compile(f"(?s:{regex})" if regex is not None else r"(?!)")

    @cached_property
    def whole_name(self) -> re.Pattern:
        """What the path of a glob's file must be."""
        regex = whole_regex(self.glob)
        return re.compile(f"(?s:{regex})" if regex is not None else r"(?!)")

    def takes(self, file: str) -> bool:
        if self.glob is not None:
            return self.whole_name.fullmatch(file) is not None
        if self.files is not None:
            return file in self.files
        return file.startswith(self.root + "/") and (self.base_name is None or self.base_name.fullmatch(posixpath.basename(file)) is not None)


class Share(InputPartition):
    """Of one entry: folders to walk whole, and files."""

    def __init__(self, entry: int, folders: list[str], files: list[str]):
        self.entry, self.folders, self.files = entry, folders, files


class SourceFilesReader(DataSourceReader):
    def __init__(self, entries: list[Entry], share: int, least: int = 64):
        self.entries, self.share, self.least = entries, share, least

    def partitions(self) -> list[Share]:
        out = []
        for n, e in enumerate(self.entries):
            if e.glob is not None:
                continue
            fs, _, _ = opened(e.path)
            files, folders = list(e.files or []), [] if e.files is not None else [e.root or "/"]
            while folders and len(folders) < self.least:  # a level at a time, until there are enough to deal out
                deeper = []
                for f in folders:
                    below, here = listed(fs, f)
                    deeper += below
                    files += here
                if not deeper:
                    folders = []
                    break
                folders = deeper
            files = [f for f in files if is_component(f)]
            out += [Share(n, [], files[i : i + self.share]) for i in range(0, len(files), self.share)]
            size = max(1, len(folders) // (4 * self.least))
            out += [Share(n, folders[i : i + size], []) for i in range(0, len(folders), size)]
        return out or [Share(0, [], [])]

    def read(self, partition: Share) -> Iterator[tuple[str, str]]:
        if not partition.folders and not partition.files:
            return
        entry = self.entries[partition.entry]
        fs, _, prefix = opened(entry.path)
        files, folders = list(partition.files), list(partition.folders)
        while files or folders:
            if not files:
                below, files = listed(fs, folders.pop())
                folders += reversed(below)
                continue
            for f in files:
                if entry.takes(f) and (text := text_of(self.entries, partition.entry, fs, f)) is not None:
                    yield prefix + f, text
            files = []


def text_of(entries: list[Entry], n: int, fs: arrow_fs.FileSystem, file: str) -> str | None:
    """A file that entry n takes, if it is a component that can be read and that no earlier entry takes."""
    if not is_component(file) or any(e.takes(file) for e in entries[:n]):
        return None
    try:
        with fs.open_input_stream(file) as stream:
            return stream.read().decode("utf-8", "replace")
    except OSError:
        return None


def frontier(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    """entry, path of what the entries' globs name. Literal components are passed on as they are, also where nothing is there."""
    steps = {n: components(e.glob) for n, e in enumerate(entries) if e.glob is not None and whole_regex(e.glob) is not None}
    rows = [(n, "/" if entries[n].glob.startswith("/") else "") for n in steps]
    out = spark.createDataFrame(rows, "entry int, path string")

    def step(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: list[tuple[int, str]] = []
                for n, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    parts = steps[n]
                    if k >= len(parts):
                        found.append((n, path))
                    elif not META.search(parts[k]):
                        found.append((n, posixpath.join(path, parts[k])))
                    else:
                        name = re.compile(f"(?s:{to_regex(parts[k])})")
                        folders, files = listed(opened(entries[n].path)[0], path or ".")
                        found += [(n, p) for p in (folders if k + 1 < len(parts) else files) if name.fullmatch(posixpath.basename(p))]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int32()), pa.array([p for _, p in found], pa.string())], ["entry", "path"])

        return run

    dealt = True
    for k in range(max(map(len, steps.values()), default=0)):
        lists = any(k < len(p) and META.search(p[k]) for p in steps.values())
        if lists and not dealt:
            out = out.repartition("entry", "path")
        out = out.mapInArrow(step(k), "entry int, path string")
        dealt = dealt and not lists
    return out.repartition("entry", "path")


def read_frontier(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    """uri, text of the globs' files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, _, prefix = opened(entries[n].path)
                if (text := text_of(entries, n, fs, path)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([prefix + path]), pa.array([text])], ["uri", "text"])

    return frontier(spark, entries).mapInArrow(run, FILES)


class SourceFiles(DataSource):
    """Options: paths (one a line: files, folders or globs), share (files a partition)."""

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> SourceFilesReader:
        entries = [Entry(p) for p in filter(None, self.options.get("paths", "").split("\n"))]
        return SourceFilesReader(entries, int(self.options.get("share", "64")))


def scan(spark: SparkSession, paths: list[str], share: int = 64) -> DataFrame:
    """uri, text of the component files that the files, folders and globs name, each once. Missing ones are passed over."""
    entries = [Entry(p) for p in filter(None, paths)]
    out = None
    if any(e.glob is None for e in entries) or not entries:
        spark.dataSource.register(SourceFiles)
        out = spark.read.format("source_files").option("paths", "\n".join(paths)).option("share", str(share)).load()
    if any(e.glob is not None for e in entries):
        globbed = read_frontier(spark, entries)
        out = globbed if out is None else out.unionByName(globbed)
    return out


def scan_workspace(spark: SparkSession, folders: list[str], globs: list[str], roots: list[str]) -> DataFrame:
    """Configured folders win over the editor's roots, and globs over whole folders."""
    return scan(spark, (globs or folders) if folders else roots)


def scan_fast(spark: SparkSession, folders: list[str]) -> DataFrame:
    roots = sorted({f.rstrip("/") for f in folders if Entry.kind(f) != arrow_fs.FileType.NotFound})
    apart = [f for f in roots if not any(f.startswith(r + "/") for r in roots)]  # a folder inside another would be read twice
    if not apart:
        return spark.createDataFrame([], FILES)
    text = spark.read.text(apart, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[cC][fF][cC]")
    return text.select(F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/*", "file:///").alias("uri"), F.col("value").alias("text"))
