"""The change feed as a stream source: notifications of editors, in lots.

A feed is a folder of lots. A lot is a folder that one job writes, lines of JSON in any number of files, and that is complete once
"_SUCCESS" lies in it. Lots are taken in order of their names, and none is passed over: a lot that is not complete yet holds back
those behind it. The stream's offset is the name of the last lot taken, so that a query that goes on from its checkpoint
reads exactly the lots that it has not read.

All that a micro-batch takes is planned as shares of at most SHARE bytes: large files are cut, at the next line's beginning, so
that a long backlog makes more tasks and not larger ones. The driver lists folders and file sizes only.

A line is {"seq", "at" (milliseconds), "session_id", "message"}, the message a JSON-RPC notification. decoded() makes change rows of
it with column functions. Lines that are no JSON, and notifications of other methods, give no row.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lexloom.schemas import LINES, NOTIFICATION
from lexloom.sources import files, globs
from lexloom.sources.files import opened
from lexloom.sources.work import by_value

NAME, DONE, SHARE, LINES_AT_ONCE = "lexloom_changes", "_SUCCESS", 32 << 20, 4096


class Piece(InputPartition):
    """Of a lot's file, the lines that begin from `start` on and before `end`."""

    def __init__(self, lot: str, path: str, start: int, end: int):
        self.lot, self.path, self.start, self.end = lot, path, start, end


class ChangeReader(DataSourceStreamReader):
    def __init__(self, path: str, share: int):
        self.path, self.share = path, share

    def _below(self, folder: str) -> list[arrow_fs.FileInfo]:
        fs, root, _ = opened(self.path)
        at = f"{root.rstrip('/')}/{folder}".rstrip("/")
        return sorted(fs.get_file_info(arrow_fs.FileSelector(at, allow_not_found=True)), key=lambda i: i.base_name)

    def _lots(self, after: str) -> list[str]:
        return [i.base_name for i in self._below("") if i.type == arrow_fs.FileType.Directory and i.base_name > after and i.base_name[0] not in "._"]

    def initialOffset(self) -> dict:
        return {"lot": ""}

    def latestOffset(self) -> dict:
        fs, root, _ = opened(self.path)
        last = ""
        for lot in self._lots(""):
            if fs.get_file_info(f"{root.rstrip('/')}/{lot}/{DONE}").type == arrow_fs.FileType.NotFound:
                break
            last = lot
        return {"lot": last}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for lot in self._lots(start["lot"]):
            if lot > end["lot"]:
                break
            for f in self._below(lot):
                if f.type == arrow_fs.FileType.File and f.base_name[0] not in "._":
                    out += [Piece(lot, f.path, at, min(at + self.share, f.size)) for at in range(0, f.size, self.share)]
        return out or [Piece("", "", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.start:
            return
        fs, _, _ = opened(self.path)
        with io.BufferedReader(fs.open_input_file(partition.path)) as f:
            at = partition.start
            if at:  # what is left of the line before belongs to the share before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            lines: list[bytes] = []
            while at < partition.end and (line := f.readline()):
                at += len(line)
                lines.append(line.rstrip(b"\n"))
                if len(lines) == LINES_AT_ONCE:
                    yield self._batch(partition.lot, lines)
                    lines = []
            if lines:
                yield self._batch(partition.lot, lines)

    @staticmethod
    def _batch(lot: str, lines: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lot] * len(lines)), pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], ["lot", "line"])

    def commit(self, end: dict) -> None:
        """Lots stay where they are."""


class Changes(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options["path"], int(self.options.get("share", SHARE)))


def lines(spark: SparkSession, path: str, share: int = SHARE) -> DataFrame:
    """The feed's lines as a stream: lot, line."""
    with by_value(__name__, files.__name__, globs.__name__):
        spark.dataSource.register(Changes)
    return spark.readStream.format(NAME).option("path", path).option("share", share).load()


def decoded(feed: DataFrame) -> DataFrame:
    """lines (line) to changes: seq, at, session_id, op, uri, changes. A change of folders gives a row for each folder, those that
    are removed first."""
    m = feed.select(F.from_json("line", NOTIFICATION).alias("n")).select("n.seq", "n.at", "n.session_id", "n.message.method", "n.message.params.*")
    none = F.expr("cast(null as array<string>)")
    row = lambda op, uri, changes=none: F.struct(F.lit(op).alias("op"), uri.alias("uri"), changes.alias("changes"))
    document = F.col("textDocument.uri")
    of = lambda folders, op: F.transform(F.coalesce(folders, F.expr("cast(array() as array<struct<uri:string,name:string>>)")), lambda f: row(op, f["uri"]))
    rows = (
        F.when(F.col("method") == "textDocument/didOpen", F.array(row("open", document, F.array("textDocument.text"))))
        .when(F.col("method") == "textDocument/didChange", F.array(row("change", document, F.transform("contentChanges", lambda c: c["text"]))))
        .when(F.col("method") == "textDocument/didClose", F.array(row("close", document)))
        .when(F.col("method") == "workspace/didChangeWorkspaceFolders", F.concat(of(F.col("event.removed"), "folder_removed"), of(F.col("event.added"), "folder_added")))
    )
    return m.select("seq", "at", "session_id", F.explode(rows).alias("r")).select("seq", "at", "session_id", "r.*")


def line(seq: Column, at: Column, session_id: Column, op: Column, uri: Column, changes: Column) -> Column:
    """A feed's line for one change of a document or folder."""
    method = F.when(op == "open", "textDocument/didOpen").when(op == "change", "textDocument/didChange").when(op == "close", "textDocument/didClose").otherwise("workspace/didChangeWorkspaceFolders")
    folder = lambda which: F.when(op == which, F.array(F.struct(uri.alias("uri"), F.lit("").alias("name"))))
    params = F.struct(
        F.when(~op.startswith("folder"), F.struct(uri.alias("uri"), F.when(op == "open", F.element_at(changes, -1)).alias("text"))).alias("textDocument"),
        F.when(op == "change", F.transform(changes, lambda t: F.struct(t.alias("text")))).alias("contentChanges"),
        F.when(op.startswith("folder"), F.struct(folder("folder_added").alias("added"), folder("folder_removed").alias("removed"))).alias("event"),
    )
    message = F.struct(F.lit("2.0").alias("jsonrpc"), method.alias("method"), params.alias("params"))
    return F.to_json(F.struct(seq.alias("seq"), at.alias("at"), session_id.alias("session_id"), message.alias("message")))


def put(rows: DataFrame, path: str, lot: int) -> None:
    """Write lines (line) as the feed's lot of this number."""
    rows.select("line").write.text(f"{path}/{lot:012d}")
