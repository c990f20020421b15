"""The change feed: open documents, and the index kept current, as Structured Streaming.

changes (seq, session_id, op, uri, changes). Opening and changing set a document's text, of several changes the last; a change
without any does nothing; closing removes the document but leaves the index. Documents belong to a session, the index to
all. folder_removed and folder_added have a folder's uri: the one drops its files from the index, unless it is configured,
the other scans it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.extract import function_defs
from lexloom.operators.index import accepts, upserted, without_prefix
from lexloom.schemas import DOCUMENTS, FUNCTION_DEFS, MANIFEST
from lexloom.sources.files import scan, scan_workspace

DOCUMENT_OPS, KEYS = ("open", "change", "close"), ("session_id", "uri")


def last_changes(changes: DataFrame, *keys: str) -> DataFrame:
    """keys, op, text, seq: what each document's last effective change left. Arrival order decides, not versions."""
    text = F.element_at("changes", F.when(F.size("changes") > 0, -1))
    e = changes.withColumn("text", text).where("op = 'close' or text is not null")
    last = e.groupBy(*keys).agg(F.max_by(F.struct("op", "text", "seq"), "seq").alias("c"))
    return last.select(*keys, "c.op", "c.text", "c.seq")


def document_state(changes: DataFrame, *keys: str) -> DataFrame:
    """keys, text, seq of the documents that are open after all changes."""
    return last_changes(changes, *(keys or KEYS)).where("op != 'close'").drop("op")


def applied(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """documents (session_id, uri, text, seq) after a batch of changes."""
    last = last_changes(changes, *KEYS)
    same = documents.session_id.eqNullSafe(last.session_id) & (documents.uri == last.uri)
    return documents.join(last, same, "left_anti").unionByName(last.where("op != 'close'").select(*documents.columns))


def changed_files(changes: DataFrame, folders: list[str], globs: list[str]) -> DataFrame:
    """uri, text: the last text that any session set for each indexed file, closed since or not."""
    return accepts(last_changes(changes.where("op != 'close'"), "uri").select("uri", "text"), folders, globs)


def folders_changed(defs: DataFrame, changes: DataFrame, protected: DataFrame, scan: Callable[[list[str]], DataFrame]) -> DataFrame:
    """The index after folder changes (op: added | removed, uri): removals first, then scans of what was added."""
    defs = without_prefix(defs, changes.where("op = 'removed'"), protected)
    added = [r[0].removeprefix("file://") for r in changes.where("op = 'added'").orderBy("seq").select("uri").collect()]  # a workspace's folders: a handful
    return upserted(defs, scan(added)) if added else defs


class Workspace:
    """Documents and index as tables in BUCKETS by uri under one folder. A micro-batch writes new versions of the buckets that it
    touches, and then a manifest that names the version of every bucket; that last step is what takes effect.

    A version is named by its batch, so a batch that is run again after a failure writes the same one again, and one whose
    manifest is there already is passed over. A new Workspace over the same folder goes on from the last manifest, and
    its feed from the checkpoint that lies beside it. Older versions stay for readers that still use them until vacuum().
    """

    def __init__(self, spark: SparkSession, root: str, folders: list[str] = (), globs: list[str] = (), buckets: int = 64):
        self.spark, self.root, self.folders, self.globs, self.buckets = spark, root.rstrip("/"), list(folders), list(globs), buckets
        self.version, self.current = max(self._versions("manifest"), default=-1), {}
        if self.version >= 0:
            rows = spark.read.schema(MANIFEST).parquet(self._at("manifest", self.version)).collect()  # a row a bucket and table
            self.buckets = next(r.bucket for r in rows if not r.table)
            self.current = {(r.table, r.bucket): r.version for r in rows if r.table}

    # folders of the workspace

    def _at(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/v={version}"

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _below(self, path: str, prefix: str) -> list[int]:
        fs, p = self._path(path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def _versions(self, table: str) -> list[int]:
        """Those that were written whole."""
        done = lambda v: (at := self._path(f"{self._at(table, v)}/_SUCCESS"))[0].exists(at[1])
        return [v for v in self._below(f"{self.root}/{table}", "v=") if done(v)]

    def _bucket(self, uri: Column | str = "uri") -> Column:
        return F.pmod(F.xxhash64(uri), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self._at(table, v)}/bucket={b}" for (t, b), v in sorted(self.current.items()) if t == table and (buckets is None or b in buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, table: str, df: DataFrame, version: int, touched: list[int]) -> None:
        df.withColumn("bucket", self._bucket()).where(F.col("bucket").isin(touched)).write.mode("overwrite").partitionBy("bucket").parquet(self._at(table, version))
        there = set(self._below(self._at(table, version), "bucket="))
        for b in touched:
            self.current.pop((table, b), None)
        self.current.update({(table, b): version for b in there})

    def _commit(self, version: int) -> None:
        rows = [("", self.buckets, version), *((t, b, v) for (t, b), v in sorted(self.current.items()))]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(self._at("manifest", version))
        self.version = version

    # what it holds

    @property
    def documents(self) -> DataFrame:
        return self._read("documents", DOCUMENTS)

    @property
    def defs(self) -> DataFrame:
        return self._read("defs", FUNCTION_DEFS)

    def document(self, session_id: str, uri: str) -> str | None:
        """A session's text of one document; reads its bucket only."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(uri))).first()[0]
        row = self._read("documents", DOCUMENTS, [bucket]).where((F.col("session_id") == session_id) & (F.col("uri") == uri)).first()
        return row and row.text

    # what changes it

    def start(self, documents: DataFrame | None = None, defs: DataFrame | None = None) -> Workspace:
        """The first version."""
        everything = list(range(self.buckets))
        if documents is not None:
            self._write("documents", documents, 0, everything)
        if defs is not None:
            self._write("defs", defs, 0, everything)
        self._commit(0)
        return self

    def initialize(self, roots: list[str] = ()) -> Workspace:
        """The first version, from a scan of the configured folders and globs or else of the editor's roots."""
        return self.start(defs=function_defs(scan_workspace(self.spark, self.folders, self.globs, list(roots))))

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        version = batch_id + 1
        if version <= self.version:
            return
        batch = batch.persist()
        try:
            documents = batch.where(F.col("op").isin(*DOCUMENT_OPS))
            touched = [r[0] for r in documents.select(self._bucket().alias("b")).distinct().collect()]  # at most all buckets
            folders = batch.where(~F.col("op").isin(*DOCUMENT_OPS)).orderBy("seq", F.desc("op")).select("seq", "op", "uri").collect()  # removed before added; a workspace's folders: a handful
            scans = {f.uri: scan(self.spark, [f.uri]).persist() for f in folders if f.op == "folder_added"}
            indexed = sorted({*touched, *self._reached(folders, scans)})
            defs = self._after(self._read("defs", FUNCTION_DEFS, indexed), documents, folders, scans)
            if touched:
                self._write("documents", applied(self._read("documents", DOCUMENTS, touched), documents), version, touched)
            if indexed:
                self._write("defs", defs, version, indexed)
            self._commit(version)
            for s in scans.values():
                s.unpersist()
        finally:
            batch.unpersist()

    def _reached(self, folders: list, scans: dict[str, DataFrame]) -> set[int]:
        """The buckets of the uris that folders bring or take: only these are read whole and written again."""
        uris = [s.select("uri") for s in scans.values()]
        if gone := [f.uri for f in folders if f.op == "folder_removed"]:
            starts = F.lit(False)
            for g in gone:
                starts = starts | F.startswith("uri", F.lit(g))
            uris.append(self.defs.select("uri").where(starts))
        return {r[0] for u in uris for r in u.select(self._bucket().alias("b")).distinct().collect()}  # at most all buckets

    def _after(self, defs: DataFrame, documents: DataFrame, folders: list, scans: dict[str, DataFrame]) -> DataFrame:
        """The index after the changes, those of folders at their place among those of documents."""
        protected = self.spark.createDataFrame([(f,) for f in self.folders], "path string")
        since = None
        for seq, op, uri in [*((f.seq, f.op, f.uri) for f in folders), (None, None, None)]:
            part = documents if since is None else documents.where(F.col("seq") > since)
            part = part if seq is None else part.where(F.col("seq") < seq)
            defs, since = upserted(defs, changed_files(part, self.folders, self.globs)), seq
            if op == "folder_removed":
                defs = without_prefix(defs, self.spark.createDataFrame([(uri,)], "uri string"), protected)
            elif op == "folder_added":
                defs = upserted(defs, scans[uri])
        return defs

    def follow(self, feed: DataFrame, checkpoint: str | None = None) -> StreamingQuery:
        return feed.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint or f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def vacuum(self) -> None:
        """Delete what the last manifest does not name."""
        for table in ("documents", "defs"):
            for v in self._below(f"{self.root}/{table}", "v="):
                kept = {b for (t, b), now in self.current.items() if t == table and now == v}
                for b in self._below(self._at(table, v), "bucket="):
                    if b not in kept:
                        fs, p = self._path(f"{self._at(table, v)}/bucket={b}")
                        fs.delete(p, True)
        for v in self._below(f"{self.root}/manifest", "v="):
            if v < self.version:
                fs, p = self._path(self._at("manifest", v))
                fs.delete(p, True)

