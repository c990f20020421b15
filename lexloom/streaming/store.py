"""Open documents as a keyed store: a stateful stream over the change feed, whose state is read back by key.

Documents, by (session, uri), are dealt out over buckets by hash, and a bucket's open documents are one state value. Opening and changing
set a document's text, closing removes it, and so does a timer where a document has had no change for as long as `idle` in event
time, as of a session that went away without closing. A bucket is read and written once in a micro-batch that touches it, and has one timer, for
the first of its documents to be given up: each call from Python to the state costs as much as hundreds of small documents. Changes come to the
state packed, a row for each bucket of many changes, of each document the last. State lies in RocksDB under the query's checkpoint and
holds open documents only. `documents` reads it as a table at the last committed batch, without the query running; `get`
joins a batch of requests with it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexloom.schemas import PACKED_CHANGES, STORE_UPDATES, STORED
from lexloom.sources.work import by_value
from lexloom.streaming.changes import DOCUMENT_OPS, KEYS

STATE, PROVIDER = "documents", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF, PARTITIONS_CONF = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
BUCKETS, HELD, HELD_CHARS = 1024, 1 << 17, 1 << 25  # of the state; documents, and letters of their texts, that a task packs at once


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, session_id, uri, seq, at, op, text) to a row for each bucket of many of them: for each document the last effective one."""
    held: dict[tuple, tuple] = {}
    chars = 0

    def rows() -> pa.RecordBatch:
        by_bucket: dict[int, list[tuple]] = {}
        for (bucket, *key), last in held.items():
            by_bucket.setdefault(bucket, []).append((tuple(key), last))
        return pa.RecordBatch.from_arrays([pa.array(by_bucket.keys(), pa.int32()), pa.array([pickle.dumps(v) for v in by_bucket.values()], pa.binary())], ["bucket", "rows"])

    for batch in batches:
        for bucket, session, uri, seq, at, op, text in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if seq is None or (op != "close" and text is None):
                continue
            old = held.get(key := (bucket, session, uri))
            if old is None or seq > old[0]:
                held[key] = (seq, at, None if op == "close" else text)
                chars += len(text or "")
        if len(held) >= HELD or chars >= HELD_CHARS:
            yield rows()
            held, chars = {}, 0
    if held:
        yield rows()


class Documents(StatefulProcessor):
    """One bucket's changes at a time, in any order within a micro-batch: of each document the last one, by seq, counts."""

    def __init__(self, idle_ms: int | None):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState(STATE, STORED)

    def _read(self) -> dict[tuple, tuple]:
        """(session_id, uri) to (seq, at, text)."""
        sessions, uris, texts, seqs, ats = self.state.get() or ((),) * 5
        return dict(zip(zip(sessions, uris), zip(seqs, ats, texts)))

    def _write(self, documents: dict[tuple, tuple]) -> None:
        if documents:
            seqs, ats, texts = zip(*documents.values())
            sessions, uris = zip(*documents)
            self.state.update((list(sessions), list(uris), list(texts), list(seqs), list(ats)))
        else:
            self.state.clear()

    def _over(self, document: tuple, now: int) -> bool:
        return self.idle is not None and document[1] is not None and document[1] + self.idle <= now

    def _wait(self, documents: dict[tuple, tuple], old: list[int]) -> None:
        """Instead of the old timers one for the first document to be given up: timers fire once event time is past them, not at them."""
        times = [at for _, at, _ in documents.values() if at is not None]
        new = [min(times) + self.idle - 1] if times and self.idle is not None else []
        for t in old:
            if t not in new:
                self.handle.deleteTimer(t)
        for t in new:
            if t not in old:
                self.handle.registerTimer(t)

    @staticmethod
    def _told(told: dict[tuple, tuple]) -> Iterator[Row]:
        if told:
            yield Row(session_id=[k[0] for k in told], uri=[k[1] for k in told], text=[d[2] for d in told.values()], seq=[d[0] for d in told.values()])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        documents, told, now = self._read(), {}, timerValues.getCurrentWatermarkInMs()
        closed: dict[tuple, int] = {}  # in this micro-batch: what comes before is older
        for r in rows:
            for k, new in pickle.loads(r.rows):
                old = documents[k][0] if k in documents else closed.get(k, -1)
                if new[0] <= old:
                    continue
                if new[2] is None or self._over(new, now):
                    documents.pop(k, None)
                    closed[k], told[k] = new[0], (new[0], None, None)
                else:
                    documents[k] = told[k] = new
        if told:
            self._write(documents)
            if self.idle is not None:
                self._wait(documents, list(self.handle.listTimers()))
        yield from self._told(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        documents, now = self._read(), timerValues.getCurrentWatermarkInMs()
        over = {k: (d[0], None, None) for k, d in documents.items() if self._over(d, now)}
        for k in over:
            del documents[k]
        self._write(documents)
        self._wait(documents, [])
        yield from self._told(over)

    def close(self) -> None:
        pass


def updates(changes: DataFrame, idle_ms: int | None = None, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """A stream of changes (seq, at, session_id, op, uri, changes) to each document's text after each micro-batch that touched it, null
    when it was closed or given up. Timers fire once event time is past them, `late` behind the newest change; older changes still
    count as long as no newer one of their document has come: packed, they have no time for Spark to drop them by."""
    text = F.element_at("changes", F.when(F.size("changes") > 0, -1))
    rows = changes.where(F.col("op").isin(*DOCUMENT_OPS)).withColumn("time", F.timestamp_millis("at")).withWatermark("time", late)
    rows = rows.select(F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int").alias("bucket"), *KEYS, "seq", "at", "op", text.alias("text"))
    with by_value(__name__):
        told = rows.mapInArrow(packed, PACKED_CHANGES).groupBy("bucket").transformWithState(Documents(idle_ms), STORE_UPDATES, "Update", "EventTime")
    return told.select(F.inline(F.arrays_zip(*told.columns)))


@contextmanager
def stateful(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """The settings that stateful streams need, for those that start in this block: a stream keeps what it was started with, and the
    session gets its own back."""
    wanted = {PROVIDER_CONF: PROVIDER} | ({PARTITIONS_CONF: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def follow(changes: DataFrame, checkpoint: str, sink, idle_ms: int | None = None, partitions: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Take what the feed has and stop. sink(batch, batch_id) gets the updates; the checkpoint is where the next run goes on, in as
    many partitions and buckets as the first one had."""
    with stateful(changes.sparkSession, partitions):
        stream = updates(changes, idle_ms, buckets=buckets).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        return stream.outputMode("update").trigger(availableNow=True).start()


def documents(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session_id, uri, text, seq of the documents that are open after the last committed batch."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", STATE).load()
    return state.select(F.inline(F.arrays_zip(*(F.col(f"value.{c}").alias(c) for c in (*KEYS, "text", "seq")))))


def get(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """requests (with session_id, uri) with the document's text, null for one that is not open. Keys are equal also where null."""
    d = documents.select(F.col("session_id").alias("_session"), F.col("uri").alias("_uri"), "text")
    return requests.join(d, F.col("session_id").eqNullSafe(F.col("_session")) & F.col("uri").eqNullSafe(F.col("_uri")), "left").drop("_session", "_uri")
