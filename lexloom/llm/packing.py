"""Best-fit packing in a tree of residual bins.

Each task of the scan turns its documents into token ids, cuts only those that exceed a sequence, and packs the pieces by
best fit, longest first. Bins that are nearly full are done; all others stay open for the task's later documents. At its end,
underfull bins that no merge can use are done too: two bins merge only if one of them is at most half full, and best fit
leaves few such bins, so a task passes on its bins up to half a sequence and PASSED of the emptiest others. FAN tasks' leftovers then meet in one group and are packed again, bins being
the items, and so on up a tree until one group is left; what a group passes on is bounded, so no group grows with the
corpus, and no piece is ever dropped. Texts stay in the scan; what moves is five numbers a piece.

Defined cases: a null or empty text is the end mark alone; repeated rows are packed each; null doc_ids stay null; equal
lengths are packed in order of doc_id and piece; an empty table gives no sequences; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import token_ids
from lexloom.llm.bpe import crc
from lexloom.llm.common import table, written

CAPACITY, SLACK, FAN, PASSED = 2048, 16, 32, 64  # tokens a sequence; of these, missing in a full bin; groups that merge; other bins that a group passes on
ITEMS = 20_000  # items that a task packs at a time
PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
BINS = f"done boolean, group long, sequence_id long, fill int, pieces array<{PIECE}>"
ARROW_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
ARROW_BINS = pa.schema([("done", pa.bool_()), ("group", pa.int64()), ("sequence_id", pa.int64()), ("fill", pa.int32()), ("pieces", pa.list_(ARROW_PIECE))])

Item = tuple[int, list[tuple]]  # tokens, and pieces (doc_id, piece, start, length, crc)


def best_fit(items: list[Item], capacity: int) -> list[Item]:
    """Longest first, each into the fullest bin that has room. A bit of `rooms` for each room that some bin has."""
    bins: list[tuple[int, list]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    fills: list[int] = []
    for size, pieces in sorted(items, key=lambda x: (-x[0], x[1][0][0] is None, x[1][0][0] or 0, x[1][0][1], x[1][0][2:])):
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[k][1].extend(pieces)
            fills[k] += size
        else:
            k, room = len(bins), capacity
            bins.append((k, list(pieces)))
            fills.append(size)
        by_room[room - size].append(k)
        rooms |= 1 << (room - size)
    return [(fills[k], pieces) for k, pieces in bins]


def sorted_out(bins: list[Item], capacity: int, slack: int, passed: int) -> tuple[list[Item], list[Item]]:
    """Bins that are done, and bins to pass on."""
    done = [b for b in bins if b[0] >= capacity - slack]
    rest = sorted((b for b in bins if b[0] < capacity - slack), key=lambda b: b[0])
    half = sum(2 * b[0] <= capacity for b in rest)
    keep = half + passed if half else 0
    return done + rest[keep:], rest[:keep]


def batch_of(bins: list[Item], done: bool, group: int, first_id: int) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(p) for _, p in bins)])
    flat: list[list] = [[], [], [], [], [], []]
    for _, pieces in bins:
        at = 0
        for p in pieces:
            for column, v in zip(flat, (*p, at)):
                column.append(v)
            at += p[3]
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, ARROW_PIECE)], fields=list(ARROW_PIECE))
    n = len(bins)
    return pa.RecordBatch.from_arrays(
        [pa.array([done] * n, pa.bool_()), pa.array([group] * n, pa.int64()), pa.array(range(first_id, first_id + n), pa.int64()), pa.array([b[0] for b in bins], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)],
        schema=ARROW_BINS,
    )


def packed(items: Iterator[Item], level: int, group: int, passed: int, capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    """Bins of the items, taken ITEMS at a time, or as many as bins are open if these are more, together with all bins that are
    still open. Only after the last item are open bins closed or passed on."""
    next_id = level << 58 | group << 32

    def out(bins: list[Item], done: bool) -> Iterator[pa.RecordBatch]:
        nonlocal next_id
        for i in range(0, len(bins), 2000):
            yield batch_of(bins[i : i + 2000], done, group, next_id)
            next_id += len(bins[i : i + 2000])

    lot: list[Item] = []
    wanted = ITEMS
    for item in items:
        lot.append(item)
        if len(lot) >= wanted:
            bins = best_fit(lot, capacity)
            yield from out([b for b in bins if b[0] >= capacity - slack], True)
            lot = [b for b in bins if b[0] < capacity - slack]
            wanted = len(lot) + max(ITEMS, len(lot))
    done, lot = sorted_out(best_fit(lot, capacity), capacity, slack, passed)
    yield from out(done, True)
    yield from out(lot, False)


def scanned(path: str, capacity: int, slack: int):
    """For mapInArrow: doc_id, text to bins. The task's number is its group."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[Item]:
        ids = token_ids.loaded(path)
        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), ids.encoded(t.as_py() for t in b.column(1))):
                raw += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    yield len(part) // 4, [(doc, k, at // 4, len(part) // 4, crc(part))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(items(batches), 0, TaskContext.get().partitionId(), PASSED, capacity, slack)

    return run


def merging(level: int, passed: int, capacity: int, slack: int):
    """For mapInArrow over whole groups: passed-on bins to bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[Item]] = {}
        for b in batches:
            for group, fill, pieces in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                groups.setdefault(group, []).append((fill, [tuple(p.values())[:5] for p in pieces]))
        for group in sorted(groups):
            yield from packed(iter(groups[group]), level, group, passed, capacity, slack)

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scan = docs.select("doc_id", "text").mapInArrow(scanned(path, capacity, slack), BINS)
    bins, _ = written(spark, scan, "pack-0")
    levels, level = [bins], 0
    left = bins.where("not done").select("group", "fill", "pieces")
    groups = left.agg(F.max("group")).first()[0]
    while groups:  # more than the one group 0
        level += 1
        groups //= FAN
        last = groups == 0
        dealt = left.withColumn("group", F.floor(F.col("group") / FAN)).repartition(max(1, min(groups + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))), "group")
        bins, _ = written(spark, dealt.mapInArrow(merging(level, 0 if last else PASSED, capacity, slack), BINS), f"pack-{level}")
        levels.append(bins)
        left = bins.where("not done").select("group", "fill", "pieces")
    whole = levels[0].where("done")
    for bins in levels[1:]:
        whole = whole.unionByName(bins.where("done"))
    whole = whole.unionByName(levels[-1].where("not done"))
    return whole.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")


def op5(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))
