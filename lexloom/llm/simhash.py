"""Near-duplicates by SimHash, with fuzzy hashing by the binary Golay code.

A fingerprint has 64 bits, cut into three segments of 21, 21 and 22. The perfect Golay code (23, 12) maps a segment, padded
with zeros, to the index of its nearest codeword and, if that is three bits away, to the five at four bits as well. Two
segments that differ in two bits at most share one of these up to six indices; two that differ in one bit at most share the
first one's nearest.

Four errors over three segments leave these cases (pigeonhole): either some segment is equal and some other has at most
two errors, or no segment is equal and two of them have one each. Keys of the first kind are an equal segment with
an index of another (33 bits); keys of the second kind two indices (24 bits). The larger fingerprint of a pair probes with
all its indices, the smaller one is found by its own; joined pairs are verified by counting bits, and a pair is given out
for its first case only, so that a link comes once or twice and never once for each key that it shares.

Equal fingerprints are one node, made by a pre-aggregation; only differing fingerprints are linked, and the components
of the links give the groups. The joins' hot keys are left to the adaptive splitting of skewed joins.

Defined cases: null, empty or blank text has the fingerprint zero; fewer than four words are one shingle; repeated rows fall
together; null doc_ids are in groups but never name one unless they are alone; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import cleared, fresh, held, mark, table, written
from lexloom.llm.components import components

SHINGLE, SEED, MOST = 4, 42, 4
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLOCK = 1 << 14  # shingles whose bits are counted at a time
SHIFTS, WIDTHS = (0, 21, 42), (21, 21, 22)
ORDERED = [(i, j) for i in range(3) for j in range(3) if i != j]  # an equal segment, and one with at most two errors
PAIRS = [(0, 1), (0, 2), (1, 2)]  # two segments with at most one error each
GENERATOR = 0b110001110101  # fixed value: the Golay code's generator polynomial


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1]]
    ends = [e - 1 for e in ends[len(words) - n :]]
    hash_ = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([hash_(line[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(shingle: int = SHINGLE, seed: int = SEED, text: str = "text"):
    """A column: each text's fingerprint as a signed long."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held(None, lambda: None)
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64).view(np.int64))

    return run(text)


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits of a word, and the error of each syndrome."""

    def syndrome(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    low = np.array([syndrome(v) for v in range(1 << 12)], np.int64)
    high = np.array([syndrome(v << 12) for v in range(1 << 11)], np.int64)
    error = np.zeros(1 << 11, np.int64)
    one = [1 << i for i in range(23)]
    for e in [*one, *(a | b for a in one for b in one if a < b), *(a | b | c for a in one for b in one if a < b for c in one if b < c)]:
        error[syndrome(e)] = e
    return low, high, error


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the nearest codeword of each 23-bit word."""
    low, high, error = golay()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def indices(words: np.ndarray) -> np.ndarray:
    """Six columns: the nearest codeword's index, then those of the other codewords at four bits, or -1."""
    first = nearest(words)
    others = np.sort(np.stack([nearest(words ^ (1 << i)) for i in range(23)], 1), 1)
    new = (others != first[:, None]) & np.concatenate([np.ones((len(words), 1), bool), others[:, 1:] != others[:, :-1]], 1)
    out = np.full((len(words), 6), -1, np.int64)
    out[:, 0] = first
    row, column = np.nonzero(new)
    out[row, (np.cumsum(new, 1))[row, column]] = others[row, column]
    return out


def keys(fp: np.ndarray, probing: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, near): the fuzzy keys of fingerprints, as the larger of a pair (probing) or the smaller one. near: by the
    nearest codewords."""
    u = fp.view(np.uint64)
    segment = [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS)]
    index = [indices(s) for s in segment]
    rows, out, near = [], [], []
    for case, (i, j) in enumerate(ORDERED):
        r, c = np.nonzero(index[j] >= 0)
        rows.append(r)
        out.append(case << 40 | segment[i][r] << 12 | index[j][r, c])
        near.append(c == 0)
    for case, (i, j) in enumerate(PAIRS, len(ORDERED)):
        a, b = (index[i], index[j]) if probing else (index[i][:, :1], index[j][:, :1])
        both = np.where((a >= 0)[:, :, None] & (b >= 0)[:, None, :], a[:, :, None] << 12 | b[:, None, :], -1).reshape(len(fp), -1)
        r, c = np.nonzero(both >= 0)
        rows.append(r)
        out.append(case << 40 | both[r, c])
        near.append(c == 0)
    return np.concatenate(rows), np.concatenate(out), np.concatenate(near)


def keyed(probing: bool, rows: int = 2000):
    """For mapInArrow: fp to key, fp, near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(all_), rows):
                fp = all_[at : at + rows]
                r, k, near = keys(fp, probing)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[r]), pa.array(near)], ["key", "fp", "near"])

    return run


def errors(i: int) -> str:
    return f"bit_count(shiftrightunsigned(s.fp ^ p.fp, {SHIFTS[i]}) & {(1 << WIDTHS[i]) - 1}L)"


def linked(fps: DataFrame) -> DataFrame:
    """fps (fp: distinct signed longs) to a, b: every pair of fingerprints that differ in at most four bits, a being the
    smaller; some pairs come twice. A fingerprint has up to a hundred keys, which no estimate from fps' own size sees, so the join is
    a merge of two dealt sides, whatever the limit for broadcasts."""
    smaller = fps.select("fp").mapInArrow(keyed(False), "key long, fp long, near boolean").alias("s")
    larger = fps.select("fp").mapInArrow(keyed(True), "key long, fp long, near boolean").alias("p")
    case = " ".join(
        [f"when {errors(i)} = 0 and {errors(j)} <= 2 then {n}" for n, (i, j) in enumerate(ORDERED)]
        + [f"when {errors(i)} <= 1 and {errors(j)} <= 1 then {n}" for n, (i, j) in enumerate(PAIRS, len(ORDERED))]
    )
    # with at most one error in the indexed segment, the smaller one's nearest codeword is enough
    close = " ".join(f"when {n} then s.near or {errors(j)} = 2" for n, (_, j) in enumerate(ORDERED))
    on = f"s.key = p.key and s.fp < p.fp and bit_count(s.fp ^ p.fp) <= {MOST} and shiftright(s.key, 40) = (case {case} end) and (case shiftright(s.key, 40) {close} else true end)"
    return smaller.hint("merge").join(larger, F.expr(on)).select(F.col("s.fp").alias("a"), F.col("p.fp").alias("b"))


def grouped(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) to doc_id, fp, component_id, root."""
    prints, _ = written(spark, docs.select("doc_id", fingerprints(shingle).alias("fp")), "fingerprints")
    return with_groups(spark, prints)


def with_groups(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp and others) with component_id, the smallest doc_id of the group, and root, a fingerprint that stands for it."""
    since = mark()
    nodes, _ = written(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    links, _ = written(spark, linked(nodes), "pairs")
    roots = components(spark, links)
    # both sides of each further join are tables, so that the join deals them anew and can split a hot root or fingerprint
    mine, _ = written(spark, nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"), "rooted")
    firsts, _ = written(spark, mine.groupBy("root").agg(F.min("low").alias("component_id")), "firsts")
    names, path = written(spark, mine.join(firsts, "root").select(F.col("fp").alias("node"), "component_id", "root"), "names")
    cleared(spark, since, path)
    return prints.join(names, prints.fp == names.node).drop("node")


def numbered(text: str = "text"):
    """A column: each text's fingerprint, and a number of its row. To be written at once, as a task that is run again may meet its
    rows in another order."""

    @F.arrow_udf("fp long, row long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held(None, lambda: None)
        at = TaskContext.get().partitionId() << 40
        for texts in batches:
            fp = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array(fp), pa.array(np.arange(at, at + len(fp)))], ["fp", "row"])
            at += len(fp)

    return run.asNondeterministic()(text)


def near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, of several such rows the first written; what other columns docs has
    stays as it is, whatever their names.

    Rows are told apart by numbers of their own and not by doc_id, so that a null or repeated doc_id in one group takes no row
    out of another. Null doc_ids come last. Only numbers are grouped; the texts are joined once with the rows that stay.
    """
    (print_,) = fresh(docs, "_print")
    marked, _ = written(spark, docs.withColumn(print_, numbered()), "marked")
    rows = with_groups(spark, marked.select("doc_id", F.col(print_)["fp"].alias("fp"), F.col(print_)["row"].alias("row")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    (stays,) = fresh(marked, "_stays")
    kept = rows.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias(stays))
    return marked.join(kept, marked[print_]["row"] == F.col(stays), "left_semi").select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
