"""Fill-in-the-middle by a sparse checkpoint index.

Counting a text's units (code points) walks over its UTF-8 bytes once and records, every EVERY units, how many bytes and how
many units lie behind. A cut at unit c is found by binary search for the last checkpoint at or before c, and by walking on from
there, over fewer than EVERY units. So a text is never held as a list of its letters, and an index has one entry for EVERY
of them; both cuts of a document use the same one.

A document is turned into PSM or SPM form by marks, or stays plain, by a hash of its key: the form and the cuts depend on
the key and the text's length alone. A text that holds a mark stays plain, so that reading back is exact.

Defined cases: null text is empty, and empty text is plain; null key counts as an empty string; any length is cut whole;
repeated rows give equal results; an empty table gives an empty result; other columns are carried along, and where df itself has
a column of the result's name, the result's gets "_" behind it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexloom.llm.common import fresh, table

EVERY, CHUNK = 1024, 1 << 16  # units between checkpoints; bytes looked at together
MARKS = (b"<P>", b"<S>", b"<M>")  # before prefix, suffix, middle
PLAIN_FROM, SPM_BELOW = 90, 20  # of a hundred: from here on plain; of the rest, below this suffix first
OUT_BYTES = 1 << 24  # of a batch that is given out


class Checkpoints:
    """Byte and code-point offsets of one text: units[i] code points lie before byte bytes[i]."""

    def __init__(self, raw: bytes | memoryview, every: int = EVERY):
        self.raw, self.every = np.frombuffer(raw, np.uint8), every
        self.units, self.bytes, self.n = [0], [0], 0
        for base in range(0, len(self.raw), CHUNK):
            starts = np.flatnonzero(self._starts(base, base + CHUNK))
            first = -self.n % every  # where in this chunk's units the next checkpoint is
            marks = starts[first::every]
            if self.n == 0:
                marks, first = marks[1:], every
            self.units += range(self.n + first, self.n + first + every * len(marks), every)
            self.bytes += (base + marks).tolist()
            self.n += len(starts)

    def _starts(self, a: int, b: int) -> np.ndarray:
        """Which bytes begin a code point."""
        return (self.raw[a:b] & 0xC0) != 0x80

    def byte_of(self, unit: int) -> int:
        """The byte at which this code point begins; the text's length for the one after the last."""
        if unit >= self.n:
            return len(self.raw)
        i = bisect_right(self.units, unit) - 1
        at, left = self.bytes[i], unit - self.units[i]
        return at + int(np.flatnonzero(self._starts(at, at + 4 * (left + 1)))[left])


def transform(raw: bytes, key: str) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, output."""
    index = Checkpoints(raw)
    n, digest = index.n, hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not raw or h3 % 100 >= PLAIN_FROM or any(m in raw for m in MARKS):
        return n, "plain", None, None, raw
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = index.byte_of(a), index.byte_of(b)
    prefix, middle, suffix = raw[:i], raw[i:j], raw[j:]
    p, s, m = MARKS
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))


def transformed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's columns, with n, form, prefix_chars, middle_chars and output."""
    names = fresh(df, "n", "form", "prefix_chars", "middle_chars", "output")
    types = [LongType(), StringType(), LongType(), LongType(), StringType()]
    schema = StructType([*df.schema.fields, *(StructField(a, t) for a, t in zip(names, types))])
    (k,) = fresh(df, "_key")
    at = df.columns.index(text)

    def given(batch: pa.RecordBatch, start: int, rows: list[tuple]) -> pa.RecordBatch:
        n, form, prefix, middle, output = zip(*rows)
        new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*batch.slice(start, len(rows)).columns[:-1], *new], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, held = [], 0, 0
            for t, key_ in zip(batch.column(at).cast(pa.binary()), batch.column(batch.num_columns - 1)):
                rows.append(transform(t.as_py() or b"", key_.as_py() or ""))
                held += len(rows[-1][4])
                if held > OUT_BYTES:
                    yield given(batch, start, rows)
                    rows, start, held = [], start + len(rows), 0
            if rows:
                yield given(batch, start, rows)

    return df.withColumn(k, F.col(key).cast("string")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text as it was, from output and form."""
    parts = F.split(output, "<P>|<S>|<M>", 4)
    in_order = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(in_order)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
h as (
  select doc_id, text, length(text) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
    cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= {PLAIN_FROM} then 'plain' when h4 % 100 < {SPM_BELOW} then 'spm' else 'psm' end as form from h
), p as (select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
