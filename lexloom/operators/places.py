"""Joins of places: rows (key, pos) against intervals and against the nearest row of another table.

A key is a text and a position an offset in it, or the like. Both joins cut a key's positions into pieces of a fixed width and
join by equality of (key, piece), so that one huge text is dealt out to as many tasks as it has pieces, nothing is compared with
all of its key, and there is no nested loop.

Null keys and null positions match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN, WIDTH = 1024, 1 << 16  # positions of a bin of intervals, and of a piece of an as-of join


def binned(spans: DataFrame, key: str, width: int) -> DataFrame:
    """spans (key, start, end; half-open) once for each bin that they reach into. Empty ones reach into none."""
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    kept = spans.where(F.col("start") < F.col("end"))
    return kept.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.explode(bins).alias("_bin"))


def _within(places: DataFrame, spans: DataFrame, key: str, pos: str, width: int, how: str) -> DataFrame:
    b = binned(spans, key, width)
    hit = (places[key] == b["_key"]) & (F.floor(places[pos] / width) == b["_bin"]) & (b["_start"] <= places[pos]) & (places[pos] < b["_end"])
    return places.join(b, hit, how)


def outside(places: DataFrame, spans: DataFrame, key: str, pos: str = "pos", width: int = BIN) -> DataFrame:
    """The places that no interval of their key holds. Intervals may overlap, and may be of any length."""
    return _within(places, spans, key, pos, width, "left_anti")


def inside(places: DataFrame, spans: DataFrame, key: str, pos: str = "pos", width: int = BIN) -> DataFrame:
    """The places that some interval of their key holds, each once."""
    return _within(places, spans, key, pos, width, "left_semi")


def as_of(left: DataFrame, right: DataFrame, key: str, values: dict[str, str], pos: str = "pos", forward: bool = False, strict: bool = False, width: int = WIDTH) -> DataFrame:
    """left with the values (column of right: name in the result) of right's nearest row before it in the same key, or behind it where
    forward; at the same position, too, unless strict. Null where there is none; of several at one position the largest values.

    The rows of both tables meet in pieces of `width` positions, sorted by position, where the last right row is carried on. What a
    piece leaves to the next one is a row a piece, carried on in the same way. So each row is shuffled once, and of a hot
    key no task sees more than a piece and the list of its pieces.
    """
    sign: Column = F.lit(-1 if forward else 1)
    at = (sign * F.col(pos)).cast("long")
    later = 0 if strict else 1  # at one position the left row comes before the right ones, or behind them
    carried = [F.col(c).alias(c) for c in left.columns]
    value = F.struct(*(F.col(c).alias(n) for c, n in values.items()))
    kind = right.select(value.alias("v")).schema["v"].dataType
    mine = left.select(F.col(key).alias("_key"), at.alias("_at"), F.lit(later).alias("_side"), F.lit(None).cast(kind).alias("_value"), F.struct(*carried).alias("_row"))
    row = mine.schema["_row"].dataType
    theirs = right.where(F.col(pos).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), at.alias("_at"), F.lit(1 - later).alias("_side"), value.alias("_value"), F.lit(None).cast(row).alias("_row"))
    both = mine.unionByName(theirs).withColumn("_piece", F.floor(F.col("_at") / width))
    own = Window.partitionBy("_key", "_piece").orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_found", F.last("_value", ignorenulls=True).over(own))
    left_over = both.groupBy("_key", "_piece").agg(F.max_by(F.col("_value"), F.when(F.col("_value").isNotNull(), F.struct("_at", "_value"))).alias("_last"))
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    left_over = left_over.select(F.col("_key").alias("_k"), F.col("_piece").alias("_p"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    found = both.where("_row is not null").join(left_over, (F.col("_key") == F.col("_k")) & (F.col("_piece") == F.col("_p")), "left")
    nearest = F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_found", "_carried"))
    return found.withColumn("_nearest", nearest).select("_row.*", *(F.col("_nearest")[n].alias(n) for n in values.values()))
