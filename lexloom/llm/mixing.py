"""Mixing sources to target weights by systematic sampling.

A source's target is its share, by weight, of the total size; no target exceeds MOST times its source's size, and what is above that
is shared out by weight among the others until none is above. A document of a source is then expected in
target / source's size copies. Inside its source, in order of size, these expected copies are summed up from the first document to the
last, one random offset is added, and a document is emitted once for each whole number that the sum crosses in it: the rate
rounded down or up, never more than MOST times.

In order of size, the words taken differ from the target by at most the longest document of the source. To come nearer,
DRAWS offsets are drawn for a source, and the one whose words come nearest to its target is its offset. All draws are hashes of
seed, source and number, and ties in size are ordered by a hash of the key: reruns agree.

Sources are ranked, and documents numbered, by ordered.numbered, so that a hot source is dealt out by size and hash; texts never
leave the scan. The excess is shared out in rounds that each sum up one row a source.

Defined cases: null text has size 0; null sources are one source, the last; null keys are one key; a source without words has
target 0; repeated rows are documents of their own; an empty table gives an empty result; other columns are carried along, and where
df itself has a column of the result's name, the result's gets "_" behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import fresh, small, table, written
from lexloom.llm.ordered import numbered

WEIGHTS, MOST, DRAWS, SEED = (1, 2, 3), 3, 16, 12  # repeating by a source's rank; copies of a document at most; offsets drawn a source; of the draws
STEPS = 1 << 16  # offsets are multiples of 1 / STEPS, so that adding them to a count is exact
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size; a row a source, a table) with each source's target: weights repeat in the order of sources, null last."""
    ranked = numbered(spark, sizes.select("source", "source_size"), [], [F.col("source").asc_nulls_last()], "rank", "_of").drop("_of")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    ranked, _ = written(spark, ranked.select("source", "source_size", weight.cast("long").alias("weight")), "ranked")
    whole, weighed = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    cap = most * F.col("source_size")
    full, level = None, (whole or 0) / (weighed or 1)
    while True:  # the level only rises, and with it the set of full sources grows
        above = cap < F.col("weight") * F.lit(level)
        n, held, free = ranked.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == full or not free:
            break
        full, level = n, (whole - held) / free
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def offset(source: Column, draw: Column, seed: int) -> Column:
    """A random number in [0, 1)."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), draw.cast("string"), F.lit(":"), F.coalesce(F.concat(F.lit("="), source), F.lit("-"))), 256)
    return F.conv(F.substring(drawn, 1, 4), 16, 10).cast("double") / STEPS


def crossed(number: Column, rate: Column, shift: Column) -> Column:
    """How many whole numbers the sum of expected copies crosses in the document of this number."""
    return (F.floor(rate * (number + 1) + shift) - F.floor(rate * number + shift)).cast("long")


def mixed(spark: SparkSession, df: DataFrame, size: Column, key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """df's columns with size, source_size, target and copies. df is written as it is: give it without columns that are not needed."""
    names = fresh(df, "size", "source_size", "target", "copies")
    carried = {c: f"c{i}" for i, c in enumerate(df.columns)}
    plain = df.select(F.col(source).alias("source"), size.cast("long").alias("size"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("hash"), *(F.col(c).alias(n) for c, n in carried.items()))
    rows, _ = written(spark, plain, "sizes")
    sizes, _ = written(spark, rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    sources = targets(spark, sizes, weights, most)
    sources = sources.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    placed = numbered(spark, rows, ["source"], [F.col("size").asc(), F.col("hash").asc(), F.col(carried[key]).asc()])
    aimed = small(spark, sources.select(F.col("source").alias("_source"), "source_size", "target", "rate"), "targets")
    placed = placed.join(aimed, F.col("source").eqNullSafe(F.col("_source")))
    taken = [F.sum(F.col("size") * crossed(F.col("number"), F.col("rate"), offset(F.col("source"), F.lit(d), seed))).alias(f"t{d}") for d in range(draws)]
    tried = placed.groupBy("source", "target").agg(*taken)
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{d}") - F.col("target")).alias("off"), F.lit(d).alias("draw")) for d in range(draws))))["draw"]
    offsets = small(spark, tried.select(F.col("source").alias("_s"), offset(F.col("source"), nearest, seed).alias("shift")), "offsets")
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("_s")))
    values = [F.col("size"), F.col("source_size"), F.col("target"), crossed(F.col("number"), F.col("rate"), F.col("shift"))]
    return placed.select(*(F.col(n).alias(c) for c, n in carried.items()), *(v.alias(n) for v, n in zip(values, names)))


def emitted(mix: DataFrame, copies: str = "copies", copy: str = "copy") -> DataFrame:
    """Each document as often as the mix takes it, with the number of the copy from 1."""
    return mix.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("words"))
    out = mixed(spark, docs, F.col("words"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _crossed(shift: str) -> str:
    return f"cast(floor(rate * (number + 1) + {shift}) - floor(rate * number + {shift}) as bigint)"


ORACLE = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, list_value({", ".join(map(str, WEIGHTS))})[1 + (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)}] as weight from s),
f as (
  select *, {MOST} * source_size as cap,
    ((select sum(source_size) from w) - coalesce(sum({MOST} * source_size) over (o rows between unbounded preceding and 1 preceding), 0)) / cast(sum(weight) over (o rows between current row and unbounded following) as double) as level,
    row_number() over o as nth from w window o as (order by {MOST} * source_size / cast(weight as double), source nulls last)
), l as (select arg_min(level, nth) filter (cap >= weight * level) as level from f),
t as (select source, source_size, least(cast(cap as double), weight * (select level from l)) as target from f),
r as (select *, case when source_size > 0 then target / source_size else 0.0 end as rate from t),
p as (
  select d.doc_id, d.source, d.size, source_size, target, rate, row_number() over (partition by d.source order by size, md5(coalesce(cast(doc_id as varchar), '')), doc_id) - 1 as number
  from d join r on d.source is not distinct from r.source
), u as (select source, draw, cast('0x' || substr(sha256('{SEED}:' || draw || ':' || coalesce('=' || source, '-')), 1, 4) as bigint) / {STEPS}.0::double as shift from s, range({DRAWS}) as g(draw)),
c as (select p.source, u.draw, any_value(u.shift) as shift, abs(sum(size * {_crossed("shift")}) - any_value(target)) as off from p join u on p.source is not distinct from u.source group by p.source, u.draw),
b as (select source, arg_min(shift, (off, draw)) as shift from c group by source)
select doc_id, size, source_size, target, size * {_crossed("shift")} as taken from p join b on p.source is not distinct from b.source
"""
