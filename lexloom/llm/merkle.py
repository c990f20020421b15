"""A Merkle manifest of a table, made by higher-order functions over blocks of ordered leaves.

Every row is a leaf, the hash of its fields; leaves of a key stand in order, and each run of FAN of them becomes one node, level by
level, until one is left. Nodes are gathered into blocks of FAN ** DEPTH, an array of bounded size in one row, whose levels are
collapsed natively: sequence gives the runs, slice cuts them, transform hashes them, and aggregate goes from level to level and
keeps the runs of each. What is left of a block is a node of the next round, so a key of n leaves takes log n / log (FAN ** DEPTH)
rounds, each over a table a 256th as large. The keys' roots, in order, are the leaves of one more such tree.

On the way back down each node gets its proof: for each level up to the root what stands left and right of it in its run. A block's
root gets its proof first, and hands it to the block's nodes; so a proof is never longer than FAN digests a level. fold() makes
the root again from a leaf and its proof.

Digests are lowercase hex text and are hashed as such. A leaf's fields are written as "-" if null, else as the number of their UTF-8
bytes, ":" and the value.

Defined cases: null fields differ from empty ones; a null key is a key, the first; equal order values are ordered by leaf, and
repeated rows are leaves of their own; a lone leaf is its key's root; a text of any length is hashed whole, in one row; an
empty table gives an empty result; other columns are carried along or not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import small, table, written
from lexloom.llm.ordered import numbered, same

FAN_BITS, DEPTH = 4, 2  # of nodes in a run, as a power of two; levels of a block
FAN, HEX = 1 << FAN_BITS, 64  # nodes of a run; characters of a digest
BLOCK_BITS = FAN_BITS * DEPTH
STEPS = "array<struct<before:string,after:string>>"
FEW = 10_000  # proofs of a few KB each that may be broadcast
TAMPER_EVERY = 5


def hashed(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields."""
    texts = [f.cast("string") for f in fields]
    return hashed(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def runs_of(digests: Column) -> Column:
    """Each FAN consecutive digests as one text."""
    firsts = F.sequence(F.lit(1), F.size(digests), F.lit(FAN))
    return F.transform(firsts, lambda i: F.array_join(F.slice(digests, i, FAN), ""))


def collapsed(digests: Column, levels: Column) -> Column:
    """So many levels of a block: top, what is left of the digests, and runs, each level's runs from below."""
    start = F.struct(digests.alias("top"), F.expr("cast(array() as array<array<string>>)").alias("runs"))

    def level(done: Column, _: Column) -> Column:
        runs = runs_of(done["top"])
        return F.struct(F.transform(runs, hashed).alias("top"), F.concat(done["runs"], F.array(runs)).alias("runs"))

    return F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), levels), start, level)


def steps_of(i: Column, runs: Column) -> Column:
    """What stands left and right of a block's node i (from 0) at each of the block's levels."""

    def step(level_runs: Column, level: Column) -> Column:
        at = F.call_function("shiftright", i, level * FAN_BITS)
        run, within = F.get(level_runs, F.call_function("shiftright", at, F.lit(FAN_BITS))), at.bitwiseAND(FAN - 1)
        return F.struct(F.substring(run, F.lit(1), within * HEX).alias("before"), F.substring(run, (within + 1) * HEX + 1, F.length(run)).alias("after"))

    return F.transform(runs, step)


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its proof make."""
    return F.aggregate(steps, digest, lambda d, s: hashed(F.concat(s["before"], d, s["after"])))


def siblings(steps: Column) -> Column:
    """A proof's digests in order, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def in_blocks(nodes: DataFrame, keys: list[str], data: list[str]) -> DataFrame:
    """nodes (keys, number, of, digest, data) to a row a block: keys, block, of, nodes, top (what is left of it), runs."""
    at = F.call_function("shiftright", F.col("number"), F.lit(BLOCK_BITS))
    blocks = nodes.groupBy(*keys, at.alias("block"), "of").agg(F.sort_array(F.collect_list(F.struct("number", "digest", *data))).alias("nodes"))
    # the levels of a key: the hexadecimal digits of of - 1
    levels = F.least(F.when(F.col("of") > 1, F.length(F.hex(F.col("of") - 1))).otherwise(0), F.lit(DEPTH))
    blocks = blocks.withColumn("done", collapsed(F.transform("nodes", lambda x: x["digest"]), levels))
    return blocks.select(*keys, "block", "of", "nodes", F.col("done.top")[0].alias("top"), F.col("done.runs").alias("runs"))


def proved(spark: SparkSession, nodes: DataFrame, keys: list[str], data: list[str]) -> DataFrame:
    """nodes (keys, number, of, digest, data) to keys, number, digest, data, steps, subroot (the keys' root), root."""
    floors: list[DataFrame] = []  # tables of blocks, from the leaves up
    ended: list[DataFrame] = []  # roots of keys, by the floor that has them in one block
    floor, inside = nodes, data
    while True:
        blocks, _ = written(spark, in_blocks(floor, keys, inside), "blocks")
        floors.append(blocks)
        roots = blocks.select(*keys, F.col("block").alias("number"), F.ceil(F.col("of") / (1 << BLOCK_BITS)).alias("of"), F.col("top").alias("digest"))
        ended.append(roots.where("of = 1").select(*keys, "digest"))
        if (roots.agg(F.max("of")).first()[0] or 1) == 1:
            break
        floor, inside = roots.where("of > 1"), []
    own = ended[0]
    for e in ended[1:]:
        own = own.unionByName(e)
    own = own.withColumn("number", F.lit(0).cast("long"))
    if keys:
        table_, _ = written(spark, own.select(*keys, F.col("digest")), "roots")
        top = numbered(spark, table_, [], [F.col(k).asc_nulls_first() for k in keys])
        above = proved(spark, top, [], keys).select(*keys, F.lit(0).cast("long").alias("number"), "steps", F.col("digest").alias("subroot"), "root")
    else:
        above = own.select("number", F.expr(f"cast(array() as {STEPS})").alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    found = above
    for i in reversed(range(len(floors))):
        blocks = floors[i]
        up = small(spark, found.select(*(F.col(k).alias(f"_up_{k}") for k in keys), F.col("number").alias("_up_block"), F.col("steps").alias("_up_steps"), "subroot", "root"), "proofs", FEW)
        held = blocks.join(up, same(blocks, up, [*((k, f"_up_{k}") for k in keys), ("block", "_up_block")]))
        inside = data if i == 0 else []
        node = lambda x: F.struct(x["number"].alias("number"), x["digest"].alias("digest"), *(x[c].alias(c) for c in inside), F.concat(steps_of(x["number"].bitwiseAND((1 << BLOCK_BITS) - 1), F.col("runs")), F.col("_up_steps")).alias("steps"))  # noqa: B023, E731
        held = held.select(*keys, F.explode(F.transform("nodes", node)).alias("node"), "subroot", "root")
        found = held.select(*keys, "node.*", "subroot", "root")
        if i:  # the keys that end in the floor below have their proofs from above
            below = floors[i - 1].where(F.col("of") <= 1 << BLOCK_BITS).select(*keys).distinct()
            names = {k: f"_key_{k}" for k in keys}
            below = below.select(*(F.col(k).alias(n) for k, n in names.items()))
            rest = above.join(below, same(above, below, list(names.items())), "left_semi") if keys else above.where("false")
            found = found.select(*keys, "number", "steps", "subroot", "root").unionByName(rest)
    return found


def manifest(spark: SparkSession, leaves: DataFrame, key: str, order: list[str], data: list[str]) -> DataFrame:
    """leaves (key, order, digest, data; a table) to key, number, digest, data, steps, subroot, root: order and digest give a leaf's place."""
    nodes = numbered(spark, leaves, [key], [*(F.col(c).asc_nulls_first() for c in order), F.col("digest").asc()])
    return proved(spark, nodes.select(key, "number", "of", "digest", *data), [key], data)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    fields = lambda t: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t)
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0
    forged = F.when(tampered, fields(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))
    leaves, _ = written(spark, docs.select("doc_id", "source", fields(text).alias("digest"), forged.alias("forged")), "leaves")
    out = manifest(spark, leaves, "source", ["doc_id"], ["doc_id", "forged"])
    folded = fold(F.coalesce("forged", "digest"), F.col("steps"))
    out = out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", hashed(siblings(F.col("steps"))).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, nodes: str, key: str) -> str:
    """Every level of nodes (key, k, n, digest), the runs of each, and the roots."""
    return f"""{name} as (
  select {key}, 0 as level, k, n, digest from {nodes}
  union all
  select {key}, level + 1, k // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' order by k)) from {name} where n > 1 group by {key}, level, k // {FAN}, n
), {name}_runs as (select {key}, level, k // {FAN} as run, string_agg(digest, '' order by k) as digests from {name} where n > 1 group by {key}, level, k // {FAN})"""


def _proofs(name: str, nodes: str, runs: str, on: str) -> str:
    left, right = f"substr(digests, 1, {HEX} * (spot % {FAN}))", f"substr(digests, {HEX} * (spot % {FAN} + 1) + 1)"
    return f"""{name} as (
  select *, 0 as level, k as spot, tried as folded, '' as siblings from {nodes}
  union all
  select x.* exclude (level, spot, folded, siblings), x.level + 1, spot // {FAN}, sha256({left} || folded || {right}), siblings || {left} || {right}
  from {name} x join {runs} r on {on} and x.level = r.level and spot // {FAN} = r.run
)"""


#: crc32 of ASCII text s, bit by bit: the reflected polynomial and the start value are fixed values.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(s, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda r, i: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)))"""

ORACLE = f"""
with recursive d as (select *, doc_id::varchar as s from documents),
leaves as (
  select doc_id, source, {_leaf("text")} as digest, case when doc_id is not null and {_CRC} % {TAMPER_EVERY} = 0 then {_leaf(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} end as forged from d
), nodes as (
  select *, coalesce(forged, digest) as tried, row_number() over (partition by source order by doc_id nulls first, digest) - 1 as k, count(*) over (partition by source) as n from leaves
), {_tree("t", "nodes", "source")},
own as (select source, digest, digest as tried, row_number() over (order by source nulls first) - 1 as k, count(*) over () as n from t where n = 1),
{_tree("u", "(select 'all' as whole, * from own)", "whole")},
{_proofs("inner_", "nodes", "t_runs", "x.source is not distinct from r.source")},
inner_last as (select * from inner_ qualify level = max(level) over (partition by source)),
joined as (
  select i.doc_id, i.source, i.k as place, i.digest, o.digest as subroot, o.k, i.folded as tried, i.siblings as before_ from inner_last i join own o on i.source is not distinct from o.source
), {_proofs("outer_", "joined", "u_runs", "true")},
outer_last as (select * from outer_ qualify level = max(level) over ())
select doc_id, digest as leaf, subroot, root, sha256(before_ || siblings) as proof_sha256, folded as folded_root, folded = root as verified
from outer_last, (select digest as root from u where n = 1)
"""
