"""The index of definitions: a table clustered by lower-cased name, kept current by deletes and appends."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lexloom.functions.text import Text, col, is_component_file, uri_path
from lexloom.operators.extract import function_defs
from lexloom.sources.globs import matches


PART, PREFIXES = 4096, 100_000  # definitions of one array; prefixes that are sent out at a time


def inverted(defs: DataFrame, part: int = PART) -> DataFrame:
    """name_key, part, definitions: arrays in order of file and place. A name with more than `part` definitions has several, dealt by
    a hash of file and place, so that no array and no task grows with a name that every file defines; only such names, at most
    one for `part` definitions, are joined. defs is read twice: give it as a table, so that no file is lexed twice."""
    hot = defs.groupBy(F.col("name_key").alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_n") > part)
    parts = F.coalesce(F.ceil(F.col("_n") / part), F.lit(1))
    dealt = defs.join(hot, F.col("name_key") == F.col("_hot"), "left").withColumn("part", F.pmod(F.xxhash64("uri", "ord"), parts).cast("int"))
    return dealt.groupBy("name_key", "part").agg(F.sort_array(F.collect_list(F.struct("uri", "ord", "line", "name", "arguments"))).alias("definitions"))


def lookup(requests: DataFrame, defs: DataFrame, word: str = "word") -> DataFrame:
    """requests x definitions of the word, whatever its case; requests without one are left out."""
    return requests.join(defs, F.lower(F.col(word)) == F.col("name_key")).drop("name_key")


def without_files(defs: DataFrame, files: DataFrame) -> DataFrame:
    return defs.join(files.select("uri").distinct(), "uri", "left_anti")


def upserted(defs: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after the changed files (uri, text): all their old rows go, also when a file has no definition left."""
    return without_files(defs, changed).unionByName(function_defs(changed.dropDuplicates(["uri"])).select(defs.columns))


def without_prefix(defs: DataFrame, removed: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """The index without the files whose uri starts with a removed folder's uri, as it is: folder A takes folder AB along.
    Folders that are configured (protected: path) are not removed.

    Prefixes, but for those that begin with another one, are disjoint ranges of uris, so each uri is looked up once, by bisection for
    the last one that is not behind it. They are sent out sorted, PREFIXES at a time, and the index is filtered by one block after
    the other: nothing is shuffled, and no join is made.
    """
    if protected is not None:
        removed = removed.join(protected.select(F.col("path").alias("_path")), uri_path(removed.uri) == F.col("_path"), "left_anti")
    for block in outermost(r[0] for r in removed.where("uri is not null").select("uri").distinct().orderBy("uri").toLocalIterator()):
        defs = defs.where(~_under(defs.sparkSession, block)("uri"))
    return defs


def outermost(prefixes: Iterable[str], size: int = PREFIXES) -> Iterator[list[str]]:
    """Sorted prefixes without those that begin with another one, in blocks."""
    block: list[str] = []
    last = None
    for p in prefixes:
        if last is None or not p.startswith(last):
            last = p
            block.append(p)
            if len(block) == size:
                yield block
                block = []
    if block:
        yield block


def _under(spark: SparkSession, prefixes: list[str]):
    shared = spark.sparkContext.broadcast(prefixes)

    @F.arrow_udf(BooleanType())
    def run(uris: pa.Array) -> pa.Array:
        known = shared.value
        return pa.array([u is not None and (i := bisect_right(known, u)) > 0 and u.startswith(known[i - 1]) for u in uris.to_pylist()], pa.bool_())

    return run


GRAM = 3


def grams(name: Text) -> Column:
    """The different parts of a name of up to GRAM letters, the empty one among them."""
    name = col(name)
    sized = lambda n: F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), *(sized(n) for n in range(1, GRAM + 1))))


def symbol_search(queries: DataFrame, defs: DataFrame) -> DataFrame:
    """queries (req_id, query) x definitions whose name holds the query, whatever the case; an empty query finds all.

    Joined by equality: names, each once, are listed under all their grams, and a query looks under its last letters and is
    then verified; a query shorter than a gram is one itself. Found names are joined with their definitions. Names come out of texts
    and have many grams, which no estimate of the texts' size sees: both joins are merges, whatever the limit for broadcasts.
    """
    names = defs.select("name_key").distinct().select("name_key", F.explode(grams("name_key")).alias("_gram"))
    q = queries.where("query is not null").select("req_id", F.lower("query").alias("_q"))
    q = q.withColumn("_last", F.when(F.length("_q") <= GRAM, F.col("_q")).otherwise(F.substring("_q", -GRAM, GRAM)))
    found = q.join(names.hint("merge"), F.col("_last") == F.col("_gram")).where(F.contains("name_key", "_q")).select("req_id", "name_key")
    return found.join(defs.hint("merge"), "name_key").select("req_id", "name", "uri", "line")


def accepts(files: DataFrame, folders: list[str], globs: list[str]) -> DataFrame:
    """The changed files that are indexed: component files, and inside the globs or else the folders, if there are any."""
    kept = files.where(is_component_file("uri"))
    if not folders:
        return kept
    path = uri_path("uri")
    if globs:
        return kept.where(matches(path, globs))
    inside = F.lit(False)
    for f in folders:
        inside = inside | F.startswith(path, F.lit(f + "/"))
    return kept.where(inside)
