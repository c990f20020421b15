"""The catalog of built-in tags and functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import first_line
from lexloom.schemas import CATALOG


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One entry a JSON file; malformed files are left out, and so are entries that are neither tag nor function."""
    raw = spark.read.schema(CATALOG).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file")).where(F.col("type").isin("tag", "function"))
    return raw.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "description", "syntax", "returns")), "type", F.coalesce("params", F.expr("cast(array() as array<struct<name:string,description:string,type:string,required:boolean>>)")).alias("params"), "_file")


def in_order(catalog: DataFrame) -> DataFrame:
    """Tags before functions, each by lower-cased name, with their place as ord."""
    keys = [F.when(F.col("type") == "tag", 0).otherwise(1), F.lower("name"), "name"]
    return catalog.orderBy(*keys)


def placed(catalog: DataFrame) -> DataFrame:
    """The catalog with each entry's place in that order, from 1."""
    return catalog.withColumn("place", F.row_number().over(Window.orderBy(F.when(F.col("type") == "tag", 0).otherwise(1), F.lower("name"), "name")))


def distinct_entries(catalog: DataFrame, order: str) -> DataFrame:
    """One entry for each type and lower-cased name: the one that comes last."""
    fields = [c for c in catalog.columns if c not in ("type", order)]
    last = catalog.groupBy("type", F.lower("name").alias("key")).agg(F.max_by(F.struct(*fields), order).alias("e"))
    return last.select("type", "key", "e.*")


def of_type(catalog: DataFrame, kind: str) -> DataFrame:
    return catalog.where(F.col("type") == kind)


#: The markdown that an entry is shown in, here and in hovers().
def documentation() -> Column:
    """An entry's text in markdown."""
    line = lambda p: F.concat(F.lit("- `"), p["name"], F.lit("` ("), p["type"], F.lit(")"), F.when(p["required"], " *(required)*").otherwise(""), F.lit(" — "), first_line(p["description"]), F.lit("\n"))
    title = F.when(F.col("type") == "tag", "\n\n**Attributes:**\n").otherwise("\n\n**Parameters:**\n")
    params = F.when(F.size("params") > 0, F.concat(title, F.array_join(F.transform("params", line), ""))).otherwise("")
    returns = F.when((F.col("returns") != "") & (F.col("type") == "function"), F.concat(F.lit("\n**Returns:** `"), F.col("returns"), F.lit("`"))).otherwise("")
    return F.concat("description", params, returns)


def tag_params(requests: DataFrame, entries: DataFrame, tag: str = "tag") -> DataFrame:
    """requests x the params of the tag, in order; unknown tags have none. entries: from distinct_entries."""
    tags = of_type(entries, "tag").select("key", "params")
    found = requests.join(tags, F.lower(F.col(tag)) == F.col("key"))
    return found.select(*requests.columns, F.posexplode("params").alias("ord", "param")).select(*requests.columns, "ord", F.col("param.name").alias("param_name"), F.col("param.description").alias("param_description"), F.col("param.type").alias("param_type"), F.col("param.required").alias("param_required"))


def shown(entries: DataFrame) -> DataFrame:
    """type, key, contents: what a hover shows of each entry."""
    function = F.concat(F.lit("**"), F.col("name"), F.lit("**\n\n```cfml\n"), F.col("syntax"), F.lit("\n```\n\n"), documentation())
    tag = F.concat(F.lit("**<"), F.col("name"), F.lit(">**\n\n"), documentation())
    return entries.where(F.col("type").isin("function", "tag")).select("type", "key", F.when(F.col("type") == "function", function).otherwise(tag).alias("contents"))


def hovers(words: DataFrame, entries: DataFrame) -> DataFrame:
    """words (req_id, word) to req_id, contents: the function of that name, else the tag, else null."""
    best = shown(entries).groupBy(F.col("key").alias("_key")).agg(F.min_by("contents", "type").alias("contents"))
    return words.join(best, F.lower("word") == F.col("_key"), "left").select("req_id", "contents")
