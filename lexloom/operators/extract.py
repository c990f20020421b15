"""From source files to regions and to function definitions with their arguments.

files (uri, text) -> one Arrow pass of lexing -> a row for each region or definition. No shuffle; texts do not come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.lexing import comment_spans, definition_list, place_list, region_list


def regions(files: DataFrame) -> DataFrame:
    """uri, ord, kind, start_line, start_off, text."""
    return files.select("uri", F.posexplode(region_list("text")).alias("ord", "r")).select("uri", "ord", "r.*")


def function_defs(files: DataFrame) -> DataFrame:
    """uri, ord, name, name_key, line, arguments: the definitions of each file, those that start in a comment left out."""
    d = files.select("uri", F.posexplode(definition_list("text")).alias("ord", "d"))
    return d.select("uri", "ord", "d.name", F.lower("d.name").alias("name_key"), "d.line", "d.arguments")


def spans(files: DataFrame, key: str = "uri") -> DataFrame:
    """key, start, end: the comments of each file."""
    return files.select(key, F.explode(comment_spans("text")).alias("s")).select(key, "s.*")


def places(files: DataFrame, pattern: str, key: str = "uri", text: str = "text") -> DataFrame:
    """key, pos, hit: where the pattern is found in each file."""
    return files.select(key, F.explode(place_list(pattern)(text)).alias("p")).select(key, "p.*")
