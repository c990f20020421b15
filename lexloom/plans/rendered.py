"""Source files rendered from the table `part`, for tables that hold no source text themselves.

One function a part; files of at most 64 functions, so that no file grows with the table. Script files are one component
with a function a line; tag files have five lines a function. Every seventh part's function stands in a comment, nested
in tag files. What an extractor must find is thus a projection of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 64


def keyed(part: DataFrame) -> DataFrame:
    key = F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit("_"), F.floor(F.col("p_partkey") / ROWS).cast("string"))
    return part.select("p_partkey", "p_size", "p_type", F.col("p_brand").rlike("[02468]$").alias("script"), F.concat(F.lit("file:///shop/"), key, F.lit(".cfc")).alias("uri"))


def files(spark: SparkSession, sf_dir: str, version: int = 0) -> DataFrame:
    """uri, text. Version 1 renames the functions of parts whose size is even."""
    p = keyed(spark.read.parquet(f"{sf_dir}/part.parquet"))
    k = F.col("p_partkey").cast("string")
    name = F.concat(F.when((F.col("p_size") % 2 == 0) & F.lit(version == 1), "Renamed_").otherwise("Make_"), k)
    hidden = F.col("p_partkey") % 7 == 0
    size = F.col("p_size").cast("string")
    line = F.concat(F.lit("\tpublic string function "), name, F.lit("(required numeric size_"), size, F.lit(', string kind = "'), F.col("p_type"), F.lit('", note) { return "// no comment"; }'))
    script = F.concat(F.when(hidden, F.concat(F.lit("/*"), line, F.lit("*/"))).otherwise(line), F.lit("\n"))
    tags = F.concat(
        F.lit('<cffunction displayname="x" name="'), name, F.lit('">\n<cfargument name="size_'), size, F.lit('" type="numeric" required="true">\n<cfargument name="kind" type="string">\n'),
        F.lit('<cfargument name="note" required="no">\n</cffunction>'),
    )
    tag = F.concat(F.when(hidden, F.concat(F.lit("<!--- <!--- x ---> "), tags, F.lit(" --->"))).otherwise(tags), F.lit("\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", F.when(F.col("script"), script).otherwise(tag).alias("t")))), lambda x: x["t"]), "")
    both = p.groupBy("uri", "script").agg(body.alias("body"))
    text = F.when(F.col("script"), F.concat(F.lit("// rendered\ncomponent {\n"), "body", F.lit("}\n"))).otherwise(F.concat(F.lit("<cfcomponent>\n"), "body", F.lit("</cfcomponent>\n")))
    return both.select("uri", text.alias("text"))


#: SQL over `part`: p, the rows with file, name and place. {rename} is the condition under which a function has its new name.
ROWS_SQL = f"""
  select p_partkey, p_size, p_type, regexp_matches(p_brand, '[02468]$') as script, p_partkey % 7 = 0 as hidden,
    'file:///shop/' || replace(lower(p_brand), '#', '_') || '_' || (p_partkey // {ROWS}) || '.cfc' as uri,
    case when {{rename}} then 'Renamed_' else 'Make_' end || p_partkey as name,
    row_number() over (partition by p_brand, p_partkey // {ROWS} order by p_partkey) - 1 as place
  from part
"""
DEFS_SQL = """select uri, name, lower(name) as name_key, p_size, cast(case when script then 2 + place else 1 + 5 * place end as integer) as line from ({rows}) where not hidden"""


def defs_sql(rename: str = "false") -> str:
    return DEFS_SQL.format(rows=ROWS_SQL.format(rename=rename))


# --- the same functions as a tree of files, and in files that mix tags and scripts ---

#: The path of a file of the tree: hidden folders and files, extensions in capitals, and files that are no components.
TREE_SQL = f"""
  select *, case when b % 10 = 4 then '.' else '' end || 'brand_' || b || '/' || case when k % 7 = 2 then '_' else '' end || k
    || case when k % 5 = 4 then '.txt' when k % 3 = 1 then '.CFC' else '.cfc' end as path
  from (select *, cast(regexp_extract(uri, 'brand_(\\d+)_', 1) as integer) as b, cast(regexp_extract(uri, '_(\\d+)[.]cfc', 1) as integer) as k from ({ROWS_SQL.format(rename="false")}))
"""


def tree(spark: SparkSession, sf_dir: str, version: int = 0) -> DataFrame:
    """path, text: the rendered files under folders by brand, and one empty file."""
    b, k = (F.regexp_extract("uri", p, 1).cast("int") for p in (r"brand_(\d+)_", r"_(\d+)[.]cfc"))
    path = F.concat(
        F.when(b % 10 == 4, ".").otherwise(""), F.lit("brand_"), b.cast("string"), F.lit("/"), F.when(k % 7 == 2, "_").otherwise(""), k.cast("string"),
        F.when(k % 5 == 4, ".txt").when(k % 3 == 1, ".CFC").otherwise(".cfc"),
    )
    none = spark.range(1).select(F.lit("none/empty.cfc").alias("path"), F.lit("").alias("text"))
    return files(spark, sf_dir, version).select(path.alias("path"), "text").unionByName(none)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uri, text: a file a brand and block in which parts of even size are tag functions and others are script blocks, each part a
    line, with a blank script block before it; a part whose number 7 divides stands in a comment that begins inside its line."""
    p = keyed(spark.read.parquet(f"{sf_dir}/part.parquet"))
    k, hidden = F.col("p_partkey").cast("string"), F.col("p_partkey") % 7 == 0
    tag = F.concat(F.lit('<cffunction name="Tag_'), k, F.lit('"><cfargument name="a" type="any"></cffunction>'))
    script = F.concat(F.lit("function Script_"), k, F.lit("(required any b) {}"))
    tag = F.when(hidden, F.concat(F.lit("<!--- "), tag, F.lit(" --->"))).otherwise(tag)
    script = F.concat(F.lit("<CFScript>"), F.when(hidden, F.concat(F.lit("/* "), script, F.lit(" */"))).otherwise(script), F.lit("</cfscript>"))
    line = F.concat(F.lit("<cfscript> </cfscript>"), F.when(F.col("p_size") % 2 == 0, tag).otherwise(script), F.lit("\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("t")))), lambda x: x["t"]), "")
    return p.groupBy("uri").agg(F.concat(F.lit("<cfcomponent>\n"), body).alias("text"))
