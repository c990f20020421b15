"""The registered queries of the engine itself and their SQL.

Substrate: direct queries read the given tables' own text; rendered ones read source files rendered from `part`, and their
SQL is a projection of its rows.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.functions.lexing import comment_spans
from lexloom.operators import catalog as cat
from lexloom.operators import extract, index, places, postings, requests, tags
from lexloom.plans import rendered
from lexloom.schemas import DOC_CHANGES
from lexloom.sources import archive, config, globs
from lexloom.sources import feed as feed_source
from lexloom.sources import files as files_source
from lexloom.sources.sinks import write_catalog, write_files
from lexloom.sources.work import own_folder
from lexloom.streaming import changes as feed
from lexloom.streaming import sessions, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- direct: markup and text ---

HITS = f"unnest(regexp_extract_all(html, '{tags.EVENT}')) as hit, generate_subscripts(regexp_extract_all(html, '{tags.EVENT}'), 1) as pos"
SKIP_SQL = ", ".join(f"'{t}'" for t in [*tags.VOID, *tags.SPECIAL])
EVENTS_SQL = rf"""
  select page_id, pos, tag, delta from (
    select page_id, pos, hit,
      lower(case when starts_with(hit, '</') then regexp_extract(hit, '^</([^> \t\r\n]*)', 1) else regexp_extract(hit, '^<([^ \t\r\n/>]*)', 1) end) as tag,
      case when starts_with(hit, '</') then case when regexp_matches(hit, '[> \t\r\n]\z') then -1 else 0 end
        when regexp_extract(hit, '^<([^ \t\r\n/>]*)', 1) = '' or starts_with(hit, '<!') or ends_with(hit, '/>') or lower(regexp_extract(hit, '^<([^ \t\r\n/>]*)', 1)) in ({SKIP_SQL}) then 0 else 1 end as delta
    from (select page_id, {HITS} from pages)
  ) where delta <> 0
"""


@registered("unclosed_tags_pages", f"""
with e as ({EVENTS_SQL}), b as (select *, sum(delta) over (partition by page_id, tag order by pos) as b from e),
l as (select *, min(b) over (partition by page_id, tag order by pos rows between 1 following and unbounded following) as later from b)
select page_id, tag, cast(count(*) as bigint) as n_unclosed from l where delta = 1 and (later is null or later >= b) group by page_id, tag
""")
def unclosed_tags_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.unclosed(table(spark, sf_dir, "pages"), "html", "page_id").groupBy("page_id", "tag").agg(F.count("*").alias("n_unclosed"))


@registered("unclosed_tags_one_text", f"""
with e as ({EVENTS_SQL}), b as (select *, sum(delta) over (partition by tag order by page_id, pos) as b from e),
l as (select *, min(b) over (partition by tag order by page_id, pos rows between 1 following and unbounded following) as later from b)
select page_id, tag, cast(count(*) as bigint) as n_unclosed from l where delta = 1 and (later is null or later >= b) group by page_id, tag
""")
def unclosed_tags_one_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as one text, in order of their numbers, whose chunks are worked on side by side."""
    e = tags.events(table(spark, sf_dir, "pages"), "html", "page_id")
    whole = e.select(F.lit("all").alias("text"), (F.col("page_id") * (1 << 24) + F.col("pos")).alias("pos"), "delta", "tag")
    found = tags.still_open(whole, "text").withColumn("page_id", F.shiftright("pos", 24))
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n_unclosed"))


@registered("tag_events_pages", f"select page_id, tag, delta, cast(count(*) as bigint) as n from ({EVENTS_SQL}) group by page_id, tag, delta")
def tag_events_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.events(table(spark, sf_dir, "pages"), "html", "page_id").groupBy("page_id", "tag", "delta").agg(F.count("*").alias("n"))


@registered("void_special_tags", rf"""
select tag, tag in ({", ".join(f"'{t}'" for t in tags.VOID)}) as is_void, tag in ('cfset', 'cfelse', 'cfelseif') as is_special, cast(count(*) as bigint) as n
from (select lower(unnest(regexp_extract_all(html, '</?([A-Za-z][A-Za-z0-9]*)', 1))) as tag from pages) group by tag
""")
def void_special_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("</?([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag")).select(F.lower("tag").alias("tag"))
    return names.groupBy("tag").agg(F.count("*").alias("n")).select("tag", tags.is_void("tag").alias("is_void"), tags.is_special("tag").alias("is_special"), "n")


def at_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a cursor on one of their lines, sometimes beyond its end, and sometimes on a line that is not there."""
    lines = F.split("html", "\n", -1)
    p = table(spark, sf_dir, "pages").withColumn("line", F.pmod(F.col("page_id") * 7919, F.size(lines) + 1).cast("int"))
    own = F.coalesce(F.length(F.get(F.split("html", "\n", -1), F.col("line"))), F.lit(0))
    return p.select("page_id", "line", tx.text_before("html", "line", F.pmod(F.col("page_id") * 7907, own + 3).cast("int")).alias("before"))


BEFORE_SQL = """
select page_id, line, case when line >= len(lines) then html
  else array_to_string(lines[1:line], chr(10)) || case when line > 0 then chr(10) else '' end
    || substr(lines[line + 1] || case when line + 1 < len(lines) then chr(10) else '' end, 1, cast((page_id * 7907) % (coalesce(length(lines[line + 1]), 0) + 3) as integer)) end as before
from (select page_id, html, lines, cast((page_id * 7919) % (len(lines) + 1) as integer) as line from (select page_id, html, string_split(html, chr(10)) as lines from pages))
"""


@registered("enclosing_tag_at_cursor", rf"select page_id, line, lower(regexp_extract(before, '<[ \t]*([^ \t\r\n/<>]+)[ \t\r\n/][^<>]*\z', 1)) as tag, ends_with(before, '</') as closing, length(before) as n_before from ({BEFORE_SQL})")
def enclosing_tag_at_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_cursor(spark, sf_dir).select("page_id", "line", tx.enclosing_tag("before").alias("tag"), tx.in_closing_tag("before").alias("closing"), F.length("before").cast("long").alias("n_before"))


@registered("word_at_cursor", r"""
with d as (select doc_id, lines, (doc_id * 13) % (len(lines) + 1) as line from (select doc_id, string_split(text, chr(10)) as lines from documents)),
o as (select doc_id, coalesce(lines[line + 1], '') as own, cast((doc_id * 31) % (length(coalesce(lines[line + 1], '')) + 2) as integer) as c from d)
select doc_id, regexp_extract(substr(own, 1, least(c, length(own))), '[A-Za-z0-9_]*\z') || regexp_extract(substr(own, least(c, length(own)) + 1), '^[A-Za-z0-9_]*') as word from o
""")
def word_at_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    d = table(spark, sf_dir, "documents").withColumn("line", F.pmod(F.col("doc_id") * 13, F.size(lines) + 1).cast("int"))
    own = F.coalesce(F.length(F.get(F.split("text", "\n", -1), F.col("line"))), F.lit(0))
    return d.select("doc_id", tx.word_at("text", "line", F.pmod(F.col("doc_id") * 31, own + 2).cast("int")).alias("word"))


@registered("line_counts", "select doc_id, cast(length(text) - length(replace(text, chr(10), '')) as bigint) as n_lines, split(text, chr(10))[1] as first_line from documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.newlines("text").cast("long").alias("n_lines"), tx.first_line("text").alias("first_line"))


@registered("document_state", """
select user_id, event_id as seq, event_type as text from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1 and event_type <> 'purchase'
""")
def document_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last event is their document's text; a purchase closes it. Arrival order is time, then event."""
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    last = e.select("user_id", order.alias("seq"), F.when(F.col("event_type") == "purchase", "close").otherwise("change").alias("op"), F.array("event_type").alias("changes"))
    return feed.document_state(last, "user_id").select("user_id", F.col("seq.event_id").alias("seq"), "text")


@registered("socket_names", "select n_nationkey, substr(sha256(n_name), 1, 16) as socket from nation")
def socket_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.socket_name("n_name").alias("socket"))


@registered("page_path_globs", r"""
select page_id, regexp_replace(url, '^https?://', '/') as path, regexp_matches(regexp_replace(url, '^https?://', '/'), '\A/[^/]*/en/[^/]*\z') as one_level,
  starts_with(regexp_replace(url, '^https?://', '/'), '/m.ththth.example.net/') and regexp_matches(regexp_replace(url, '^https?://', '/'), '/[^/]*5[^/]*\z') as any_level from pages
""")
def page_path_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "/")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), globs.matches(path, ["/*/en/*"]).alias("one_level"), globs.matches(path, ["/m.ththth.example.net/**/*5*"]).alias("any_level"))


@registered("json_literals", "select p_partkey, cast(to_json(p_name || chr(10) || '\"' || p_type) as varchar) as literal from part")
def json_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.json_literal(F.concat("p_name", F.lit('\n"'), "p_type")).alias("literal"))


@registered("session_documents", """
select user_id, event_type as uri, event_id as seq, props as text from (
  select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) where k = 1 and value >= 20
""")
def session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's own documents: a user is a session, an event type a document, and a last event of small value closes it."""
    e = table(spark, sf_dir, "events")
    changes = e.select("user_id", F.col("event_type").alias("uri"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("value") >= 20, "change").otherwise("close").alias("op"), F.array("props").alias("changes"))
    return feed.document_state(changes, "user_id", "uri").select("user_id", "uri", F.col("seq.event_id").alias("seq"), "text")


@registered("resolved_globs", """
select n_name || '/**/*.cfc' as glob, '/abs/' || r_regionkey || '/' || r_name || '/**/*.cfc' as resolved from nation join region on n_name = r_name
union all select r_name || '/x', '/abs/' || r_regionkey || '/' || r_name || '/x' from region
""")
def resolved_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs by nation and region, folders by region: nations are in no folder, so their globs are dropped."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    path = F.concat(F.lit("/abs/"), F.col("r_regionkey").cast("string"), F.lit("/"), "r_name")
    folders = region.select(F.col("r_regionkey").alias("ord"), path.alias("path")).unionByName(region.select((F.col("r_regionkey") - 100).alias("ord"), F.concat(F.lit("/old/"), "r_name").alias("path")))
    globs_ = nation.select(F.concat("n_name", F.lit("/**/*.cfc")).alias("glob")).unionByName(region.select(F.concat("r_name", F.lit("/x")).alias("glob")))
    return config.resolved_globs(globs_, folders)


# --- rendered: source files ---


def files(spark: SparkSession, sf_dir: str, version: int = 0) -> DataFrame:
    return rendered.files(spark, sf_dir, version)


def defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.function_defs(files(spark, sf_dir))


def stored(spark: SparkSession, defs: DataFrame) -> DataFrame:
    """The index as a table, which may be read more than once without lexing the files again."""
    path = own_folder(spark, "index")
    defs.write.parquet(path)
    return spark.read.schema(defs.schema).parquet(path)


DEFS = rendered.defs_sql()


@registered("comment_spans", f"""
select uri, cast(max(place) + 1 as bigint) as n_functions, cast(count(*) filter (hidden) + (case when bool_or(script) then 1 else 0 end) as bigint) as n_spans
from ({rendered.ROWS_SQL.format(rename="false")}) group by uri
""")
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("uri", F.size(comment_spans("text")).cast("long").alias("n_spans"), F.regexp_count("text", F.lit("Make_")).cast("long").alias("n_functions"))
    return f.select("uri", "n_functions", "n_spans")


@registered("regions", f"""
select uri, 0 as ord, case when bool_or(script) then 'script' else 'tag' end as kind, 0 as start_line from ({rendered.ROWS_SQL.format(rename="false")}) group by uri
""")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.regions(files(spark, sf_dir)).select("uri", "ord", "kind", "start_line")


@registered("function_defs", f"select uri, name, name_key, line from ({DEFS})")
def function_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defs(spark, sf_dir).select("uri", "name", "name_key", "line")


@registered("function_args", f"""
select uri, name, a.pos, a.arg_name, a.arg_type, a.required from ({DEFS}) d, lateral (
  select 0 as pos, 'size_' || d.p_size as arg_name, 'numeric' as arg_type, true as required union all select 1, 'kind', 'string', false union all select 2, 'note', '', false) a
""")
def function_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = defs(spark, sf_dir).select("uri", "name", F.posexplode("arguments").alias("pos", "a"))
    return a.select("uri", "name", "pos", F.col("a.name").alias("arg_name"), F.col("a.type").alias("arg_type"), F.col("a.required").alias("required"))


@registered("inverted_index", f"select name_key, cast(count(*) as bigint) as n, min(uri) as first_uri, min(line) as first_line from ({DEFS}) group by name_key")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct(F.col("definitions")[0]["uri"].alias("uri"), F.col("definitions")[0]["line"].alias("line")))
    d = index.inverted(stored(spark, defs(spark, sf_dir))).groupBy("name_key").agg(F.sum(F.size("definitions")).alias("n"), first.alias("first"))
    return d.select("name_key", "n", F.col("first.uri").alias("first_uri"), F.col("first.line").alias("first_line"))


@registered("inverted_hot_name", f"""
select name_key, cast(count(*) as bigint) as n, min(uri) as first_uri, max(uri) as last_uri from (
  select uri, name_key from ({DEFS}) union all select distinct uri, 'init' from ({rendered.ROWS_SQL.format(rename="false")})) group by name_key
""")
def inverted_hot_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a function of the same name in every file, which is cut into several arrays."""
    every = F.concat(F.regexp_replace("text", r"\}\n\z|</cfcomponent>\n\z", ""), F.when(F.col("text").startswith("<"), '<cffunction name="Init"></cffunction>').otherwise("function init() {} }"))
    d = index.inverted(stored(spark, extract.function_defs(files(spark, sf_dir).withColumn("text", every))), part=16)
    uri = lambda at: F.element_at("definitions", at)["uri"]
    return d.groupBy("name_key").agg(F.sum(F.size("definitions")).alias("n"), F.min(uri(1)).alias("first_uri"), F.max(uri(-1)).alias("last_uri"))


@registered("definition_lookup", f"""
select l_orderkey, l_linenumber, uri, line from lineitem join ({DEFS}) d on 'make_' || l_partkey = d.name_key
""")
def definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("MAKE_"), F.col("l_partkey").cast("string")).alias("word"))
    return index.lookup(asked, defs(spark, sf_dir).select("name_key", "uri", "line")).select("l_orderkey", "l_linenumber", "uri", "line")


@registered("workspace_symbol", f"""
select cast(n_nationkey as bigint) as req_id, name, uri, line from nation join ({DEFS}) d on contains(d.name_key, lower('E_' || n_nationkey))
""")
def workspace_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("req_id"), F.concat(F.lit("E_"), F.col("n_nationkey").cast("string")).alias("query"))
    return requests.workspace_symbols(asked, defs(spark, sf_dir))


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version of the files of which some have changed."""
    return files(spark, sf_dir, 1).where(F.col("uri").rlike("[02468][.]cfc$"))


@registered("index_upsert", f"""
select uri, name, line from ({DEFS}) where not regexp_matches(uri, '[02468][.]cfc$')
union all select uri, name, line from ({rendered.defs_sql("p_size % 2 = 0")}) where regexp_matches(uri, '[02468][.]cfc$')
""")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.upserted(defs(spark, sf_dir), touched(spark, sf_dir)).select("uri", "name", "line")


@registered("prefix_delete", f"select uri, name, line from ({DEFS}) where not starts_with(uri, 'file:///shop/brand_1') and not starts_with(uri, 'file:///shop/brand_23_')")
def prefix_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = spark.sql("select * from values ('file:///shop/brand_1'), ('file:///shop/brand_23_'), ('file:///shop/brand_3') as t(uri)")
    protected = spark.sql("select '/shop/brand_3' as path")
    return index.without_prefix(defs(spark, sf_dir), removed, protected).select("uri", "name", "line")


@registered("prefix_delete_many", f"""
select uri, name, line from ({DEFS}) where not exists (select 1 from (select distinct 'file:///shop/brand_' || (11 + o_orderkey % 6 * 7) || '_' || (o_orderkey % 7) as p from orders) where starts_with(uri, p))
""")
def prefix_delete_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many removed prefixes as there are orders, of several lengths, some beginning with others."""
    k = F.col("o_orderkey")
    removed = table(spark, sf_dir, "orders").select(F.concat(F.lit("file:///shop/brand_"), (k % 6 * 7 + 11).cast("string"), F.lit("_"), (k % 7).cast("string")).alias("uri"))
    longer = table(spark, sf_dir, "orders").select(F.concat(F.lit("file:///shop/brand_"), (k % 6 * 7 + 11).cast("string"), F.lit("_"), (k % 7).cast("string"), F.lit("/"), F.repeat(F.lit("x"), (k % 200).cast("int"))).alias("uri"))
    return index.without_prefix(defs(spark, sf_dir), removed.unionByName(longer)).select("uri", "name", "line")


@registered("stored_symbols", f"""
with q as (select cast(p_partkey as bigint) as req_id, case p_partkey % 4 when 0 then 'E_' || p_partkey when 1 then 'named_' || p_partkey when 2 then right('' || p_partkey, 2) || 'x' else 'MAKE_' || p_partkey end as query from part),
d as (select uri, name, line from ({DEFS}) where not regexp_matches(uri, '[02468][.]cfc$') union all select uri, name, line from ({rendered.defs_sql("p_size % 2 = 0")}) where regexp_matches(uri, '[02468][.]cfc$'))
select req_id, name, uri, line from q join d on contains(lower(d.name), lower(q.query))
""")
def stored_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lists written from the index, extended by what changed files define, then asked a query a part; names that are gone are
    found no more."""
    path = own_folder(spark, "postings")
    before, changed = stored(spark, defs(spark, sf_dir)), touched(spark, sf_dir)
    postings.write_postings(before, path, 16)
    now = stored(spark, index.upserted(before, changed))
    postings.extend_postings(spark, path, now, 16)
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    query = F.when(k % 4 == 0, F.concat(F.lit("E_"), text)).when(k % 4 == 1, F.concat(F.lit("named_"), text)).when(k % 4 == 2, F.concat(F.substring(text, -2, 2), F.lit("x"))).otherwise(F.concat(F.lit("MAKE_"), text))
    asked = table(spark, sf_dir, "part").select(k.cast("long").alias("req_id"), query.alias("query"))
    return postings.search(asked, now, path, 16)


@registered("indexed_files", f"select distinct uri from ({rendered.ROWS_SQL.format(rename='false')}) where starts_with(uri, 'file:///shop/brand_4')")
def indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.accepts(files(spark, sf_dir), ["/shop"], ["/shop/**/brand_4*.cfc"]).select("uri")


@registered("folder_changes", f"""
select uri, name, line from ({DEFS}) where not starts_with(uri, 'file:///shop/brand_2') and not regexp_matches(uri, '[13579][.]cfc$')
union all select uri, name, line from ({rendered.defs_sql("p_size % 2 = 0")}) where regexp_matches(uri, '[13579][.]cfc$')
""")
def folder_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders go, one of them protected, then one is added whose scan finds the second version of some files."""
    changes = spark.sql("select * from values (1L, 'removed', 'file:///shop/brand_2'), (2L, 'removed', 'file:///shop/brand_3'), (3L, 'added', 'file:///new') as t(seq, op, uri)")
    scan = lambda folders: files(spark, sf_dir, 1).where(F.col("uri").rlike("[13579][.]cfc$"))
    return feed.folders_changed(defs(spark, sf_dir), changes, spark.sql("select '/shop/brand_3' as path"), scan).select("uri", "name", "line")


@registered("catalog_order", f"""
select type, name, cast(row_number() over (order by type desc, lower(name), name) as integer) as place from (
  select 'tag' as type, name from ({{tags}}) union all select 'function', 'To' || replace(n_name, ' ', '') from nation)
""".replace("{tags}", "select 'cf' || lower(replace(r_name, ' ', '')) as name from region"))
def catalog_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the catalog's order; a catalog is a few thousand entries, so one window over all of it will do."""
    return cat.placed(catalog(spark, sf_dir)).select("type", "name", "place")


# --- rendered: catalog. Regions are tags, nations their attributes; order priorities are functions. ---


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    param = F.struct(F.lower("n_name").alias("name"), F.concat(F.lit("Attribute "), "n_name", F.lit("\nmore")).alias("description"), F.lit("string").alias("type"), (F.col("n_nationkey") % 2 == 0).alias("required"))
    params = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", param.alias("p")))).alias("ps"))
    tag = table(spark, sf_dir, "region").join(params, "r_regionkey", "left").select(
        F.concat(F.lit("cf"), F.lower(F.replace("r_name", F.lit(" "), F.lit("")))).alias("name"), F.concat(F.lit("Tag "), "r_name").alias("description"), F.lit("").alias("syntax"), F.lit("").alias("returns"),
        F.lit("tag").alias("type"), F.coalesce(F.transform("ps", lambda x: x["p"]), F.array().cast("array<struct<name:string,description:string,type:string,required:boolean>>")).alias("params"), F.col("r_regionkey").cast("int").alias("ord"),
    )
    arg = F.array(F.struct(F.lit("value").alias("name"), F.lit("a value").alias("description"), F.lit("any").alias("type"), F.lit(True).alias("required")))
    function = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("To"), F.replace("n_name", F.lit(" "), F.lit(""))).alias("name"), F.concat(F.lit("Makes "), "n_name").alias("description"), F.concat(F.lit("To"), "n_name", F.lit("(value)")).alias("syntax"), F.lit("string").alias("returns"),
        F.lit("function").alias("type"), arg.alias("params"), F.col("n_nationkey").cast("int").alias("ord"),
    )
    return tag.unionByName(function)


TAGS_SQL = "select r_regionkey, 'cf' || lower(replace(r_name, ' ', '')) as name, 'Tag ' || r_name as description from region"


@registered("catalog_filter", f"select 'tag' as type, name, description, cast(r_regionkey as integer) as ord from ({TAGS_SQL}) union all select 'function', 'To' || replace(n_name, ' ', ''), 'Makes ' || n_name, cast(n_nationkey as integer) from nation")
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return cat.in_order(cat.of_type(c, "tag").unionByName(cat.of_type(c, "function"))).select("type", "name", "description", "ord")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a second entry of every name in capitals, which comes first and so loses."""
    c = catalog(spark, sf_dir)
    twice = c.withColumns({"name": F.upper("name"), "description": F.lit("old"), "ord": F.col("ord") - 100})
    return cat.distinct_entries(twice.unionByName(c), "ord")


@registered("catalog_params", f"""
select t.name as tag, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as integer) as ord, lower(n_name) as param_name, n_nationkey % 2 = 0 as param_required
from ({TAGS_SQL}) t join nation on n_regionkey = r_regionkey
""")
def catalog_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "region").select(F.concat(F.lit("cf"), F.lower(F.replace("r_name", F.lit(" "), F.lit("")))).alias("tag"))
    return cat.tag_params(asked, entries(spark, sf_dir)).select("tag", "ord", "param_name", "param_required")


@registered("hover", """
with p as (select n_regionkey, string_agg('- `' || lower(n_name) || '` (string)' || case when n_nationkey % 2 = 0 then ' *(required)*' else '' end || ' — Attribute ' || n_name || chr(10), '' order by n_nationkey) as lines from nation group by n_regionkey)
select cast(r_regionkey as bigint) as req_id, '**<cf' || lower(replace(r_name, ' ', '')) || '>**' || chr(10) || chr(10) || 'Tag ' || r_name || coalesce(chr(10) || chr(10) || '**Attributes:**' || chr(10) || lines, '') as contents
from region left join p on n_regionkey = r_regionkey
union all select 1000 + n_nationkey, '**To' || replace(n_name, ' ', '') || '**' || chr(10) || chr(10) || '```cfml' || chr(10) || 'To' || n_name || '(value)' || chr(10) || '```' || chr(10) || chr(10)
  || 'Makes ' || n_name || chr(10) || chr(10) || '**Parameters:**' || chr(10) || '- `value` (any) *(required)* — a value' || chr(10) || chr(10) || '**Returns:** `string`' from nation
""")
def hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through whole requests: one document a name, the cursor inside the name; words that are in no catalog have no answer."""
    name = F.replace("w", F.lit(" "), F.lit(""))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("req_id"), F.concat(F.lit("CF"), F.replace("r_name", F.lit(" "), F.lit(""))).alias("w"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("req_id"), F.concat(F.lit("to"), "n_name").alias("w"))
    other = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 5000).cast("long").alias("req_id"), F.lit("nothing").alias("w"))
    asked = r.unionByName(n).unionByName(other).select("req_id", F.concat(F.lit("file:///w/"), F.col("req_id").cast("string")).alias("uri"), F.lit(1).alias("line"), F.lit(4).alias("character"), F.concat(F.lit("x = 1\n  "), name, F.lit("(2)\n")).alias("text"))
    return requests.hover(asked, asked.select("uri", "text"), entries(spark, sf_dir))


@registered("completion", f"""
with q as (select cast(page_id as bigint) as req_id, page_id % 4 as arm, page_id % 5 as r from pages),
f as (select 'To' || replace(n_name, ' ', '') as label, 'To' || n_name || '(value)' as detail, 'Makes ' || n_name as documentation, cast(n_nationkey as integer) as ord from nation)
select req_id, x.ord, x.label, 'keyword' as kind, 'Close tag' as detail, '' as documentation, x.label || '>' as insert_text, '' as insert_text_format from q, lateral (select 0 as ord, 'cfloop' as label union all select 1, 'cfoutput') x where arm = 0
union all select req_id, cast(row_number() over (partition by req_id order by n_nationkey) - 1 as integer), lower(n_name), 'property', 'Attribute ' || n_name || chr(10) || 'more', '', lower(n_name) || '="$1"', 'snippet' from q join nation on n_regionkey = r where arm = 1
union all select req_id, cast(r_regionkey as integer), name, 'keyword', description, '', '', '' from q, ({TAGS_SQL}) where arm = 2
union all select req_id, ord, label, 'function', detail, documentation, '', 'plaintext' from q, f where arm = 3
""")
def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a page, of the four kinds in turn."""
    arm, page = F.pmod("page_id", F.lit(4)), table(spark, sf_dir, "pages").select("page_id", F.pmod("page_id", F.lit(5)).alias("r"))
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.lower(F.replace("r_name", F.lit(" "), F.lit(""))).alias("region"))
    text = F.when(arm == 0, "<cfoutput>\n<CFLOOP a='1'><cfset x = 1><cfif y></cfif></").when(arm == 1, F.concat(F.lit("<b>1</b>\n<cf"), "region", F.lit(" "))).when(arm == 2, "x\n<").otherwise("x\n ")
    asked = page.join(names, "r").select(F.col("page_id").cast("long").alias("req_id"), F.concat(F.lit("file:///w/"), F.col("page_id").cast("string")).alias("uri"), F.lit(1).alias("line"), F.lit(200).alias("character"), F.when(arm == 2, "trigger_char").otherwise("invoked").alias("trigger_kind"), F.when(arm == 2, "<").alias("trigger_char"), text.alias("text"))
    return requests.completions(asked, asked.select("uri", "text"), catalog(spark, sf_dir), entries(spark, sf_dir))


@registered("document_symbols", f"select cast(part.p_partkey as bigint) as req_id, d.name, d.line from part join ({DEFS}) d on d.uri = 'file:///shop/' || replace(lower(p_brand), '#', '_') || '_' || (part.p_partkey // {rendered.ROWS}) || '.cfc'")
def document_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request a part, each for the file that renders it."""
    asked = rendered.keyed(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("req_id"), "uri")
    return requests.document_symbols(asked, files(spark, sf_dir)).select("req_id", "name", "line")


@registered("definition_requests", f"""
with q as (select p_partkey as req_id, 'make_' || p_partkey as k from part)
select q.req_id, d.uri, d.line, cast(count(*) over (partition by q.req_id) as integer) as n_locations from q join ({DEFS}) d on d.name_key = q.k
""")
def definition_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request a part, with the cursor in a call of its function."""
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("req_id"), F.concat(F.lit("file:///use/"), F.col("p_partkey").cast("string"), F.lit(".cfm")).alias("uri"), F.lit(0).alias("line"), F.lit(8).alias("character"), F.concat(F.lit("x.do("), F.lit("make_"), F.col("p_partkey").cast("string"), F.lit("());")).alias("text"))
    return requests.definitions(asked, asked.select("uri", "text"), defs(spark, sf_dir))


# --- real files: written below the shared folder, then scanned ---


def written_tree(spark: SparkSession, sf_dir: str) -> str:
    """The rendered tree of files in a folder of its own; its path on the shared file system."""
    root = own_folder(spark, "tree")
    write_files(rendered.tree(spark, sf_dir), root)
    return root


def below(root: str) -> Column:
    """The path below the root."""
    return F.element_at(F.split("uri", re.escape(root.rpartition("/")[2]) + "/", 2), 2)


@registered("source_scan", f"""
select path, cast(case when bool_or(script) then count(*) + 3 else 5 * count(*) + 2 end as bigint) as n_lines from ({rendered.TREE_SQL}) where not ends_with(path, '.txt') group by path
union all select 'none/empty.cfc', 0
""")
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with hidden and empty files, capitals in extensions and other files."""
    root = written_tree(spark, sf_dir)
    return files_source.scan(spark, [root]).select(below(root).alias("path"), tx.newlines("text").cast("long").alias("n_lines"))


@registered("mixed_paths_scan", f"select distinct path from ({rendered.TREE_SQL}) where not ends_with(path, '.txt') and (b = 12 or path = 'brand_13/0.cfc' or regexp_matches(path, '^brand_[1-3][^/]*/[0-3][.]cfc$') or ends_with(path, '5.cfc'))")
def mixed_paths_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder, a file, a glob of one level, one of any level and a missing path, which overlap."""
    root = written_tree(spark, sf_dir)
    paths = ["brand_12", "brand_13/0.cfc", "brand_[1-3]*/[0-3].cfc", "**/*5.cfc", "brand_99"]
    return files_source.scan(spark, [f"{root}/{p}" for p in paths]).select(below(root).alias("path"))


@registered("workspace_defs", f"""
select path, name, line from (select path, name, cast(case when script then 2 + place else 1 + 5 * place end as integer) as line, hidden, b from ({rendered.TREE_SQL})) where not hidden and ends_with(path, '.cfc') and b // 10 = 2
""")
def workspace_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace with a configuration file of folders and globs, scanned and extracted; globs whose folder is not configured drop out."""
    root = written_tree(spark, sf_dir)
    paths = [f"{'.' if b % 10 == 4 else ''}brand_{b}" for b in range(20, 30)]
    text = json.dumps({"workspaceName": "shop", "workspacePaths": paths, "workspaceIndexGlobs": [f"{p}/**/*.cfc" for p in paths] + ["elsewhere/**"]})
    write_files(spark.createDataFrame([(config.FILE, text), ("brand_20/" + config.FILE, "{ broken")], "path string, text string"), root)
    c = config.find_config(f"{root}/brand_20")
    found = files_source.scan_workspace(spark, c.folders(), c.index_globs(), [root])
    return extract.function_defs(found).select(below(root).alias("path"), "name", "line")


MIXED_SQL = f"""
  select uri, p_partkey, p_size % 2 = 0 as tag, p_partkey % 7 = 0 as hidden, 1 + place as line from ({rendered.ROWS_SQL.format(rename="false")})
"""


@registered("mixed_regions", f"""
select uri, kind, start_line from (
  select uri, 'tag' as kind, 0 as start_line from ({MIXED_SQL}) group by uri
  union all select uri, case when tag then 'tag' else 'script' end, cast(line as integer) from ({MIXED_SQL}))
""")
def mixed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of tags and script blocks in turn; blank regions are left out."""
    return extract.regions(rendered.mixed(spark, sf_dir)).select("uri", "kind", "start_line")


PLACED_SQL = f"""
  select uri, tag, hidden, whole, 14 + coalesce(sum(22 + length(whole) + case when tag then 0 else 21 end + 1) over (partition by uri order by p_partkey rows between unbounded preceding and 1 preceding), 0) + 22 as base
  from (select *, case when hidden then case when tag then '<!--- ' || plain || ' --->' else '/* ' || plain || ' */' end else plain end as whole
    from (select *, case when tag then '<cffunction name="Tag_' || p_partkey || '"><cfargument name="a" type="any"></cffunction>' else 'function Script_' || p_partkey || '(required any b) {{}}' end as plain from ({MIXED_SQL})))
"""


@registered("region_texts", f"""
select uri, 'tag' as kind, 0 as start_off, '<cfcomponent>' || chr(10) as text from ({PLACED_SQL}) group by uri
union all select uri, case when tag then 'tag' else 'script' end, cast(base + case when tag then 0 else 10 end as integer), whole || case when tag then chr(10) else '' end from ({PLACED_SQL})
""")
def region_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each region of a mixed file begins, and its text."""
    return extract.regions(rendered.mixed(spark, sf_dir)).select("uri", "kind", "start_off", "text")


@registered("comment_places", f"""
select uri, cast(base + case when tag then 0 else 10 end as integer) as "start", cast(base + case when tag then 0 else 10 end + length(whole) as integer) as "end", whole as text from ({PLACED_SQL}) where hidden
""")
def comment_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each comment of a mixed file begins and ends, and its text."""
    f = rendered.mixed(spark, sf_dir)
    s = extract.spans(f).select("uri", "start", "end")
    return s.join(f, "uri").select("uri", "start", "end", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


@registered("mixed_defs", f"""
select uri, case when tag then 'Tag_' else 'Script_' end || p_partkey as name, cast(line as integer) as line, case when tag then 'a' else 'b' end as arg_name, not tag as required from ({MIXED_SQL}) where not hidden
""")
def mixed_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.function_defs(rendered.mixed(spark, sf_dir)).select("uri", "name", "line", F.explode("arguments").alias("a"))
    return d.select("uri", "name", "line", F.col("a.name").alias("arg_name"), F.col("a.required").alias("required"))


@registered("catalog_from_json", f"""
select 'tag' as type, name, description, cast(r_regionkey as bigint) as n_params_or_key from ({TAGS_SQL}) union all select 'function', 'To' || replace(n_name, ' ', ''), 'Makes ' || n_name, 1 from nation
""")
def catalog_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file an entry, some of them malformed or of another type, read and put in order."""
    c = catalog(spark, sf_dir)
    entry = F.to_json(F.struct(*(F.col(x) for x in c.columns if x != "ord"), F.lit(1).alias("unknown")))
    rows = c.select(F.concat("type", F.lit("/"), "name", F.lit(".json")).alias("path"), entry.alias("text"), F.col("ord"))
    bad = spark.createDataFrame([("tag/bad.json", "{ broken"), ("tag/member.json", '{"name": "m", "type": "member"}'), ("tag/note.txt", '{"name": "t", "type": "tag"}')], "path string, text string")
    root = own_folder(spark, "catalog")
    write_files(rows.select("path", "text").unionByName(bad), root)
    found = cat.in_order(cat.read_catalog(spark, f"{root}/tag").unionByName(cat.read_catalog(spark, f"{root}/function")))
    key = table(spark, sf_dir, "region").select(F.concat(F.lit("cf"), F.lower(F.replace("r_name", F.lit(" "), F.lit("")))).alias("name"), F.col("r_regionkey").cast("long").alias("key"))
    return found.join(key, "name", "left").select("type", "name", "description", F.coalesce("key", F.size("params").cast("long")).alias("n_params_or_key"))


@registered("catalog_written", f"""
select type, name, cast(row_number() over (order by type desc, lower(name), name) as integer) as place, n_params from (
  select 'tag' as type, name, cast((select count(*) from nation where n_regionkey = r_regionkey) as integer) as n_params from ({TAGS_SQL}) union all select 'function', 'To' || replace(n_name, ' ', ''), 1 from nation)
""")
def catalog_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as a table, written in its order and read back."""
    path = own_folder(spark, "catalog")
    write_catalog(catalog(spark, sf_dir), path)
    return spark.read.parquet(path).select("type", "name", "place", F.size("params").alias("n_params"))


@registered("document_changes", """
with e as (select user_id, event_type, event_id, ts, value, case event_id % 4 when 0 then null when 1 then event_type when 2 then 'second' else 'third' end as text from events),
k as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from e where text is not null or value < 20)
select user_id, event_type as uri, event_id as seq, text from k where k = 1 and value >= 20
""")
def document_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opens and changes of none, one and several elements; only the last one of a change counts, and one of none changes nothing."""
    e, n = table(spark, sf_dir, "events"), F.pmod("event_id", F.lit(4))
    changes = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array("event_type")).when(n == 2, F.array(F.lit("first"), F.lit("second"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("third")))
    op = F.when(F.col("value") < 20, "close").when(n == 1, "open").otherwise("change")
    rows = e.select("user_id", F.col("event_type").alias("uri"), F.struct("ts", "event_id").alias("seq"), op.alias("op"), changes.alias("changes"))
    return feed.document_state(rows, "user_id", "uri").select("user_id", "uri", F.col("seq.event_id").alias("seq"), "text")


@registered("included_files", f"""
select distinct case when k % 2 = 0 then uri when k % 3 = 0 then replace(uri, '.cfc', '.CFC') end as uri
from ({rendered.TREE_SQL}) where (k % 2 = 0 or k % 3 = 0) and substr(cast(b as varchar), 1, 1) in ('1', '3')
""")
def included_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited files, of which some are no components and some in no configured folder, whose name another folder's begins with."""
    k, b = F.regexp_extract("uri", r"_(\d+)[.]cfc", 1).cast("int"), F.regexp_extract("uri", r"brand_(\d+)_", 1)
    ending = F.when(k % 2 == 0, ".cfc").when(k % 3 == 0, ".CFC").otherwise(".cfm")
    f = files(spark, sf_dir).select(F.concat(F.lit("file:///shop/b"), F.substring(b, 1, 1), F.lit("/"), F.regexp_replace("uri", "^file:///shop/|[.]cfc$", ""), ending).alias("uri"), "text")
    return index.accepts(f, ["/shop/b1", "/shop/b3", "/shop/b"], []).select(F.concat(F.lit("file:///shop/"), F.substring_index("uri", "/", -1)).alias("uri"))


@registered("workspace_feed", f"""
select uri, name, line from ({rendered.defs_sql("p_size % 2 = 0")}) where regexp_matches(uri, '[02468][.]cfc$') and not starts_with(uri, 'file:///shop/brand_1')
union all select uri, name, line from ({DEFS}) where not regexp_matches(uri, '[02468][.]cfc$') and not starts_with(uri, 'file:///shop/brand_1')
union all select uri, name, line from ({rendered.defs_sql("p_size % 2 = 0")}) where starts_with(uri, 'file:///shop/brand_13_')
""")
def workspace_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace that takes its files from two sessions in two micro-batches: all are opened; then some change, a folder goes, and files
    of it are changed again. A second Workspace over the same folder takes the second batch."""
    root = own_folder(spark, "workspace")
    rows = lambda f, seq, op: f.select(F.lit(seq).cast("long").alias("seq"), F.when(F.col("uri").rlike("[02468][.]cfc$"), "a").otherwise("b").alias("session_id"), F.lit(op).alias("op"), "uri", F.array(F.lit("old"), "text").alias("changes"))
    gone = spark.createDataFrame([(3, None, "folder_removed", "file:///shop/brand_1", None)], DOC_CHANGES)
    second = files(spark, sf_dir, 1)
    feed.Workspace(spark, root, buckets=16).start().take(rows(files(spark, sf_dir), 1, "open"), 0)
    w = feed.Workspace(spark, root)
    w.take(rows(touched(spark, sf_dir), 2, "change").unionByName(gone).unionByName(rows(second.where("uri like 'file:///shop/brand_13\\\\_%'"), 4, "change")), 1)
    return w.defs.select("uri", "name", "line")


@registered("catalog_from_archive", f"select 'tag' as type, name, description, 1 as n_reads from ({TAGS_SQL}) union all select 'function', 'To' || replace(n_name, ' ', ''), 'Makes ' || n_name, 1 from nation")
def catalog_from_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog's JSON files in an archive inside an archive, unpacked once although it is asked for twice."""
    root = own_folder(spark, "archive")
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        for r in catalog(spark, sf_dir).drop("ord").collect():  # a catalog, which is made into one archive here
            z.writestr(f"docs/{r.type}-{r.name}.json", json.dumps(r.asDict(recursive=True)))
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("json.zip", inner.getvalue())
        z.writestr("readme.txt", "none")
    fs, path, _ = files_source.opened(root)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/docs.zip") as out:
        out.write(outer.getvalue())
    reads = sum(archive.refreshed(f"{root}/docs.zip", f"{root}/data") for _ in range(2))
    return cat.read_catalog(spark, f"{root}/data").select("type", "name", "description", F.lit(reads).alias("n_reads"))


DELTA_SQL = "case when event_type = 'error' or value < 20 then -1 else 1 end"


@registered("live_sessions", f"""
select event_id as seq, live, coalesce(live = 0 and delta < 0 and event_id = min(case when live = 0 and delta < 0 then event_id end) over (), false) as first_without from (
  select event_id, {DELTA_SQL} as delta, cast(sum({DELTA_SQL}) over (order by event_id) as bigint) as live from events)
""")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sessions that begin and end, in order of their numbers."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when((F.col("event_type") == "error") | (F.col("value") < 20), -1).otherwise(1).alias("delta"))
    first = sessions.first_without(e).select(F.col("seq").alias("_first"))
    return sessions.live(e).join(first, F.col("seq") == F.col("_first"), "left").select("seq", "live", F.col("_first").isNotNull().alias("first_without"))


@registered("capabilities", "select n_nationkey as req_id, 'full' as change, '< /' as triggers, true as hover from nation")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("req_id"))
    return requests.dispatch("initialize")(asked).select("req_id", "change", F.array_join("trigger_characters", "").alias("triggers"), "hover")


# --- streamed: events as editors' notifications, in lots that a stream takes one run after the other ---

LOTS, IDLE_MS = 3, 20 * 24 * 3_600_000  # runs of the stream; a document without a change for so long is given up


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, at, session_id, op, uri, changes: a user is a session, an event type a document; small values close it, and of large ones
    each eleventh is a change of folders."""
    e, n = table(spark, sf_dir, "events"), F.pmod("event_id", F.lit(4))
    texts = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array("props")).when(n == 2, F.array(F.lit("first"), "props")).otherwise(F.array(F.lit("a"), F.lit("b"), F.concat("props", F.lit('\n"é"'))))
    op = F.when(F.col("event_id") % 11 == 0, F.when(n < 2, "folder_added").otherwise("folder_removed")).when(F.col("value") < 5, "close").when(n == 1, "open").otherwise("change")
    return e.select(
        F.col("event_id").alias("seq"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("at"), F.col("user_id").cast("string").alias("session_id"), op.alias("op"),
        F.concat(F.lit("file:///w/"), "event_type", F.when(op.startswith("folder"), "").otherwise(".cfc")).alias("uri"), F.when(op.isin("open", "change"), texts).alias("changes"),
    )


NOTIFICATIONS_SQL = """
  select event_id as seq, epoch_us(ts) // 1000 as "at", cast(user_id as varchar) as session_id, op, 'file:///w/' || event_type || case when starts_with(op, 'folder') then '' else '.cfc' end as uri,
    case when op in ('open', 'change') then case event_id % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 3 end end as n_changes,
    case when op in ('open', 'change') and event_id % 4 > 0 then props || case when event_id % 4 = 3 then chr(10) || '"é"' else '' end end as text
  from (select *, case when event_id % 11 = 0 then case when event_id % 4 < 2 then 'folder_added' else 'folder_removed' end
    when value < 5 then 'close' when event_id % 4 = 1 then 'open' else 'change' end as op from events)
"""


def in_lots(spark: SparkSession, sf_dir: str, path: str, closing: bool = False) -> Iterator[None]:
    """Write the feed a lot at a time; closing adds one that only moves event time on, past what the others have told."""
    rows = notifications(spark, sf_dir)
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    lines = rows.select("seq", feed_source.line(*(F.col(c) for c in rows.columns)).alias("line"))
    for k in range(LOTS):
        feed_source.put(lines.where(F.floor(F.col("seq") * LOTS / (last + 1)) == k), path, k + 1)
        yield
    if closing:
        nobody = rows.groupBy().agg(F.max("seq").alias("seq"), F.max("at").alias("at"))
        feed_source.put(nobody.select(feed_source.line(F.col("seq"), F.col("at"), F.lit("nobody"), F.lit("close"), F.lit("file:///none"), F.array().cast("array<string>")).alias("line")), path, LOTS + 1)
        yield


@registered("change_feed", f"select seq, \"at\", session_id, op, uri, cast(coalesce(n_changes, -1) as integer) as n_changes, text from ({NOTIFICATIONS_SQL})")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lot is taken by a run of its own, which goes on from the checkpoint of the one before, into one table."""
    root = own_folder(spark, "feed")
    for _ in in_lots(spark, sf_dir, f"{root}/feed"):
        changes = feed_source.decoded(feed_source.lines(spark, f"{root}/feed", share=1 << 20))
        changes.writeStream.format("parquet").option("path", f"{root}/table").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/table").select("seq", "at", "session_id", "op", "uri", F.when(F.col("changes").isNotNull(), F.size("changes")).otherwise(-1).alias("n_changes"), F.element_at("changes", F.when(F.size("changes") > 0, -1)).alias("text"))


@registered("document_get", f"""
with n as ({NOTIFICATIONS_SQL}), d as (select *, row_number() over (partition by session_id, uri order by seq desc) as k from n where op = 'close' or (op in ('open', 'change') and text is not null)),
o as (select session_id, uri, text from d where k = 1 and op <> 'close' and \"at\" + {IDLE_MS} > (select max(\"at\") from n where not starts_with(op, 'folder'))),
q as (select distinct cast(user_id as varchar) as session_id, 'file:///w/' || t || '.cfc' as uri from events, (select distinct event_type as t from events union all select 'none'))
select q.session_id, q.uri, o.text from q left join o on q.session_id = o.session_id and q.uri = o.uri
""")
def document_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session asks for every document, by key, in the state that the stream has left behind after its last run."""
    root, partitions = own_folder(spark, "store"), 4 + table(spark, sf_dir, "events").count() // 2_000_000
    for _ in in_lots(spark, sf_dir, f"{root}/feed", closing=True):
        changes = feed_source.decoded(feed_source.lines(spark, f"{root}/feed"))
        store.follow(changes, f"{root}/checkpoint", lambda batch, _: batch.write.format("noop").mode("append").save(), IDLE_MS, partitions, 256 * partitions).awaitTermination()
    e = table(spark, sf_dir, "events")
    types = e.select("event_type").distinct().unionByName(spark.sql("select 'none' as event_type"))
    asked = e.select(F.col("user_id").cast("string").alias("session_id")).distinct().join(F.broadcast(types)).select("session_id", F.concat(F.lit("file:///w/"), "event_type", F.lit(".cfc")).alias("uri"))
    return store.get(asked, store.documents(spark, f"{root}/checkpoint"))


# --- places as tables: matches against comments, arguments against markers, cursors against brackets ---


def with_hot_file(rows: DataFrame, *at: str) -> DataFrame:
    """The rows of all files, and all of them again as rows of one file, each file's at an offset of its own."""
    n = F.regexp_extract("uri", r"brand_(\d+)_", 1).cast("long") * 100_000 + F.regexp_extract("uri", r"_(\d+)[.]cfc", 1).cast("long")
    hot = rows.select(F.lit("file:///hot").alias("uri"), *((F.col(c) + n * (1 << 20)).alias(c) if c in at else F.col(c) for c in rows.columns if c != "uri"))
    return rows.select("uri", *(F.col(c).cast("long").alias(c) if c in at else F.col(c) for c in rows.columns if c != "uri")).unionByName(hot)


def twice(sql: str, columns: str) -> str:
    return f"select uri, {columns} from ({sql}) union all select 'file:///hot', {columns} from ({sql})"


@registered("comment_antijoin", twice(f"select uri, name as hit from ({rendered.ROWS_SQL.format(rename='false')}) where not hidden", "hit"))
def comment_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables, names and comments, joined by intervals; one file holds half of all rows."""
    f = files(spark, sf_dir)
    names, comments = with_hot_file(extract.places(f, "Make_[0-9]+"), "pos"), with_hot_file(extract.spans(f), "start", "end")
    return places.outside(names, comments, "uri").select("uri", "hit")


@registered("argument_owners", twice(f"""
select uri, unnest(['size_' || p_size, 'kind', 'note']) as argument, name as owner, '</cffunction' as next_marker from ({rendered.ROWS_SQL.format(rename='false')}) where not script
""", "argument, owner, next_marker"))
def argument_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments against the function markers around them: the last one before, whose name is the owner's, and the next one behind."""
    f = files(spark, sf_dir)
    arguments = with_hot_file(extract.places(f, '<cfargument name="[^"]*'), "pos").withColumn("argument", F.regexp_extract("hit", '"(.*)', 1)).drop("hit")
    markers = with_hot_file(extract.places(f, '</?cffunction(?: displayname="x" name="[^"]*)?'), "pos")
    owned = places.as_of(arguments, markers, "uri", {"hit": "before"})
    owned = places.as_of(owned, markers, "uri", {"hit": "next_marker"}, forward=True, strict=True)
    return owned.select("uri", "argument", F.regexp_extract("before", ' name="([^"]*)', 1).alias("owner"), "next_marker")


@registered("brackets_before_cursors", """
with l as (select page_id, unnest(string_split(replace(html, ',', chr(10)), chr(10))) as line, generate_subscripts(string_split(replace(html, ',', chr(10)), chr(10)), 1) as n, html from pages),
c as (select page_id, html, cast(sum(length(line) + 1) over (partition by page_id order by n) - 1 as bigint) as pos from l),
b as (select page_id, pos, substr(html, 1, cast(pos as integer) + 1) as before from c where pos < length(html))
select page_id, pos, case when contains(before, '<') then cast(pos - position('<' in reverse(before)) + 1 as bigint) else -1 end as opened, case when contains(before, '>') then cast(pos - position('>' in reverse(before)) + 1 as bigint) else -1 end as closed from b
""")
def brackets_before_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor at every comma and line end of every page, against the last bracket of each kind at or before it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    found = extract.places(pages, "[<>,\n]", "page_id", "html").select("page_id", F.col("pos").cast("long").alias("pos"), "hit")
    opened, closed = (found.where(F.col("hit") == h).select("page_id", "pos", F.col("pos").alias("_pos")) for h in "<>")
    at = places.as_of(found.where(~F.col("hit").isin("<", ">")).select("page_id", "pos"), opened, "page_id", {"_pos": "opened"})
    at = places.as_of(at, closed, "page_id", {"_pos": "closed"})
    return at.select("page_id", "pos", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("opened", "closed")))


# --- a mixed batch of requests ---

METHOD_SQL = "case p_partkey % 7 when 0 then 'textDocument/definition' when 1 then 'textDocument/hover' when 2 then 'textDocument/documentSymbol' when 3 then 'workspace/symbol' when 4 then 'textDocument/completion' when 5 then 'textDocument/references' else 'initialize' end"


@registered("request_batch", f"""
with q as (select cast(p_partkey as bigint) as req_id, p_partkey as k, {METHOD_SQL} as method, 'file:///shop/' || replace(lower(p_brand), '#', '_') || '_' || (p_partkey // {rendered.ROWS}) || '.cfc' as rendered_uri from part),
d as ({DEFS}), n as (select cast(n_nationkey as integer) as nk, 'To' || replace(n_name, ' ', '') as name from nation),
a as (
  select req_id, method, uri, line, cast(null as varchar) as label from q join d on d.name_key = 'make_' || (k + 1) where method = 'textDocument/definition'
  union all select req_id, method, null, null, left(contents, 4 + length(name)) from q join (select *, '**' || name || '**' || chr(10) as contents from n) n on q.k % 30 = n.nk where method = 'textDocument/hover'
  union all select req_id, method, d.uri, d.line, d.name from q join d on d.uri = rendered_uri where method = 'textDocument/documentSymbol'
  union all select req_id, method, d.uri, d.line, d.name from q join d on contains(d.name_key, 'make_' || k) where method = 'workspace/symbol'
  union all select req_id, method, null, null, 'cfloop' from q where method = 'textDocument/completion' and k % 3 = 0
  union all select req_id, method, null, null, 'cfoutput' from q where method = 'textDocument/completion' and k % 3 = 0
  union all select req_id, method, null, null, n.name from q, n where q.method = 'textDocument/completion' and k % 3 = 1
  union all select req_id, method, null, null, lower(n_name) from q join nation on n_regionkey = k % 5 where method = 'textDocument/completion' and k % 3 = 2
  union all select req_id, method, null, null, '{{"op' from q where method = 'initialize'
)
select q.req_id, q.method, case when q.method = 'textDocument/references' then 'method not found' when a.req_id is null then 'none' else 'ok' end as status, a.uri, coalesce(a.line, -1) as line, a.label
from q left join a on q.req_id = a.req_id
""")
def request_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request a part, of seven methods in turn, one of them unknown. Symbols are asked of the rendered files, all else of a document
    for each request; some have no answer."""
    part, k = rendered.keyed(table(spark, sf_dir, "part")), F.col("p_partkey")
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_n"), F.concat(F.lit("To"), F.replace("n_name", F.lit(" "), F.lit(""))).alias("function"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("_r"), F.concat(F.lit("cf"), F.lower(F.replace("r_name", F.lit(" "), F.lit("")))).alias("region"))
    p = part.join(names, k % 30 == F.col("_n"), "left").join(regions, k % 5 == F.col("_r"))
    method = F.when(k % 7 == 0, requests.DEFINITION).when(k % 7 == 1, requests.HOVER).when(k % 7 == 2, requests.SYMBOLS).when(k % 7 == 3, requests.WORKSPACE).when(k % 7 == 4, requests.COMPLETION).when(k % 7 == 5, "textDocument/references").otherwise(requests.INITIALIZE)
    text = (
        F.when(k % 7 == 0, F.concat(F.lit("y\nx.Make_"), (k + 1).cast("string"), F.lit("()"))).when(k % 7 == 1, F.concat(F.lit("y\nx."), F.coalesce("function", F.lit("unknown")), F.lit("()")))
        .when(k % 3 == 0, "<cfoutput>\n<cfloop a='1'><cfset x = 1></").when(k % 3 == 1, "y\nx").otherwise(F.concat(F.lit("y\n<"), "region", F.lit(" ")))
    )
    own = F.concat(F.lit("file:///use/"), k.cast("string"), F.lit(".cfm"))
    r = p.select(
        k.alias("req_id"), method.alias("method"), F.when(k % 7 == 2, F.col("uri")).otherwise(own).alias("uri"), F.lit(1).alias("line"), F.when(k % 7 == 4, 200).otherwise(5).alias("character"),
        F.lit("invoked").alias("trigger_kind"), F.lit(None).cast("string").alias("trigger_char"), F.concat(F.lit("MAKE_"), k.cast("string")).alias("query"), text.alias("text"),
    )
    documents = r.where("method != 'textDocument/documentSymbol'").select("uri", "text").unionByName(files(spark, sf_dir).select("uri", "text"))
    found = requests.routed(r.drop("text"), documents, defs(spark, sf_dir), catalog(spark, sf_dir), entries(spark, sf_dir))
    shown = F.substring_index(F.col("item.contents"), "\n", 1)
    first = F.when(F.col("method") == requests.HOVER, shown).when(F.col("method") == requests.INITIALIZE, F.substring(shown, 1, 4))
    return found.select("req_id", "method", "status", "item.uri", F.coalesce("item.line", F.lit(-1)).alias("line"), F.coalesce("item.label", "item.name", first).alias("label"))


# --- a workspace from its roots on, through the streamed feed ---


@registered("workspace_bootstrap", f"""
select path, case when b = 11 and p_size % 2 = 0 then 'Renamed_' || p_partkey else name end as name, cast(case when script then 2 + place else 1 + 5 * place end as integer) as line
from ({rendered.TREE_SQL}) where not hidden and not ends_with(path, '.txt') and b in (11, 13, 15, 31, 32)
""")
def workspace_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace is made from a scan of its roots, and then follows the feed in two runs of the stream: folders are added, whose files
    are scanned, and one is removed; then the files of a root change."""
    root, tree = own_folder(spark, "bootstrap"), written_tree(spark, sf_dir)
    uri = "file://" + tree.removeprefix("file://")
    feed.Workspace(spark, f"{root}/workspace", buckets=8).initialize([f"{tree}/brand_{b}" for b in (11, 12, 13, 15)])
    columns = "seq long, at long, session_id string, op string, uri string, changes array<string>"
    folders = spark.createDataFrame([(1, 1, None, "folder_added", f"{uri}/brand_31", None), (2, 2, None, "folder_removed", f"{uri}/brand_12", None), (3, 3, None, "folder_added", f"{uri}/brand_32", None)], columns)
    changed = rendered.tree(spark, sf_dir, 1).where("path like 'brand\\_11/%'").select(F.lit(4).cast("long").alias("seq"), F.lit(4).cast("long").alias("at"), F.lit("s").alias("session_id"), F.lit("change").alias("op"), F.concat(F.lit(uri + "/"), "path").alias("uri"), F.array("text").alias("changes"))
    for number, rows in enumerate((folders, changed), 1):
        feed_source.put(rows.select(feed_source.line(*(F.col(c) for c in rows.columns)).alias("line")), f"{root}/feed", number)
        w = feed.Workspace(spark, f"{root}/workspace")
        w.follow(feed_source.decoded(feed_source.lines(spark, f"{root}/feed")).drop("at")).awaitTermination()
    return w.defs.select(below(tree).alias("path"), "name", "line")
