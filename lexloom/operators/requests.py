"""Batches of editor requests, answered as joins: each method by a function of its own, from requests to a table keyed by req_id, and
a mixed batch of all methods by routed().

For a mixed batch, requests meet their documents once. What a request needs then stands in its row: results that the document itself
gives, or the key of one of several tables, which are one table under (table, key), joined once.

Texts that are rendered or read by globs, and tables that are extracted from them, may be many times what Spark estimates, so these
joins are merges of two dealt sides (hint "merge"), whatever the limit for broadcasts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.lexing import definition_list
from lexloom.functions.text import enclosing_tag, in_closing_tag, text_before, word_at
from lexloom.operators import catalog as cat
from lexloom.operators.extract import function_defs
from lexloom.operators.index import lookup, symbol_search
from lexloom.operators.tags import open_name_list


def words(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """req_id, word: of the requests whose document is open and whose cursor is at a word."""
    r = requests.select("req_id", "uri", "line", "character").join(documents.select("uri", "text"), "uri")
    return r.select("req_id", word_at("text", "line", "character").alias("word")).where("word != ''")


def definitions(requests: DataFrame, documents: DataFrame, defs: DataFrame) -> DataFrame:
    """req_id, uri, line, n_locations: no row for no answer, one for a single location, more for a list."""
    found = lookup(words(requests, documents), defs.select("name_key", "uri", "line"))
    return found.select("req_id", "uri", "line", F.count("*").over(Window.partitionBy("req_id")).cast("int").alias("n_locations"))


def hover(requests: DataFrame, documents: DataFrame, entries: DataFrame) -> DataFrame:
    return cat.hovers(words(requests, documents), entries).where("contents is not null")


def document_symbols(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """req_id, ord, name, line: from the open document's text, not from the index."""
    asked = requests.select("req_id", "uri")
    open_ = documents.select("uri", "text").join(asked.select("uri").distinct(), "uri", "left_semi")
    return asked.join(function_defs(open_), "uri").select("req_id", "ord", "name", "line")


def workspace_symbols(requests: DataFrame, defs: DataFrame) -> DataFrame:
    return symbol_search(requests.select("req_id", "query"), defs)


#: What is offered to an editor that connects.
CAPABILITIES = {
    "open_close": True, "change": "full", "trigger_characters": ["<", " ", "/"], "definition": True, "document_symbol": True, "workspace_symbol": True, "hover": True,
    "workspace_folders": True, "folder_change_notifications": True,
}


def capabilities(requests: DataFrame) -> DataFrame:
    """req_id and one column for each capability, the same for each request."""
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return requests.select("req_id", *(value(v).alias(k) for k, v in CAPABILITIES.items()))



DEFINITION, HOVER, SYMBOLS, WORKSPACE, COMPLETION, INITIALIZE = (
    "textDocument/definition", "textDocument/hover", "textDocument/documentSymbol", "workspace/symbol", "textDocument/completion", "initialize",
)
KNOWN = (INITIALIZE, DEFINITION, HOVER, SYMBOLS, WORKSPACE, COMPLETION)
ITEM = {"uri": "string", "line": "int", "name": "string", "label": "string", "kind": "string", "detail": "string", "documentation": "string", "insert_text": "string", "insert_text_format": "string", "contents": "string"}
SHARES = 16  # keys under which a whole catalog stands, so that requests for all of it do not share one


def item(**given) -> Column:
    """One result of any method: the fields that it has, the others null."""
    return F.struct(*(given.get(f, F.lit(None)).cast(t).alias(f) for f, t in ITEM.items()))


def offer(label: Column, kind: str, detail: Column | None = None, documentation: Column | None = None, insert_text: Column | None = None, insert_text_format: str = "") -> Column:
    blank = F.lit("")
    or_blank = lambda c: blank if c is None else c
    return item(label=label, kind=F.lit(kind), detail=or_blank(detail), documentation=or_blank(documentation), insert_text=or_blank(insert_text), insert_text_format=F.lit(insert_text_format))


def asked(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """req_id, method, table, key, ord, item: what each request needs to be answered, a row each. It is either found already in the
    document (item) or looked up (table, key). Requests and documents are joined here and nowhere else."""
    r = requests.select("req_id", "method", "uri", "line", "character", "trigger_kind", "trigger_char").join(documents.select("uri", "text").hint("merge"), "uri", "left")
    r = r.withColumn("word", F.when(F.col("method").isin(DEFINITION, HOVER), F.lower(word_at("text", "line", "character"))))
    r = r.withColumn("before", F.when(F.col("method") == COMPLETION, text_before("text", "line", "character")))
    r = r.withColumn("tag", F.coalesce(enclosing_tag("before"), F.lit("")))
    opened = (F.coalesce("trigger_kind", F.lit("")) == "trigger_char") & (F.coalesce("trigger_char", F.lit("")) == "<")
    closing = F.coalesce(in_closing_tag("before"), F.lit(False))
    arm = F.when(F.col("method") != COMPLETION, None).when(closing, "closing").when(F.col("tag") != "", "params").when(opened, "tag").otherwise("function")
    r = r.withColumn("arm", arm)
    r = r.withColumn("open", open_name_list(F.when(F.col("arm") == "closing", F.col("before"))))
    r = r.withColumn("defined", definition_list(F.when(F.col("method") == SYMBOLS, F.col("text"))))
    none = item()
    need = lambda table, key: F.array(F.struct(F.lit(table).alias("table"), key.alias("key"), F.lit(0).alias("ord"), none.alias("item")))
    have = lambda i, x: F.struct(F.lit(None).cast("string").alias("table"), F.lit(None).cast("string").alias("key"), i.cast("int").alias("ord"), x.alias("item"))
    share = F.concat(F.col("arm"), F.lit("/"), F.pmod(F.xxhash64("req_id"), F.lit(SHARES)).cast("string"))
    needs = (
        F.when((F.col("method") == DEFINITION) & (F.col("word") != ""), need("definition", F.col("word")))
        .when((F.col("method") == HOVER) & (F.col("word") != ""), need("hover", F.col("word")))
        .when(F.col("method") == SYMBOLS, F.transform("defined", lambda d, i: have(i, item(name=d["name"], line=d["line"], uri=F.col("uri"), kind=F.lit("function")))))
        .when(F.col("method") == INITIALIZE, F.array(have(F.lit(0), item(contents=F.lit(json.dumps(CAPABILITIES))))))
        .when(F.col("arm") == "closing", F.transform("open", lambda n, i: have(i, offer(n, "keyword", F.lit("Close tag"), insert_text=F.concat(n, F.lit(">"))))))
        .when(F.col("arm") == "params", need("params", F.col("tag")))
        .when(F.col("arm").isNotNull(), need("all", share))
    )
    return r.select("req_id", "method", F.explode_outer(needs).alias("n")).select("req_id", "method", "n.*")


def offered(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """table, key, ord, item: what completions and hovers look up."""
    hovers = cat.shown(entries).groupBy("key").agg(F.min_by("contents", "type").alias("contents"))  # functions before tags
    hovers = hovers.select(F.lit("hover").alias("table"), "key", F.lit(0).alias("ord"), item(contents=F.col("contents")).alias("item"))
    params = cat.of_type(entries, "tag").select("key", F.posexplode("params").alias("ord", "p"))
    params = params.select(F.lit("params").alias("table"), "key", "ord", offer(F.col("p.name"), "property", F.col("p.description"), insert_text=F.concat("p.name", F.lit('="$1"')), insert_text_format="snippet").alias("item"))
    tag, function = offer(F.col("name"), "keyword", F.col("description")), offer(F.col("name"), "function", F.col("syntax"), F.col("description"), insert_text_format="plaintext")
    share = F.explode(F.transform(F.sequence(F.lit(0), F.lit(SHARES - 1)), lambda i: F.concat("type", F.lit("/"), i.cast("string"))))
    whole = catalog.where(F.col("type").isin("tag", "function")).select(F.lit("all").alias("table"), share.alias("key"), F.col("ord").cast("int").alias("ord"), F.when(F.col("type") == "tag", tag).otherwise(function).alias("item"))
    return hovers.unionByName(params).unionByName(whole)


def answered(needs: DataFrame, tables: DataFrame) -> DataFrame:
    """req_id, method, ord, item; a row without an item for a request that has no answer. What is held already is dealt out by request,
    under a name that no table has, and not all as one null key."""
    t = tables.select(F.col("table").alias("_table"), F.col("key").alias("_key"), F.col("ord").alias("_ord"), F.col("item").alias("_item"))
    held = F.col("table").isNull()
    table, key = F.coalesce("table", F.lit("")), F.when(held, F.col("req_id").cast("string")).otherwise(F.col("key"))
    found = needs.join(t.hint("merge"), (table == F.col("_table")) & (key == F.col("_key")), "left")
    return found.select("req_id", "method", F.when(held, F.col("ord")).otherwise(F.col("_ord")).alias("ord"), F.when(held, F.col("item")).otherwise(F.col("_item")).alias("item"))


def routed(requests: DataFrame, documents: DataFrame, defs: DataFrame, catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """A batch of requests of any methods to one table: req_id, method, status, ord, item. status is "ok"; "none" in the one row of a
    request without an answer; or "method not found" in that of an unknown method. ord is null for definitions of a word
    and symbols of the workspace, which have no order."""
    known = requests.where(F.col("method").isin(*KNOWN) & (F.col("method") != WORKSPACE))
    places = defs.select(F.lit("definition").alias("table"), F.col("name_key").alias("key"), F.lit(None).cast("int").alias("ord"), item(uri=F.col("uri"), line=F.col("line")).alias("item"))
    main = answered(asked(known, documents), offered(catalog, entries).unionByName(places))
    searched = requests.where(F.col("method") == WORKSPACE).select("req_id", "method", "query")
    symbols = symbol_search(searched, defs).select(F.col("req_id").alias("_req"), item(name=F.col("name"), uri=F.col("uri"), line=F.col("line"), kind=F.lit("function")).alias("item"))
    symbols = searched.join(symbols.hint("merge"), F.col("req_id") == F.col("_req"), "left").select("req_id", "method", F.lit(None).cast("int").alias("ord"), "item")
    unknown = requests.where(~F.coalesce(F.col("method").isin(*KNOWN), F.lit(False))).select("req_id", "method", F.lit(None).cast("int").alias("ord"), item().alias("item"))
    fields = lambda c: F.coalesce(*(F.col(f"{c}.{f}").cast("string") for f in ITEM))
    status = F.when(~F.coalesce(F.col("method").isin(*KNOWN), F.lit(False)), "method not found").when(fields("item").isNull(), "none").otherwise("ok")
    return main.unionByName(symbols).unionByName(unknown).select("req_id", "method", status.alias("status"), "ord", "item")


def completions(requests: DataFrame, documents: DataFrame, catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """req_id, ord, label, kind, detail, documentation, insert_text, insert_text_format. catalog: with ord; entries: its distinct ones."""
    r = requests.withColumn("method", F.lit(COMPLETION))
    tables = offered(catalog, entries).where("table != 'hover'")
    return answered(asked(r, documents), tables).where("item.label is not null").select("req_id", "ord", *(f"item.{f}" for f in ("label", "kind", "detail", "documentation", "insert_text", "insert_text_format")))


METHODS = {
    "initialize": capabilities,
    "textDocument/definition": definitions,
    "textDocument/hover": hover,
    "textDocument/documentSymbol": document_symbols,
    "workspace/symbol": workspace_symbols,
    "textDocument/completion": completions,
}


def dispatch(method: str):
    """The function that answers a method."""
    if method not in METHODS:
        raise LookupError(f"method not found: {method}")
    return METHODS[method]
