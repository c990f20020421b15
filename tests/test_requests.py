"""Mixed batches of requests against the single methods."""

import random

from pyspark.sql import functions as F

from lexloom.operators import catalog as cat
from lexloom.operators import requests
from lexloom.operators.extract import function_defs
from lexloom.operators.tags import open_names, unclosed_names
from lexloom.schemas import CATALOG, FILES, REQUESTS

DOCUMENTS = [
    ("file:///a.cfc", "component {\n function one() {}\n function Two() { one(); }\n}"), ("file:///b.cfc", "component { function one() {} }"),
    ("file:///p.cfm", "<cfoutput><CFLOOP><cfif x></cfif>\n<cfset y></"), ("file:///t.cfm", "<b>\n<cfmail "), ("file:///w.cfm", "cfmail len(2)"), ("file:///e.cfm", ""),
]
ENTRIES = [
    ("cfmail", "Sends.", "", "", "tag", [("to", "Whom", "string", True), ("from", "Who", "string", False)]), ("len", "Length.", "len(x)", "numeric", "function", []), ("cfMail", "In script.", "cfMail()", "", "function", []), ("cfx", "X.", "", "", "tag", []),
]


def tables(spark):
    documents = spark.createDataFrame(DOCUMENTS, FILES)
    catalog = spark.createDataFrame([(*e, i) for i, e in enumerate(ENTRIES)], CATALOG + ", ord int")
    return documents, function_defs(documents), catalog, cat.distinct_entries(catalog, "ord")


def batch(spark, rows):
    return spark.createDataFrame([(i, m, u, line, c, kind, char, q) for i, (m, u, line, c, kind, char, q) in enumerate(rows)], REQUESTS)


def test_a_mixed_batch(spark):
    documents, defs, catalog, entries = tables(spark)
    rows = [
        (requests.DEFINITION, "file:///a.cfc", 2, 21, None, None, None), (requests.DEFINITION, "file:///gone", 0, 0, None, None, None), (requests.DEFINITION, "file:///e.cfm", 0, 0, None, None, None),
        (requests.HOVER, "file:///w.cfm", 0, 2, None, None, None), (requests.HOVER, "file:///w.cfm", 0, 8, None, None, None), (requests.SYMBOLS, "file:///a.cfc", None, None, None, None, None), (requests.SYMBOLS, "file:///gone", None, None, None, None, None),
        (requests.WORKSPACE, None, None, None, None, None, "TW"), (requests.WORKSPACE, None, None, None, None, None, ""), (requests.WORKSPACE, None, None, None, None, None, "zzz"), (requests.WORKSPACE, None, None, None, None, None, None),
        (requests.COMPLETION, "file:///p.cfm", 1, 99, None, None, None), (requests.COMPLETION, "file:///t.cfm", 1, 99, None, None, None), (requests.COMPLETION, "file:///e.cfm", 0, 0, "trigger_char", "<", None),
        (requests.COMPLETION, "file:///gone", 0, 0, None, None, None), (requests.INITIALIZE, None, None, None, None, None, None), ("textDocument/rename", "file:///a.cfc", 0, 0, None, None, None), (None, None, None, None, None, None, None),
    ]
    asked = batch(spark, rows)
    out = requests.routed(asked, documents, defs, catalog, entries).collect()
    of = lambda i: sorted((r for r in out if r.req_id == i), key=lambda r: (r.ord is None, r.ord or 0, str(r["item"])))
    status = {i: {r.status for r in of(i)} for i in range(len(rows))}
    assert {i for i, s in status.items() if s == {"none"}} == {1, 2, 6, 9, 10} and {i for i, s in status.items() if s == {"method not found"}} == {16, 17}
    assert all(len(of(i)) == 1 for i in (1, 2, 6, 9, 10, 16, 17)) and all(s == {"ok"} for i, s in status.items() if i not in {1, 2, 6, 9, 10, 16, 17})
    assert sorted((r["item"].uri, r["item"].line) for r in of(0)) == [("file:///a.cfc", 1), ("file:///b.cfc", 0)]
    assert [(r["item"].name, r["item"].line, r.ord) for r in of(5)] == [("one", 1, 0), ("Two", 2, 1)]
    assert [r["item"].name for r in of(7)] == ["Two"] and len(of(8)) == 3
    assert [r["item"].insert_text for r in of(11)] == ["cfloop>", "cfoutput>"] and [r["item"].label for r in of(12)] == ["to", "from"]
    assert {r["item"].label for r in of(13)} == {"cfmail", "cfx"} and {r["item"].label for r in of(14)} == {"len", "cfMail"}
    assert of(3)[0]["item"].contents.startswith("**cfMail**") and '"open_close": true' in of(15)[0]["item"].contents
    single = lambda df, *c: sorted((r.req_id, *(r[x] for x in c)) for r in df.collect())
    mine = lambda method, *c: sorted((r.req_id, *(r["item"][x] for x in c)) for r in out if r.method == method and r.status == "ok")
    part = lambda method: asked.where(F.col("method") == method)
    assert mine(requests.DEFINITION, "uri", "line") == single(requests.definitions(part(requests.DEFINITION), documents, defs), "uri", "line")
    assert mine(requests.HOVER, "contents") == single(requests.hover(part(requests.HOVER), documents, entries), "contents")
    assert mine(requests.SYMBOLS, "name", "line") == single(requests.document_symbols(part(requests.SYMBOLS), documents), "name", "line")
    assert mine(requests.WORKSPACE, "name", "uri", "line") == single(requests.workspace_symbols(part(requests.WORKSPACE), defs), "name", "uri", "line")
    assert mine(requests.COMPLETION, "label", "kind", "documentation") == single(requests.completions(part(requests.COMPLETION), documents, catalog, entries), "label", "kind", "documentation")


def test_no_requests(spark):
    assert requests.routed(batch(spark, []), *tables(spark)).count() == 0


def test_documents_are_joined_once(spark, tmp_path):
    _, defs, catalog, entries = tables(spark)
    spark.createDataFrame(DOCUMENTS, FILES).write.parquet(f"{tmp_path}/documents")
    asked = batch(spark, [(requests.COMPLETION, "file:///p.cfm", 1, 99, None, None, None)])
    for out in (requests.routed(asked, spark.read.parquet(f"{tmp_path}/documents"), defs, catalog, entries), requests.completions(asked, spark.read.parquet(f"{tmp_path}/documents"), catalog, entries)):
        assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1  # the other tables are not files


def test_rendered_tables_are_never_broadcast(spark, tmp_path):
    """Documents and definitions of small files may be large: texts and grams are made on the way, which Spark's estimate doesn't show."""
    documents, _, catalog, entries = tables(spark)
    batch(spark, [(requests.WORKSPACE, None, None, None, None, None, "TW"), (requests.DEFINITION, "file:///a.cfc", 2, 21, None, None, None)]).write.parquet(f"{tmp_path}/asked")
    documents.write.parquet(f"{tmp_path}/documents")
    documents = spark.read.parquet(f"{tmp_path}/documents")
    out = requests.routed(spark.read.parquet(f"{tmp_path}/asked"), documents, function_defs(documents), catalog, entries)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 5 and "Broadcast" not in plan
    assert sorted((r.req_id, r["item"].uri) for r in out.collect()) == [(0, "file:///a.cfc"), (1, "file:///a.cfc"), (1, "file:///b.cfc")]


def test_open_names_are_those_of_the_window(spark):
    rng = random.Random(9)
    parts = ["<cfif x>", "</cfif>", "<CFLoop a='>'>", "</cfloop >", "<cfset x>", "<b/>", "<br>", "</", "</b", "<!-- x -->", "< x", "<i", " ", "text", "<cfoutput\n>", "</cfoutput>"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    got = {}
    for r in unclosed_names(spark.createDataFrame(texts, "id int, text string"), "text", "id").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.tag)
    assert {i: n for i, t in texts if (n := open_names(t))} == got
