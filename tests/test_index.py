"""Index, catalog and requests."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import catalog as cat
from lexloom.operators import index, postings, requests
from lexloom.operators.extract import function_defs
from lexloom.schemas import FILES, REQUESTS

BREAD, CAKE = "file:///bakery/bread.cfc", "file:///bakery/cake.cfc"


@pytest.fixture
def defs(spark):
    return function_defs(spark.createDataFrame([(BREAD, "component {\n\nfunction knead() {}\nfunction proofLoaf() {}\n}"), (CAKE, "component { function Knead() {} }")], FILES))


def asked(spark, *rows):
    return spark.createDataFrame([(i, None, uri, line, c, kind, char, query) for i, (uri, line, c, kind, char, query) in enumerate(rows)], REQUESTS)


def test_lookup_ignores_case_and_counts(spark, defs):
    shop = "file:///bakery/shop.cfm"
    docs = spark.createDataFrame([(shop, "\nloaf = bread.KNEAD(2); sell(loaf)")], FILES)
    r = asked(spark, (shop, 1, 16, None, None, None), (shop, 1, 24, None, None, None), (shop, 0, 0, None, None, None), ("file:///bakery/not_open.cfm", 1, 16, None, None, None))
    got = sorted((x.req_id, x.uri, x.line, x.n_locations) for x in requests.definitions(r, docs, defs).collect())
    assert got == [(0, BREAD, 2, 2), (0, CAKE, 0, 2)]


def test_symbols(spark, defs):
    r = asked(spark, *(("", 0, 0, None, None, q) for q in ("KNE", "", "oaf", "zz", None)))
    got = sorted((x.req_id, x.name) for x in requests.workspace_symbols(r, defs).collect())
    assert got == [(0, "Knead"), (0, "knead"), (1, "Knead"), (1, "knead"), (1, "proofLoaf"), (2, "proofLoaf")]


def test_symbols_of_many_names(spark):
    """The n-gram path, for queries of three letters and more, finds what a plain search does."""
    rng = random.Random(41)
    word = lambda n: "".join(rng.choice("abcE%_") for _ in range(n))
    names = [word(rng.randint(1, 9)) for _ in range(400)]
    queries = [word(rng.randint(0, 6)) for _ in range(60)]
    defs = spark.createDataFrame([("u", i, n, n.lower(), i, []) for i, n in enumerate(names)], "uri string, ord int, name string, name_key string, line int, arguments array<struct<name:string,type:string,required:boolean>>")
    got = sorted((r.req_id, r.line) for r in index.symbol_search(spark.createDataFrame(list(enumerate(queries)), "req_id long, query string"), defs).collect())
    assert got == [(i, j) for i, q in enumerate(queries) for j, n in enumerate(names) if q.lower() in n.lower()]


def test_upsert_purges_and_replaces(spark, defs):
    changed = spark.createDataFrame([(CAKE, "component { function frost() {} }"), (BREAD, "")], FILES)
    assert [(r.uri, r.name) for r in index.upserted(defs, changed).collect()] == [(CAKE, "frost")]


def test_prefix_has_no_border(spark, defs):
    files = [(f"file:///bakery{x}/stock.cfc", f"component {{ function stock{i}() {{}} }}") for i, x in enumerate(("", "2", "/old"))]
    more = defs.unionByName(function_defs(spark.createDataFrame(files, FILES)))
    names = lambda *removed, **keep: sorted(r.name for r in index.without_prefix(more, spark.createDataFrame([(x,) for x in removed], "uri string"), **keep).collect())
    assert names("file:///bakery/") == ["stock1"]
    assert names("file:///bakery") == []
    assert names("file:///bakery/o", "file:///bakery2") == ["Knead", "knead", "proofLoaf", "stock0"]
    assert len(names("file:///bakery", protected=spark.createDataFrame([("/bakery",)], "path string"))) == more.count()
    assert names("file:///bakery", "file:///bakery/old", protected=spark.createDataFrame([("/bakery",)], "path string")) == ["Knead", "knead", "proofLoaf", "stock0", "stock1"]
    assert names("") == []


def test_many_prefixes(spark, monkeypatch):
    """Of many lengths, in blocks, some beginning with others, against plain loops."""
    rng = random.Random(11)
    monkeypatch.setattr(index, "outermost", lambda p, size=7, real=index.outermost: real(p, size))
    uris = ["".join(rng.choice("ab/\U0001f600é") for _ in range(rng.randint(0, 12))) for _ in range(500)] + [None]
    removed = ["".join(rng.choice("ab/\U0001f600é") for _ in range(rng.randint(2, 12))) for _ in range(150)]
    defs = spark.createDataFrame([(u, i) for i, u in enumerate(uris)], "uri string, line int").repartition(3)
    got = sorted(r.line for r in index.without_prefix(defs, spark.createDataFrame([(x,) for x in [*removed, None]], "uri string")).collect())
    assert got == [i for i, u in enumerate(uris) if u is None or not any(u.startswith(p) for p in removed)]


def test_outermost_prefixes():
    assert list(index.outermost(["a", "a/b", "a/b/c", "ab", "b", "ba", "c"], 2)) == [["a", "b"], ["c"]]
    assert list(index.outermost(["", "a"])) == [[""]] and list(index.outermost([])) == []


def test_stored_postings_find_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(12)
    make = lambda names: spark.createDataFrame([(f"u{i}", n, n.lower(), i) for i, n in enumerate(names)], "uri string, name string, name_key string, line int")
    name = lambda: "".join(rng.choice("abXé") for _ in range(rng.randint(1, 7)))
    first = [name() for _ in range(80)]
    second = first[40:] + [name() for _ in range(60)]
    queries = spark.createDataFrame(list(enumerate(["", "a", "AB", "abx", "abxa", "É", "none such", None, *(name()[:4] for _ in range(30))])), "req_id int, query string")
    path = str(tmp_path / "postings")
    found = lambda df: sorted(tuple(r) for r in df.select("req_id", "name", "uri", "line").collect())
    postings.write_postings(make(first), path, 5)
    assert found(postings.search(queries, make(first), path, 5)) == found(index.symbol_search(queries, make(first)))
    for _ in range(2):  # a second time it has nothing to append
        postings.extend_postings(spark, path, make(second), 5)
    assert postings.read_postings(spark, path, 5).where("gram = ''").count() == len({n.lower() for n in first + second})
    assert found(postings.search(queries, make(second), path, 5)) == found(index.symbol_search(queries, make(second)))
    postings.compacted(spark, path, make(second), str(tmp_path / "again"), 5)
    assert found(postings.search(queries, make(second), str(tmp_path / "again"), 5)) == found(index.symbol_search(queries, make(second)))
    assert postings.read_postings(spark, str(tmp_path / "again"), 5).where("gram = ''").count() == len({n.lower() for n in second})
    one = postings.read_postings(spark, path, 5, spark.sql("select 'abx' as gram"))
    assert {r.bucket for r in one.select("bucket").distinct().collect()} == {spark.sql("select pmod(xxhash64('abx'), 5)").first()[0]}


def test_accepted_files(spark):
    f = spark.createDataFrame([(u, "") for u in ("file:///bakery/Loaf.CFC", "file:///bakery/loaf.cfm", "file:///bakery2/loaf.cfc", "file:///bakery/back/roll.cfc")], FILES)
    names = lambda *a: sorted(r.uri.removeprefix("file:///") for r in index.accepts(f, *a).collect())
    assert names([], []) == ["bakery/Loaf.CFC", "bakery/back/roll.cfc", "bakery2/loaf.cfc"]
    assert names(["/bakery"], []) == ["bakery/Loaf.CFC", "bakery/back/roll.cfc"]
    assert names(["/bakery", "/bakery2"], []) == ["bakery/Loaf.CFC", "bakery/back/roll.cfc", "bakery2/loaf.cfc"]
    assert names(["/bakery"], ["/bakery/**/r*"]) == ["bakery/back/roll.cfc"]
    assert names(["/bakery"], ["/bakery/back"]) == ["bakery/back/roll.cfc"]


def param(name, description, type_="string", required=False):
    return {"name": name, "description": description, "type": type_, "required": required}


ENTRIES = [
    {"name": "cfoven", "description": "Heats", "syntax": "<cfoven>", "returns": "", "type": "tag", "params": [param("heat", "Degrees\nand more", "numeric", True), param("fan", "Whether to blow")]},
    {"name": "cftray", "description": "Holds", "type": "tag", "params": [param("slots", "How many")]},
    {"name": "CFRack", "description": "Cools", "syntax": "", "returns": "", "type": "tag", "params": []},
    {"name": "WEIGH", "description": "old", "syntax": "", "returns": "", "type": "function", "params": []},
    {"name": "Weigh", "description": "Weighs a loaf", "syntax": "Weigh(loaf)", "returns": "numeric", "type": "function", "params": [param("loaf", "any", "any", True)]},
    {"name": "Slice", "description": "Slices", "syntax": "Slice(loaf)", "returns": "array", "type": "function", "params": []},
    {"name": "crumb", "description": "neither", "type": "other"},
]


@pytest.fixture
def catalog(spark, tmp_path):
    for i, e in enumerate(ENTRIES):
        (tmp_path / f"{i}.json").write_text(json.dumps(e, indent=1))
    (tmp_path / "9.json").write_text("{ not json")
    return cat.read_catalog(spark, str(tmp_path))


def test_catalog(spark, catalog):
    assert sorted(r.name for r in catalog.collect()) == ["CFRack", "Slice", "WEIGH", "Weigh", "cfoven", "cftray"]
    entries = cat.distinct_entries(catalog, "_file")
    assert {r.name: r.description for r in cat.of_type(entries, "function").collect()} == {"Weigh": "Weighs a loaf", "Slice": "Slices"}
    assert [r.name for r in cat.in_order(catalog).collect()] == ["cfoven", "CFRack", "cftray", "Slice", "WEIGH", "Weigh"]


def test_hover(spark, catalog):
    docs = spark.createDataFrame([("till", "x = weigh(y);\n<CFOVEN flour>")], FILES)
    r = asked(spark, *((uri, line, c, None, None, None) for uri, line, c in (("till", 0, 6), ("till", 1, 3), ("till", 1, 10), ("not open", 0, 6))))
    got = {r.req_id: r.contents for r in requests.hover(r, docs, cat.distinct_entries(catalog, "_file")).collect()}
    assert got == {
        0: "**Weigh**\n\n```cfml\nWeigh(loaf)\n```\n\nWeighs a loaf\n\n**Parameters:**\n- `loaf` (any) *(required)* — any\n\n**Returns:** `numeric`",
        1: "**<cfoven>**\n\nHeats\n\n**Attributes:**\n- `heat` (numeric) *(required)* — Degrees\n- `fan` (string) — Whether to blow\n",
    }


def test_completion(spark, catalog):
    docs = spark.createDataFrame([("close", "<CFRack><cftray><CFRack>\n</"), ("params", "<cfoven\n "), ("plain", "mix "), ("unknown", "<crate ")], FILES)
    r = asked(spark, ("close", 1, 2, "trigger_char", "/", None), ("params", 1, 1, "invoked", None, None), ("not open", 0, 0, "trigger_char", "<", None), ("plain", 0, 4, None, None, None), ("unknown", 0, 7, None, None, None), ("close", 1, 1, "trigger_char", "<", None))
    entries = cat.distinct_entries(catalog, "_file")
    ordered = entries.withColumn("ord", (F.crc32("name") % 1000).cast("int"))
    got = {}
    for x in sorted(requests.completions(r, docs, ordered, entries).collect(), key=lambda x: (x.req_id, x.ord)):
        got.setdefault(x.req_id, []).append((x.label, x.kind, x.insert_text, x.insert_text_format))
    assert got[0] == [("cfrack", "keyword", "cfrack>", ""), ("cftray", "keyword", "cftray>", "")]
    assert got[1] == [("heat", "property", 'heat="$1"', "snippet"), ("fan", "property", 'fan="$1"', "snippet")]
    assert sorted(x[0] for x in got[2]) == sorted(x[0] for x in got[5]) == ["CFRack", "cfoven", "cftray"]
    assert sorted(x[0] for x in got[3]) == ["Slice", "Weigh"] and got[3][0][3] == "plaintext"
    assert 4 not in got


def test_document_symbols_come_from_the_open_text(spark):
    docs = spark.createDataFrame([("counter.txt", "<cfscript>\n\nfunction takeOrder(){}</cfscript><cffunction name='ring'>"), ("other", "component { function no(){} }")], FILES)
    rows = requests.document_symbols(asked(spark, ("counter.txt", 0, 0, None, None, None)), docs).collect()
    assert [(r.name, r.line) for r in sorted(rows, key=lambda r: r.ord)] == [("takeOrder", 2), ("ring", 2)]


def test_dispatch():
    assert requests.dispatch("textDocument/hover") is requests.hover
    with pytest.raises(LookupError):
        requests.dispatch("textDocument/rename")
