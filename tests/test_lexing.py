"""Comments, regions, definitions and arguments: rules on small sources, and random sources against plain models."""

import random
import re
import time

import pytest

from lexloom.functions.lexing import SCRIPT_SIGNATURE, Source, enclosed, spans_of, tag_signatures
from lexloom.operators.extract import function_defs, regions
from lexloom.schemas import FILES

#: (rule, source, what is in comments)
COMMENTS = [
    ("tag comments nest", "ab<!---1<!---2--->3--->cd", ["<!---1<!---2--->3--->"]),
    ("a comment of the page's markup is none", "<!-- kept --> ok", []),
    ("a line comment leaves its line end out", "total = 3; // cents\ntax = 1;", ["// cents"]),
    ("slashes in an address open one, too", "go(http://oven.example) ;\nx", ["//oven.example) ;"]),
    ("quotes hide a comment's start", "label = '/* bread */' & \"<!--- rye --->\";", []),
    ("a backslash keeps the quote open", r"s = 'it\'s // fine'", []),
    ("an open quote hides all that follows", "dough = \"rises /* slowly", []),
    ("an open comment lasts to the end", "knead /* and wait\n\n", ["/* and wait\n\n"]),
    ("several in a row", "/*1*/ /*2*/ //3\n<!---4--->", ["/*1*/", "/*2*/", "//3", "<!---4--->"]),
    ("an apostrophe in prose is a quote", "the baker's loaf /* hidden? */", []),
    ("nothing", "", []),
]


@pytest.mark.parametrize(("rule", "text", "want"), COMMENTS)
def test_comments(rule, text, want):
    assert [text[a:b] for a, b in spans_of(text)] == want, rule


#: The rules as a table: in each state, which inputs lead where, the first that fits; "+" and "-" nest, "_" takes what follows along,
#: "<" leaves the input to the next state. Any other letter stays. States in capitals are comments.
STATES = {
    "text": {'"': "double", "'": "single", "<!---": "TAG", "/*": "BLOCK", "//": "LINE"},
    "double": {"\\": "_", '"': "text"},
    "single": {"\\": "_", "'": "text"},
    "TAG": {"<!---": "+", "-->": "-"},
    "BLOCK": {"*/": "text"},
    "LINE": {"\n": "<text"},
}


def walked(s: str) -> list[tuple[int, int]]:
    """Comments by the table: every letter gets the number of the comment that it is in."""
    state, depth, comment, marks, at = "text", 0, 0, [], 0
    while at < len(s):
        token = next((t for t in STATES[state] if s.startswith(t, at)), None)
        to = STATES[state].get(token, state)
        size = len(token or "x")
        if to == "_":
            to, size = state, 2
        elif to in "+-":
            depth += 1 if to == "+" else -1
            to = "TAG" if depth else "text"
        elif to == "TAG" and state == "text":
            depth = 1
        elif to[0] == "<":
            to, size = to[1:], 0
        comment += to.isupper() and not state.isupper()
        marks += [comment if to.isupper() or state.isupper() else 0] * min(size, len(s) - at)
        state, at = to, at + size
    return [(marks.index(c), len(marks) - marks[::-1].index(c)) for c in sorted(set(marks) - {0})]


def test_lexer_against_a_table_of_states():
    rng = random.Random(3)
    pieces = ["<!---", "--->", "-->", "/*", "*/", "//", "\n", '"', "'", "\\", "a", "-", "<", "/", "é"]
    for _ in range(20_000):
        s = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        spans = spans_of(s)
        assert spans == walked(s), s
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        rest = s[spans[-1][1] :] if spans else s
        assert spans_of(rest) == []  # nothing is left behind the last one


def test_enclosed():
    assert enclosed("mix(2, (3), ')')!", 3) == "2, (3), ')'"
    assert enclosed("mix(salt, 'coarse", 3) == "salt, 'coarse"


def extracted(spark, *texts):
    rows = function_defs(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], FILES)).collect()
    out = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r.uri, r.ord)):
        assert r.name_key == r.name.lower()
        out[int(r.uri)].append((r.name, r.line, [(a.name, a.type, a.required) for a in r.arguments]))
    return out


#: (rule, source, name@line of each definition)
CASES = [
    ("access word and type belong to the signature", "component {\n\n  remote\n  numeric function Bake( ) { }\n}", ["Bake@2"]),
    ("keywords in any case", "component{ PUBLIC FUNCTION Proof(){} }", ["Proof@0"]),
    ("lower-case opening words only", "Component {\nfunction Sift(){}\n}", []),
    ("an interface is a script", "interface {\n any function Weigh();\n}", ["Weigh@1"]),
    ("a property opens one with a blank", "property\tname='oven';\nfunction Heat(){}", ["Heat@1"]),
    ("tags and scripts in turn", "<cffunction name='Rest'></cffunction>\n<CFScript>\nfunction Fold(){}\n\nfunction Turn(){}</cfscript>\n<cffunction hint=x name=\"Cut\">", ["Rest@0", "Fold@2", "Turn@4", "Cut@5"]),
    ("a script that is never closed", "<p><cfscript>function Score(){}\n", ["Score@0"]),
    ("functions in comments are left out", "component{\n/* function Old(){} */ function New(){}\n// function Older(){}\n}", ["New@1"]),
    ("comments count from the region's own place", "<b/><cfscript> // function Hidden(){}\nfunction Seen(){}</cfscript>", ["Seen@1"]),
    ("a word before the keyword may stand in a comment", "component{\n// then glaze\nfunction Glaze(){}\n}", []),
    ("an access word parts it from the comment", "component{\n// then glaze\nprivate function Glaze(){}\n}", ["Glaze@2"]),
    ("no border is needed before the keyword", "component{ malfunction Dust(){} }", ["Dust@0"]),
    ("a signature in quotes counts", "component{ hint = 'function Sprinkle()'; }", ["Sprinkle@0"]),
    ("an attribute's name has a border", "<cffunction nickname='No'> <cffunction nickname='no' name='Yes'>", ["Yes@0"]),
    ("no attribute, no function", "<cffunction output=false>", []),
    ("the last name of a tag counts", "<cffunction name='First' name='Second'>", ["Second@0"]),
    ("cut off behind the name", "<cffunction name='Crumb'", ["Crumb@0"]),
    ("cut off inside the list", "component{ function Crust(thin = 'y", ["Crust@0"]),
    ("nothing at all", "", []),
    ("blanks", " \n\t", []),
]


def test_definitions(spark):
    got = extracted(spark, *(t for _, t, _ in CASES))
    for (rule, _, want), defs in zip(CASES, got):
        assert [f"{n}@{line}" for n, line, _ in defs] == want, rule


#: (rule, source, (name, type, required) of each definition's arguments)
ARGUMENTS = [
    ("required, typed, bare", "component{ function Bake(required date due, numeric heat, pan){} }", [[("due", "date", True), ("heat", "numeric", False), ("pan", "", False)]]),
    ("defaults are passed over", "component{ function Bake(numeric heat = 220, any pan=deep()){} }", [[("heat", "numeric", False), ("pan", "any", False)]]),
    ("a comma in a default parts it", "component{ function Note(text = 'flour, salt'){} }", [[("text", "", False), ("salt", "", False)]]),
    ("a dotted type gives its first word", "component{ function Use(kitchen.Oven oven){} }", [[("kitchen", "", False)]]),
    ("parts in comments are left out", "component{ function Use(numeric racks, /* spare */ tray){} }", [[("racks", "numeric", False)]]),
    ("none", "component{ function Rest( ){} }", [[]]),
    ("tags, in their order", "<cffunction name='Mix'><cfargument type='query' name='rows' required='YES'><cfargument name='speed' required='0'><cfargument hint='nameless'></cffunction>", [[("rows", "query", True), ("speed", "", False)]]),
    ("tags up to the next function", "<cffunction name='A'><cfargument name='a1'><cffunction name='B'><!--- <cfargument name='gone'> ---><cfargument name='b1'></cffunction><cfargument name='late'>", [[("a1", "", False)], [("b1", "", False)]]),
]


def test_arguments(spark):
    got = extracted(spark, *(t for _, t, _ in ARGUMENTS))
    for (rule, _, want), defs in zip(ARGUMENTS, got):
        assert [a for _, _, a in defs] == want, rule


def test_regions(spark):
    texts = {
        "script": "\r\n component accessors=true {", "behind comments": "/* 1 */ <!--- 2 --->\ninterface {", "property": "property type='any';", "tag": "<cfcomponent>component {",
        "mixed": "<p>\n<cfScript>one</CFSCRIPT> \n<cfscript>\u2003</cfscript>\n<br><cfscript>two", "blank": "\t\n", "null": None,
    }
    rows = regions(spark.createDataFrame(list(texts.items()), FILES)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.uri, r.ord)):
        got.setdefault(r.uri, []).append((r.kind, r.start_line, r.start_off, r.text))
    assert [k for k in texts if got.get(k, [("", 0, 0, "")])[0][0] == "script"] == ["script", "behind comments", "property"]
    assert got["mixed"] == [("tag", 0, 0, "<p>\n"), ("script", 1, 14, "one"), ("tag", 2, 52, "\n<br>"), ("script", 3, 67, "two")]
    assert not {"blank", "null"} & got.keys()


def test_signatures_against_one_expression():
    """Where a script signature begins: looking back from the keyword gives what one unanchored expression finds."""
    whole = re.compile(r"(?:(?:public|private|remote|package)[\t\n\f\r ]+)?(?:[0-9A-Za-z_]+[\t\n\f\r ]+)?function[\t\n\f\r ]+([0-9A-Za-z_]+)[\t\n\f\r ]*\(", re.I | re.A)
    rng = random.Random(31)
    pieces = ["public", "Private", "x", "function", "function ", " ", "\n", "f(", "g (", ")", "any ", "é", "(", "package\t"]
    for _ in range(20_000):
        s = Source("".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))))
        floor, got = 0, []
        for m in SCRIPT_SIGNATURE.finditer(s.text):
            got.append((s.script_start(m.start(), floor), m[1]))
            floor = m.end()
        assert got == [(m.start(), m[1]) for m in whole.finditer(s.text)], s.text


def test_time_grows_with_the_length():
    def took(n):
        script = Source("component {\n" + "".join(f"/* {i} */ public any function f{i}(required numeric a, b = 'x') {{}}\n" for i in range(n)) + "}")
        tags = Source("".join(f"<cffunction name='t{i}'><cfargument name='a'></cffunction>\n<cfscript>function s{i}(){{}}</cfscript>\n" for i in range(n)))
        began = time.process_time()
        assert (len(list(script.definitions())), len(list(tags.definitions()))) == (n, 2 * n)
        return time.process_time() - began

    took(500)
    assert min(took(8000) for _ in range(2)) < 3 * min(took(4000) for _ in range(3))


#: The signature of a tag function as one expression, which says what is one but may take long to find it.
SLOW = re.compile(r"<cffunction[\t\n\f\r ](?:[^>]*[^0-9A-Za-z_>])?(?<![0-9A-Za-z_])name[\t\n\f\r ]*=[\t\n\f\r ]*[\"']([^\"']+)[\"']", re.I | re.A)


def test_tag_signatures_against_one_expression():
    rng = random.Random(41)
    pieces = ["<cffunction ", "<CFFUNCTION\t", "<cffunction", "name", "=", " ", '"', "'", ">", "x", "NAME='a'", 'name = "b"', "nickname='c'", " name='d>e'", "-name='f'", "name=''", "\n"]
    for _ in range(30_000):
        s = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        a = rng.randint(0, 3)
        b = len(s) - rng.randint(0, 3)
        assert list(tag_signatures(s, a, b)) == [(m.start(), m[1], m.end()) for m in SLOW.finditer(s, a, b)], (s, a, b)


@pytest.mark.parametrize("unit", ["<cffunction x ", "<cffunction name", "<cffunction name='a", "<cffunction name='a' ", "<cffunction >", "name='x'"])
def test_unclosed_tags_cost_no_more_than_their_length(unit):
    took = []
    for n in (8_000, 64_000):
        began = time.process_time()
        list(tag_signatures(unit * n, 0, len(unit) * n))
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.2  # eight times the text; a square would be sixty-four
