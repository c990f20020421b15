"""Lexing of source files in one pass over Arrow batches: comments, regions, function signatures and their arguments.

Nested comments and balanced parentheses are beyond regular expressions, and offsets and line numbers cost a column function
a copy of the text for each match. So each text crosses to Python once and is read from left to right; comments, lines and
borders are looked up by bisection, and a file costs as many steps as it has tokens, however many functions it holds.
Offsets are code points. Null text has neither comments nor regions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

STRING = r"\"(?:\\.|[^\"\\])*(?:\"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z)"
TOKEN = re.compile(rf"(?P<string>{STRING})|(?P<nested><!---)|(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)", re.S)
NESTING = re.compile(r"<!---|-->")
PAREN = re.compile(r"[()]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)", re.S)
#: The blanks that a region or an argument may consist of, and the dialect's own white space and word letters.
BLANK = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WS, WORD = r"[\t\n\f\r ]", r"[0-9A-Za-z_]"
#: What the dialect takes as access words, script openings, signatures and attributes.
ACCESS = ("public", "private", "remote", "package")
OPENING = re.compile(r"component|interface|property[ \t]")
SCRIPT_BLOCK = re.compile(r"<cfscript>(.*?)(?:</cfscript>|\Z)", re.S | re.I | re.A)
SCRIPT_SIGNATURE = re.compile(rf"function{WS}+({WORD}+){WS}*\(", re.I | re.A)
FUNCTION_TAG = re.compile(rf"<cffunction{WS}", re.I | re.A)
FUNCTION_BORDER = re.compile(r"</?cffunction", re.I | re.A)
ARGUMENT_TAG = re.compile(rf"<cfargument{WS}[^>]*>", re.I | re.A)
SCRIPT_ARGUMENT = re.compile(rf"(?:(required){WS}+)?(?:({WORD}+){WS}+)?({WORD}+)", re.I | re.A)
LETTER, SPACE = re.compile(WORD), re.compile(WS)


def attribute(name: str, value: str = r"[^\"']+") -> re.Pattern:
    return re.compile(rf"(?<!{WORD}){name}{WS}*={WS}*[\"']({value})[\"']", re.I | re.A)


NAME, TYPE, REQUIRED = attribute("name"), attribute("type"), attribute("required", "true|yes")
NAMED = re.compile(rf"(?={NAME.pattern})", re.I | re.A)  # also where one begins inside another's value


def tag_signatures(text: str, start: int, end: int) -> Iterator[tuple[int, str, int]]:
    """Start, name and end of each function tag with a name, in order. The name is the last one that begins before the tag's first
    ">", or anywhere behind it if there is no ">"; its value may go on behind that. Names and ends of tags are each looked for once,
    so that time grows with the text, however many tags are left open."""
    names = [(m.start(), m[1], m.end(1) + 1) for m in NAMED.finditer(text, start, end)]
    places = [p for p, _, _ in names]
    close = at = start
    while m := FUNCTION_TAG.search(text, at, end):
        if close < m.end():
            close = text.find(">", m.end(), end)
            close = end if close < 0 else close
        i = bisect_left(places, close) - 1
        if i >= 0 and places[i] >= m.end():
            yield m.start(), names[i][1], names[i][2]
            at = names[i][2]
        else:
            at = m.end()


def spans_of(text: str) -> list[tuple[int, int]]:
    """Half-open comment spans: nested <!--- --->, /* */ and //, outside quoted strings; an open one lasts to the end."""
    out, at = [], 0
    while m := TOKEN.search(text, at):
        at = m.end()
        if m["nested"]:
            depth = 1
            while depth:
                if not (n := NESTING.search(text, at)):
                    at = len(text)
                    break
                depth += 1 if n[0] == "<!---" else -1
                at = n.end()
        if not m["string"]:
            out.append((m.start(), at))
    return out


def enclosed(text: str, opening: int, end: int | None = None) -> str:
    """What the parenthesis at `opening` encloses, quoted strings skipped; to the end if it is never closed."""
    end = len(text) if end is None else end
    depth, at = 1, opening + 1
    while m := PAREN.search(text, at, end):
        at = m.end()
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return text[opening + 1 : m.start()]
    return text[opening + 1 : end]


class Region(NamedTuple):
    kind: str
    start: int
    end: int


class Argument(NamedTuple):
    name: str
    type: str
    required: bool


class Definition(NamedTuple):
    name: str
    line: int
    arguments: list[Argument]


class Source:
    """One file's text with what is looked up in it."""

    def __init__(self, text: str):
        self.text = text
        self.spans = spans_of(text)
        self.ends = [e for _, e in self.spans]

    @cached_property
    def line_ends(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self.text)]

    def line_at(self, at: int) -> int:
        return bisect_left(self.line_ends, at)

    def in_comment(self, at: int) -> bool:
        i = bisect_right(self.ends, at)
        return i < len(self.spans) and self.spans[i][0] <= at

    def is_script(self) -> bool:
        """Whether the first thing that is neither blank nor comment opens a script component."""
        at = 0
        for start, end in self.spans:
            if self.text[at:start].strip(" \t\r\n"):
                break
            at = end
        rest = re.compile(r"[ \t\r\n]*").match(self.text, at).end()
        return OPENING.match(self.text, rest) is not None

    def regions(self) -> list[Region]:
        """In file order, blank ones left out."""
        if self.is_script():
            return [Region("script", 0, len(self.text))]
        out, at = [], 0
        for m in SCRIPT_BLOCK.finditer(self.text):
            out += [Region("tag", at, m.start()), Region("script", m.start(1), m.end(1))]
            at = m.end()
        out.append(Region("tag", at, len(self.text)))
        return [r for r in out if self.text[r.start : r.end].strip(BLANK)]

    def script_start(self, keyword: int, floor: int) -> int:
        """Where a signature begins whose keyword is here: with an access word and a return type, if these stand before it."""
        text = self.text

        def back(at: int, letter: re.Pattern) -> int:
            while at > floor and letter.match(text, at - 1):
                at -= 1
            return at

        word_end = back(keyword, SPACE)
        word = back(word_end, LETTER) if word_end < keyword else word_end
        if word == word_end:
            return keyword
        before = back(word, SPACE)
        if before < word:
            tail = text[max(floor, before - 7) : before].lower()
            for a in ACCESS:
                if tail.endswith(a):
                    return before - len(a)
        return word

    def script_arguments(self, opening: int, end: int) -> list[Argument]:
        """Of a list in parentheses. Every comma separates, also in a default."""
        body, out = enclosed(self.text, opening, end), []
        for part in body.split(","):
            part = part.strip(BLANK)
            if part and not self.in_comment(opening + 1 + body.find(part)) and (m := SCRIPT_ARGUMENT.search(part)):
                out.append(Argument(m[3], m[2] or "", m[1] is not None))
        return out

    def tag_arguments(self, start: int, end: int) -> list[Argument]:
        out = []
        for m in ARGUMENT_TAG.finditer(self.text, start, end):
            if not self.in_comment(m.start()) and (name := NAME.search(m[0])):
                kind = TYPE.search(m[0])
                out.append(Argument(name[1], kind[1] if kind else "", REQUIRED.search(m[0]) is not None))
        return out

    def definitions(self) -> Iterator[Definition]:
        """In file order, those that start in a comment left out."""
        for kind, start, end in self.regions():
            if kind == "script":
                floor = start
                for m in SCRIPT_SIGNATURE.finditer(self.text, start, end):
                    at = self.script_start(m.start(), floor)
                    floor = m.end()
                    if not self.in_comment(at):
                        yield Definition(m[1], self.line_at(at), self.script_arguments(m.end() - 1, end))
                continue
            borders = [(m.start(), m[0][1] == "/") for m in FUNCTION_BORDER.finditer(self.text, start, end)]
            for tag, name, behind in tag_signatures(self.text, start, end):
                if not self.in_comment(tag):
                    i = bisect_left(borders, (behind, False))
                    while i < len(borders) and borders[i] == (behind, False):  # a function tag at once behind it is part of the body
                        i += 1
                    yield Definition(name, self.line_at(tag), self.tag_arguments(behind, borders[i][0] if i < len(borders) else end))


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
REGION = pa.struct([("kind", pa.string()), ("start_line", pa.int32()), ("start_off", pa.int32()), ("text", pa.string())])
ARGUMENT = pa.struct([("name", pa.string()), ("type", pa.string()), ("required", pa.bool_())])
DEFINITION = pa.struct([("name", pa.string()), ("line", pa.int32()), ("arguments", pa.list_(ARGUMENT))])


def list_of(kind: pa.DataType) -> T.ArrayType:
    return T.ArrayType(from_arrow_type(kind))


@F.arrow_udf(list_of(SPAN))
def comment_spans(texts: pa.Array) -> pa.Array:
    """The comment spans of each text."""
    return listed([spans_of(t.as_py() or "") for t in texts], SPAN)


PLACE = pa.struct([("pos", pa.int32()), ("hit", pa.string())])


def place_list(pattern: str):
    """A function for a column of texts: where the pattern is found, with what is found there."""
    regex = re.compile(pattern, re.A)

    @F.arrow_udf(list_of(PLACE))
    def run(texts: pa.Array) -> pa.Array:
        return listed([[(m.start(), m[0]) for m in regex.finditer(t.as_py() or "")] for t in texts], PLACE)

    return run


@F.arrow_udf(list_of(REGION))
def region_list(texts: pa.Array) -> pa.Array:
    """The regions of each text."""
    rows = []
    for t in texts:
        s = Source(t.as_py() or "")
        rows.append([(r.kind, s.line_at(r.start), r.start, s.text[r.start : r.end]) for r in s.regions()])
    return listed(rows, REGION)


@F.arrow_udf(list_of(DEFINITION))
def definition_list(texts: pa.Array) -> pa.Array:
    """The function definitions of each text."""
    rows = [list(Source(t.as_py() or "").definitions()) for t in texts]
    flat = [d for ds in rows for d in ds]
    fields = [pa.array([d.name for d in flat], pa.string()), pa.array([d.line for d in flat], pa.int32()), listed([d.arguments for d in flat], ARGUMENT)]
    return pa.ListArray.from_arrays(offsets(rows), pa.StructArray.from_arrays(fields, fields=list(DEFINITION)))


def offsets(rows: list[list]) -> pa.Array:
    at, out = 0, [0]
    for r in rows:
        at += len(r)
        out.append(at)
    return pa.array(out, pa.int32())


def listed(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Rows of tuples as an array of lists of structs."""
    flat = [x for r in rows for x in r]
    columns = [pa.array([x[k] for x in flat], f.type) for k, f in enumerate(kind)]
    return pa.ListArray.from_arrays(offsets(rows), pa.StructArray.from_arrays(columns, fields=list(kind)))
