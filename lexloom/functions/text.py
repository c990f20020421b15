"""Column functions over text that stay in the JVM. Offsets are 0-based code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def newlines(text: Text) -> Column:
    """Number of line ends."""
    text = col(text)
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def head(text: Text, n: Column) -> Column:
    """The first n letters."""
    return F.substring(col(text), F.lit(1), n)


def tail(text: Text, start: Column) -> Column:
    """What follows the first `start` letters."""
    text = col(text)
    return F.substring(text, start + 1, F.length(text))


def text_before(text: Text, line: Text, character: Text) -> Column:
    """The text up to a cursor. A line beyond the last gives the whole text; a character beyond the line is cut to it."""
    text, line, character = col(text), col(line), col(character)
    lines = F.split(text, "\n", -1)
    above = F.concat(F.array_join(F.slice(lines, F.lit(1), line), "\n"), F.when(line > 0, "\n").otherwise(""))
    own = F.concat(F.get(lines, line), F.when(line + 1 < F.size(lines), "\n").otherwise(""))
    return F.when(line >= F.size(lines), text).otherwise(F.concat(above, F.substring(own, F.lit(1), character)))


def word_at(text: Text, line: Text, character: Text) -> Column:
    """The word of ASCII letters, digits and underscores that a cursor is in or just behind; else ''."""
    own = F.coalesce(F.get(F.split(col(text), "\n", -1), col(line)), F.lit(""))
    at = F.least(col(character), F.length(own))
    left = F.regexp_extract(head(own, at), r"[A-Za-z0-9_]*\z", 0)
    right = F.regexp_extract(tail(own, at), r"^[A-Za-z0-9_]*", 0)
    return F.concat(left, right)


def enclosing_tag(before: Text) -> Column:
    """Lower-cased name of the tag whose attributes the text ends in; else ''."""
    return F.lower(F.regexp_extract(col(before), r"<[ \t]*([^ \t\r\n/<>]+)[ \t\r\n/][^<>]*\z", 1))


def in_closing_tag(before: Text) -> Column:
    return F.endswith(col(before), F.lit("</"))


def first_line(text: Text) -> Column:
    return F.substring_index(col(text), "\n", 1)


def uri_path(uri: Text) -> Column:
    return F.regexp_replace(col(uri), "^file://", "")


def is_component_file(uri: Text) -> Column:
    return F.endswith(F.lower(col(uri)), F.lit(".cfc"))


def socket_name(workspace: Text) -> Column:
    """Hex of the first 8 bytes of the name's SHA-256."""
    return F.substring(F.sha2(col(workspace), 256), 1, 16)


def json_literal(text: Text) -> Column:
    """The text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(col(text).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
