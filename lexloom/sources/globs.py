"""Glob patterns: compiled to anchored regular expressions on the driver. sources.files expands them over a file system.

"*" and "?" do not cross "/", "[...]" is a class and "\\" quotes. In a pattern with "**" what stands before is a folder, and
what stands behind is matched against a file's base name alone.
"""

from __future__ import annotations

import posixpath
import re

from pyarrow import fs as arrow_fs
from pyspark.sql import Column
from pyspark.sql import functions as F

META = re.compile(r"[*?\[\\]")
SCHEME = re.compile(r"^([a-z][a-z0-9+.-]*://)", re.I)


class BadPattern(ValueError):
    """A class that is not closed, or a trailing backslash."""


def to_regex(pattern: str) -> str:
    """The pattern for whole strings, in a dialect that Java and Python share."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if at == len(pattern):
                raise BadPattern(pattern)
            out.append(re.escape(pattern[at]))
            at += 1
        elif c == "[":
            m = re.compile(r"(\^?)((?:\\.|[^\]\\])+)\]", re.S).match(pattern, at)
            if not m:
                raise BadPattern(pattern)
            body = re.sub(r"\\?(.)", lambda x: x[1] if x[0] == "-" else re.escape(x[1]), m[2], flags=re.S)
            out.append(f"(?!/)[{m[1]}{body}]")
            at = m.end()
        else:
            out.append(re.escape(c))
    return "".join(out)


def split_pattern(pattern: str) -> tuple[str, str] | None:
    """(folder, base-name pattern) of a pattern with "**", at the first one."""
    if "**" not in pattern:
        return None
    scheme = m[1] if (m := SCHEME.match(pattern)) else ""
    base, _, rest = pattern.removeprefix(scheme).partition("**")
    return scheme + (posixpath.normpath(base) if base else "."), rest.removeprefix("/")


def matches(path: Column, globs: list[str]) -> Column:
    """Whether a path is taken in by one of the globs."""
    out = F.lit(False)
    for g in globs:
        split = split_pattern(g)
        if split is None:
            out = out | F.startswith(path, F.lit(g + "/")) | (path == g)
            pattern = or_none(g)
            if pattern is not None:
                out = out | path.rlike(rf"\A(?s:{pattern})\z")
            continue
        base, suffix = split
        under = F.startswith(path, F.lit(base + "/")) | (path == base)
        pattern = or_none(suffix)
        if suffix == "":
            out = out | under
        elif pattern is not None:
            out = out | (under & F.substring_index(path, "/", -1).rlike(rf"\A(?s:{pattern})\z"))
    return out


def or_none(pattern: str) -> str | None:
    try:
        return to_regex(pattern)
    except BadPattern:
        return None


def listed(fs: arrow_fs.FileSystem, folder: str) -> tuple[list[str], list[str]]:
    """Folders and files directly in a folder, in order, hidden and empty ones too; none if it cannot be read."""
    try:
        found = fs.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
    except OSError:
        return [], []
    of = lambda kind: sorted(i.path for i in found if i.type == kind)
    return of(arrow_fs.FileType.Directory), of(arrow_fs.FileType.File)


def components(pattern: str) -> tuple[str, ...]:
    return tuple(filter(None, pattern.split("/")))


def whole_regex(pattern: str) -> str | None:
    """The pattern for whole paths, repeated slashes as one; None for a bad one, which names nothing."""
    if any(or_none(c) is None for c in components(pattern)):
        return None
    return ("/" if pattern.startswith("/") else "") + "/".join(map(to_regex, components(pattern)))
