"""Workspace configuration: a small JSON file, read on the driver."""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import socket_name
from lexloom.schemas import CONFIG
from lexloom.sources.files import opened
from lexloom.sources.globs import SCHEME

FILE = ".workspace.json"  # the default only: find_config takes the name that a project uses


@dataclass
class Config:
    path: str
    name: str
    paths: list[str] = field(default_factory=list)
    globs: list[str] = field(default_factory=list)
    scheme: str = ""  # what makes paths on this file system uris

    def folders(self) -> list[str]:
        """Absolute folders, relative ones taken from the file's folder."""
        return [self.scheme + posixpath.normpath(posixpath.join(posixpath.dirname(self.path), p)) for p in self.paths]

    def index_globs(self) -> list[str]:
        """Globs with the folder's name at their head replaced by the folder; others are dropped; of two folders of one name
        the last counts."""
        by_name = {posixpath.basename(f): f for f in self.folders()}
        heads = (g.partition("/") for g in self.globs)
        return [by_name[head] + slash + rest for head, slash, rest in heads if head in by_name]


def find_config(folder: str, file: str = FILE) -> Config | None:
    """The first usable file in the folder or its parent; missing, malformed and nameless ones are passed over."""
    fs, inner, scheme = opened(folder)
    for where in (inner, posixpath.dirname(inner)):
        path = posixpath.join(where, file)
        try:
            with fs.open_input_stream(path) as f:
                raw = json.loads(f.read())
            if raw.get("workspaceName"):
                return Config(path, raw["workspaceName"], list(raw.get("workspacePaths") or []), list(raw.get("workspaceIndexGlobs") or []), scheme if SCHEME.match(folder) else "")
        except (OSError, ValueError, AttributeError):
            continue
    return None


def resolved_globs(globs: DataFrame, folders: DataFrame) -> DataFrame:
    """The same for tables: globs (glob) and folders (ord, path) to glob, resolved. An inner join on the folder's name; of two
    folders of one name the last counts."""
    named = folders.groupBy(F.substring_index("path", "/", -1).alias("_head")).agg(F.max_by("path", "ord").alias("_path"))
    head = F.substring_index("glob", "/", 1)
    rest = F.substring(F.col("glob"), F.length(head) + 1, F.length("glob"))
    return globs.join(named, head == F.col("_head")).select("glob", F.concat("_path", rest).alias("resolved"))


def parsed(json_text: str | Column) -> Column:
    """The same file's fields as a struct column, for tables of configurations."""
    return F.from_json(json_text, CONFIG)


__all__ = ["Config", "find_config", "parsed", "resolved_globs", "socket_name"]
