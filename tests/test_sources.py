"""Scans, globs, configuration."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom.functions.text import json_literal, socket_name
from lexloom.sources import archive, config, files, globs, work


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a.cfc": "component {}", "B.CFC": "b", "_x.cfc": "x", ".git/x.cfc": "g", "sub/deep/c d.cfc": "c", "empty.cfc": "", "n.txt": "n", "sub/é.cfc": "é\r\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    return tmp_path


def read(df, tree):
    return {r.uri.removeprefix(f"file://{tree}/"): r.text for r in df.collect()}


def test_scan_takes_hidden_and_empty_files(spark, tree):
    got = read(files.scan(spark, [str(tree), str(tree / "a.cfc"), str(tree / "missing")]), tree)
    assert got == {"a.cfc": "component {}", "B.CFC": "b", "_x.cfc": "x", ".git/x.cfc": "g", "sub/deep/c d.cfc": "c", "empty.cfc": "", "sub/é.cfc": "é\r\n"}


def test_scan_of_a_workspace(spark, tree):
    one = lambda *a: sorted(read(files.scan_workspace(spark, *a), tree))
    assert one([str(tree / "sub")], [], [str(tree)]) == ["sub/deep/c d.cfc", "sub/é.cfc"]
    assert one([str(tree)], [f"{tree}/**/c*.cfc", f"{tree}/*.CFC"], []) == ["B.CFC", "sub/deep/c d.cfc"]
    assert len(one([], [], [str(tree)])) == 7


def test_fast_scan(spark, tree):
    assert read(files.scan_fast(spark, [str(tree), str(tree / "missing")]), tree) == {"a.cfc": "component {}", "B.CFC": "b", "sub/deep/c d.cfc": "c", "sub/é.cfc": "é\r\n"}
    assert files.scan_fast(spark, [str(tree / "missing")]).count() == 0
    assert files.scan_fast(spark, [f"{tree}/sub/", str(tree), str(tree), f"{tree}/sub/deep"]).count() == 4


PATHS = ["/w/a.cfc", "/w/d/b.cfc", "/w/d/e/b.cfc", "/wx/a.cfc", "/w", "/w/[x].cfc"]
GLOBS = [
    ("/w/*.cfc", ["/w/a.cfc", "/w/[x].cfc"]), ("/w", ["/w/a.cfc", "/w/d/b.cfc", "/w/d/e/b.cfc", "/w", "/w/[x].cfc"]), ("/w/**", ["/w/a.cfc", "/w/d/b.cfc", "/w/d/e/b.cfc", "/w", "/w/[x].cfc"]),
    ("/w/**/b.cfc", ["/w/d/b.cfc", "/w/d/e/b.cfc"]), ("/w/**/e/b.cfc", []), ("/w/[a-c].cfc", ["/w/a.cfc"]), ("/w/[^a].cfc", []), ("/w/\\[x\\].cfc", ["/w/[x].cfc"]), ("/w/?.cfc", ["/w/a.cfc"]), ("/w/[", []),
]


@pytest.mark.parametrize(("glob", "want"), GLOBS)
def test_globs(spark, glob, want):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    assert sorted(r.path for r in df.where(globs.matches(F.col("path"), [glob])).collect()) == sorted(want)


def test_expansion(spark, tree):
    short = lambda *patterns: sorted(r.uri.removeprefix(f"file://{tree}/") for r in files.scan(spark, [f"{tree}/{p}" for p in patterns]).collect())
    assert short("*.cfc") == ["_x.cfc", "a.cfc", "empty.cfc"]
    assert short("sub/**") == ["sub/deep/c d.cfc", "sub/é.cfc"]
    assert short("**/x.*") == [".git/x.cfc"]
    assert short("none/**") == [] and short("[") == [] and short("sub/[/x") == []
    assert short("s?b//*/c*") == ["sub/deep/c d.cfc"] and short("*/é.cfc", "*/*.cfc", "a.cfc", "*.cfc") == sorted(short("*/*.cfc") + short("*.cfc"))
    assert short("*b/none.cfc") == [] and short("*") == short("*.[cC][fF][cC]") and short("su[^b]/*") == []


def test_many_globbed_files(spark, tmp_path):
    """A pattern of several steps over many folders, whose files no list holds: twice as many cost twice the time at most."""
    for i in range(40):
        (tmp_path / f"d{i}" / "in").mkdir(parents=True)
        for j in range(25):
            (tmp_path / f"d{i}" / "in" / f"f{j}.cfc").write_text("x")
    df = files.scan(spark, [f"{tmp_path}/d1*/in/f1.cfc", f"{tmp_path}/d[0-9]*/in/f*.cfc", f"{tmp_path}/d3/**"])
    assert df.count() == df.distinct().count() == 1000
    entry = files.Entry(f"{tmp_path}/d*/in/*.cfc")
    assert entry.files is None and entry.takes(f"{tmp_path}/d3/in/f1.cfc") and not entry.takes(f"{tmp_path}/d3/in/x/f1.cfc")


def test_config(tmp_path):
    inner = tmp_path / "in"
    inner.mkdir()
    assert config.find_config(str(inner)) is None
    raw = {"workspaceName": "shop", "workspacePaths": ["../lib", "in"], "workspaceIndexGlobs": ["lib/**/*.cfc", "other/*.cfc", "in"]}
    (tmp_path / config.FILE).write_text(json.dumps(raw))
    (inner / config.FILE).write_text('{"workspacePaths": []}')
    c = config.find_config(str(inner))
    assert c.name == "shop"
    assert c.folders() == [str(tmp_path.parent / "lib"), str(inner)]
    assert c.index_globs() == [f"{tmp_path.parent}/lib/**/*.cfc", str(inner)]


def test_scalars(spark):
    r = spark.createDataFrame([('a"b\n', json.dumps({"workspaceName": "n", "workspacePaths": ["x"]}))], "t string, c string").select(json_literal("t").alias("j"), config.parsed("c").alias("c"), socket_name("t").alias("s")).first()
    assert json.loads(r.j) == 'a"b\n' and r.c.workspacePaths == ["x"] and len(r.s) == 16


def test_archive_is_read_when_it_has_changed(tmp_path):
    def pack(*names):
        inner = io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            for n in names:
                z.writestr(n, "{}")
        with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
            z.writestr("deep/inner.zip", inner.getvalue())
            z.writestr("note.txt", "x")

    got = lambda: sorted(p.name for p in (tmp_path / "data").iterdir() if not p.name.startswith("."))
    paths = (str(tmp_path / "all.zip"), f"file://{tmp_path}/data")
    pack("a/oven.json", "../rack.json", "tray.md")
    assert archive.refreshed(*paths, "1") and got() == ["oven.json", "rack.json"]
    pack("b.json")
    assert not archive.refreshed(*paths, "1") and got() == ["oven.json", "rack.json"]
    assert archive.refreshed(*paths, "2") and got() == ["b.json"]
    assert archive.refreshed(*paths) and not archive.refreshed(*paths)


def test_overlapping_paths_are_read_once_in_few_shares(spark, tree):
    every = [str(tree), f"{tree}/sub", f"{tree}/**/c*.cfc", f"{tree}/*.cfc", str(tree / "a.cfc"), f"file://{tree}/sub/deep"]
    for share in (1, 64):
        assert len(files.scan(spark, every, share).collect()) == 7
    deep = tree / "many"
    for i in range(90):
        (deep / f"d{i}" / "x").mkdir(parents=True)
        (deep / f"d{i}" / "x" / "f.cfc").write_text("f")
    assert files.scan(spark, [str(deep)]).count() == 90
    assert files.scan(spark, [str(tree / "none"), f"{tree}/none/*.cfc", f"{tree}/["]).count() == 0


def test_own_folders_are_deleted_at_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(work, "_OWN", [])
    monkeypatch.setattr(work.atexit, "register", lambda f: None)
    a, b, c = (work.own_folder(spark, n) for n in "abc")
    spark.range(3).write.parquet(a)
    spark.range(3).write.parquet(b)
    assert len({a, b, c}) == 3 and spark.read.parquet(b).count() == 3
    work.clear_own()
    assert all(files.Entry.kind(x) == files.arrow_fs.FileType.NotFound for x in (a, b, c)) and work._OWN == []
