"""Mixing, fill-in-the-middle and the manifest against plain versions, on awkward rows."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lexloom.llm import fim, merkle, mixing, ordered
from tests.llm.conftest import AWKWARD, DOCS, documents

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def by_sql(sql, folder_, columns):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{folder_}/documents.parquet/*.parquet'")
    return sorted((tuple(r) for r in c.sql(sql).select(*columns).fetchall()), key=str)


# the numbering below them


@pytest.mark.parametrize("keys", [["k"], []])
def test_numbers_are_gapless_and_in_order(spark, tmp_path, keys):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.2 else rng.choice("aab"), None if rng.random() < 0.1 else rng.randint(0, 9)) for _ in range(900)]
    spark.createDataFrame(rows, "k string, v int").repartition(7).write.parquet(f"{tmp_path}/t")
    got = ordered.numbered(spark, spark.read.parquet(f"{tmp_path}/t"), keys, [F.col("v").desc_nulls_last()]).collect()
    assert len(got) == len(rows)
    for key in {r[0] for r in rows} if keys else {0}:
        mine = sorted((r for r in got if not keys or r.k == key), key=lambda r: r.number)
        assert [r.number for r in mine] == list(range(len(mine))) and {r.of for r in mine} == {len(mine)}
        values = [float("-inf") if r.v is None else r.v for r in mine]
        assert values == sorted(values, reverse=True)


def test_numbering_nothing(spark, tmp_path):
    spark.createDataFrame([], "k string, v int").write.parquet(f"{tmp_path}/t")
    assert ordered.numbered(spark, spark.read.parquet(f"{tmp_path}/t"), ["k"], [F.col("v").asc()]).count() == 0


# 11


def plain_targets(sizes):
    """Source sizes in order to targets: what is above three times the size is shared out again until nothing is."""
    weights = [1 + i % 3 for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        shares = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        full = {i for i in open_ if shares[i] > 3 * sizes[i]}
        for i in full or open_:
            out[i] = 3.0 * sizes[i] if full else shares[i]
        left -= sum(out[i] for i in full)
        open_ -= full or open_
    return out


def test_targets(spark, tmp_path):
    rng = random.Random(3)
    for case, sizes in enumerate([[5], [0, 0], [1, 1, 1000], [0, 7, 3, 90_000, 2, 2, 2, 800], [rng.randint(0, 10 ** rng.randint(0, 6)) for _ in range(200)]]):
        names = [f"s{i:03d}" for i in range(len(sizes) - 1)] + [None]
        spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long").repartition(3).write.parquet(f"{tmp_path}/t{case}")
        got = {r.source: r.target for r in mixing.targets(spark, spark.read.parquet(f"{tmp_path}/t{case}")).collect()}
        assert [got[n] for n in names] == pytest.approx(plain_targets(sizes))
        assert sum(got.values()) == pytest.approx(sum(sizes))


def mixed_rows():
    rng = random.Random(5)
    rows = [(i, t, "en", [None, "a", "", "é"][i % 4], 0) for i, t in enumerate(AWKWARD)]
    for i in range(400):
        source = "hot" if i % 3 == 0 else rng.choice([None, "a", "Z", "\U0001f600", "￿"])
        rows.append((100 + i // 2 if i % 20 else None, "w " * int(rng.lognormvariate(3, 1)) + "\x0bx\x1cy", "en", source, 0))
    return rows


def test_mixing(spark, folder):
    data = mixed_rows()
    where = folder(documents=(data + data[-9:], DOCS))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    got = tuples(mixing.op11(spark, where), *columns)
    near = lambda rows: [(*r[:3], pytest.approx(r[3]), r[4]) for r in rows]
    assert got == near(by_sql(mixing.ORACLE, where, columns)) and got == tuples(mixing.op11(spark, where), *columns)
    data = data + data[-9:]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r[1] for r in got) == sorted(size(d[1]) for d in data)
    order = sorted({d[3] for d in data}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(d[1]) for d in data if d[3] == s) for s in order]
    assert len(set(sizes)) == len(sizes)
    for total, target in zip(sizes, plain_targets(sizes)):
        mine = [r for r in got if r[2] == total]
        assert all(r[3] == pytest.approx(target) and 0 <= r[4] <= 3 * r[1] and (r[1] == 0 or r[4] % r[1] == 0) for r in mine)
        assert abs(sum(r[4] for r in mine) - target) <= max(r[1] for r in mine)
        rates = {r[4] // r[1] - int(target / total) for r in mine if r[1]}
        assert rates <= {0, 1}  # the rate rounded down or up


def test_a_crossing_emits_once(spark):
    """The copies in order are those of a plain walk over the sum of expected copies."""
    for rate, shift in [(0.3, 0.25), (2.75, 0.5), (3.0, 0.9375), (0.0, 0.5), (1 / 3, 0.0)]:
        got = [r[0] for r in spark.range(50).select(mixing.crossed(F.col("id"), F.lit(rate), F.lit(shift)).alias("c")).collect()]
        total, want = shift, []
        for k in range(50):
            want.append(sum(1 for whole in range(1, 200) if rate * k + shift < whole <= rate * (k + 1) + shift))
        assert got == want and max(got) <= 3, (rate, total)


def test_documents_are_emitted(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.col("id").alias("size"), F.lit("x").alias("target"))
    out = mixing.mixed(spark, df, F.col("size"))
    assert out.columns == ["doc_id", "source", "size", "target", "size_", "source_size", "target_", "copies"]
    copies = {r.doc_id: r.copies for r in out.collect()}
    got = mixing.emitted(out).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last")).collect()
    assert {r.doc_id: r.n for r in got} == {d: n for d, n in copies.items() if n} and all(r.n == r.last for r in got)


def test_mixing_of_nothing(spark, folder):
    assert mixing.op11(spark, folder(documents=([], DOCS))).count() == 0
    assert tuples(mixing.op11(spark, folder(documents=documents(None, "", " "))), "size", "target", "taken") == [(0, 0.0, 0)] * 3


# 12


@pytest.mark.parametrize(("every", "chunk"), [(1, 7), (4, 5), (3, 64), (1024, 1 << 16)])
def test_checkpoints(monkeypatch, every, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    rng = random.Random(every)
    for n in [0, 1, 2, 3, 4, 5, 8, 63, 64, 65, 300, 3000]:
        text = "".join(rng.choice("aé€😀́\n") for _ in range(n))
        index = fim.Checkpoints(text.encode(), every)
        assert index.n == n and index.units == list(range(0, max(n, 1), every)) and index.bytes == [len(text[:u].encode()) for u in index.units]
        for unit in {0, n, *(rng.randint(0, n) for _ in range(40))}:
            assert index.byte_of(unit) == len(text[:unit].encode())


def plain_fim(doc_id, text):
    text, n = text or "", len(text or "")
    h = [int(SHA(f"1:{'' if doc_id is None else doc_id}")[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, SHA(text), SHA(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, SHA(f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"), SHA(text)
    return doc_id, n, "psm", a, b - a, SHA(f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), SHA(text)


FIM = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_fill_in_the_middle(spark, folder):
    texts = [*AWKWARD, "a<P>b", "<S>", "x<M", "<", "P>", "<<<<PSM>>>>", "<S<P<M", "é€😀\n" * 700_000, *("ab<" * 9 + "S>PM<" * i for i in range(80))]
    rows, schema = documents(*texts)
    rows += [rows[4], (None, "no key", "en", "s", 1), (None, None, None, None, None)]
    where = folder(documents=(rows, schema))
    got = tuples(fim.op12(spark, where), *FIM)
    assert got == sorted((plain_fim(r[0], r[1]) for r in rows), key=str) == by_sql(fim.ORACLE, where, FIM)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.op12(spark, folder(documents=([], DOCS))).count() == 0


def test_fill_in_the_middle_carries_columns(spark, monkeypatch):
    monkeypatch.setattr(fim, "OUT_BYTES", 50)  # several batches given out for one
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("clash").alias("n"), F.concat(F.lit("some text "), F.col("id")).alias("text"), F.array("id").alias("form"), (F.col("id") * 2).alias("_key"))
    out = fim.transformed(df)
    assert out.columns == ["doc_id", "n", "text", "form", "_key", "n_", "form_", "prefix_chars", "middle_chars", "output"]
    for r in out.withColumn("again", fim.restored(F.col("output"), F.col("form_"))).collect():
        assert r["n"] == "clash" and r["form"] == [r.doc_id] and r["_key"] == 2 * r.doc_id and r.again == r.text == f"some text {r.doc_id}" and r.n_ == len(r.text)


# 13


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([SHA("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def plain_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars) to the contract's columns."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: SHA("".join(map(field, (r[0], r[3], r[2], r[4], t))))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0], leaf(r, r[1])))
        trees[s] = mine, plain_levels([leaf(r, r[1]) for r in mine])
    top = plain_levels([trees[s][1][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        mine, levels = trees[s]
        for k, r in enumerate(mine):
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded, proof = leaf(r, text), ""
            for tree, at in ((levels, k), (top, j)):
                for level in tree[:-1]:
                    run, place = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += "".join(run[:place] + run[place + 1 :])
                    folded = SHA("".join(run[:place] + [folded] + run[place + 1 :]))
                    at //= 16
            out.append((r[0], levels[0][k], levels[-1][0], top[-1][0], SHA(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


MERKLE = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def leaves(*sizes):
    rng, rows = random.Random(7), []
    for n, source in zip(sizes, [None, "", "a", "￿", "\U0001f600", "b", "c"]):
        rows += [(rng.randint(-9, 10**6), rng.choice([None, "", "Some Text", "ÀB é😀", "lower"]), rng.choice([None, "en"]), source, rng.choice([None, 5])) for _ in range(n)]
    return rows


@pytest.mark.parametrize("depth", [1, 2])
def test_manifest(spark, folder, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK_BITS", 4 * depth)
    rows = leaves(1, 16, 17, 256, 257, 700, 2)
    rows += [rows[40], rows[40], (None, "A", "en", "a", 1), (None, "A", "en", "a", 1), (3, "x" * 300_000, "en", "a", 1)] + [(i, t, "en", "awkward", 0) for i, t in enumerate(AWKWARD)]
    where = folder(documents=(rows, DOCS))
    got = tuples(merkle.op13(spark, where), *MERKLE)
    assert got == plain_manifest(rows) == by_sql(merkle.ORACLE, where, MERKLE)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], leaves(1), leaves(3), [r[:3] + (f"s{i}",) + r[4:] for i, r in enumerate(leaves(300))]])
def test_small_manifests(spark, folder, rows):
    """No leaf, one leaf, one source, and more sources than a run or a block holds."""
    where = folder(documents=(rows, DOCS))
    assert tuples(merkle.op13(spark, where), *MERKLE) == plain_manifest(rows)


def test_proofs_travel_in_blocks_of_any_source(spark, folder, monkeypatch):
    """The same without broadcasts, as with more proofs than may be broadcast."""
    monkeypatch.setattr(merkle, "FEW", 0)
    rows = leaves(30, 300)
    assert tuples(merkle.op13(spark, folder(documents=(rows, DOCS))), *MERKLE) == plain_manifest(rows)
