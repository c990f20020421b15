"""The pipeline against plain loops over the operators' per-text functions, and the registered SQL."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from lexloom.llm import langid, quality, queries
from tests.llm.conftest import AWKWARD, DOCS, documents
from tests.llm.test_ops import check_packed, plain_fingerprint, plain_groups, prose_text

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, folder):
    rng = random.Random(15)
    texts = list(AWKWARD)
    for seed in range(25):
        t = prose_text(seed, 10)
        texts += [t] * rng.choice([1, 1, 3]) + ([t.replace("so", "no", 1)] if seed % 3 == 0 else [])
    texts += ["1234 5678 9012, 3456 7890.\n" + "".join(f"{i}{i * 3} {i + 7}, {i * i}.\n" for i in range(40)), "W### x$$$ " * 60]
    data, schema = documents(*texts, langs=[("en", None, "de")[i % 3] for i in range(len(texts))])
    data += [data[20]]
    sf = folder(documents=(data, schema))
    docs = spark.createDataFrame(data, schema)

    judged = {i: quality.judged(t) for i, t in enumerate(texts)}
    kept = {i: (j["clean_text"] if j["n_failed_lines"] else texts[i]) for i, j in judged.items() if j["kept"]}
    step = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert step.columns == docs.columns and sorted(r.doc_id for r in step.collect()) == sorted([*kept, *([20] if 20 in kept else [])])
    tagger = langid.Tagger(langid.fitted(langid.sample(step.select("doc_id", "text", "lang"))))
    said = dict(zip(kept, tagger.predicted(list(kept.values()))))
    spoken = {i: t for i, t in kept.items() if said[i][0] != "und" and said[i][1] >= 0.4}
    assert len(spoken) < len(kept)
    fps = {i: plain_fingerprint(t) for i, t in spoken.items()}
    group = plain_groups(set(fps.values()))
    first = {}
    for i in sorted(fps):
        first.setdefault(group[fps[i]], i)
    left = [spoken[i] for i in sorted(first.values())]
    number = {i: n for n, i in enumerate(sorted(first.values()))}

    class Row:
        def __init__(self, r):
            self.__dict__ = r.asDict() | {"doc_id": number[r.doc_id]}

    check_packed([Row(r) for r in corpus_pipeline.run(spark, sf).collect()], left)


def test_pipeline_of_nothing(spark, folder):
    assert corpus_pipeline.run(spark, folder(documents=([], DOCS))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    # row by row and not by pandas, in which a whole number beside a null is no whole number
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == sorted(map(str, want.select(*(f'"{x}"' for x in columns)).fetchall()))
