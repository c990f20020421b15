"""Small tables with every awkward case, as a folder of Parquet files."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def folder(spark, tmp_path):
    """write(name=(rows, schema)) makes tables, each with an extra column whose name clashes with the operators' own."""

    def write(**tables):
        for name, (rows, schema) in tables.items():
            df = spark.createDataFrame(rows, schema).withColumn("rank", F.lit("clash")).withColumn("shard", F.lit(-1)).withColumn("key", F.lit("k")).withColumn("component_id", F.lit("x")).withColumn("fp", F.lit(0.5)).withColumn("score", F.lit("s"))
            df.coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(*texts, langs=None):
    return [(i, t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS


AWKWARD = [None, "", " \t\n", "Short.", "Ünïcode ÀÉ ½²Ⅷ 😀 ΑΣ. İ", "a" * 5000, ("long words here, " * 20_000), "<|endoftext|> <|startoftext|>x", "it's 'LL don't", "\x00\x1c\x85 x", "tie tie tie", "tie tie tie"]
