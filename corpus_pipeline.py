"""Corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A runner may
write what a stage returns and read it again as the next one's docs; run() does so too, in the shared folder, so that no stage runs twice.

1. quality: documents that the line-first rules reject go, failing lines of the others are taken out.
2. language: documents without a known language go.
3. near_dedup: one document of each group of SimHash near-duplicates stays.
4. packing: the rest is cut into token pieces and packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import langid, packing, quality, simhash
from lexloom.llm.common import cleared, mark, written

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_stage(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.language_stage(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(spark, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality_rules), ("language ID", language), ("SimHash near-dedup", near_dedup), ("best-fit packing", best_fit_packing)]

#: The language model and the fingerprints are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for _, stage in STAGES[:-1]:
        docs, path = written(spark, stage(spark, docs, sf_dir), "stage")
        cleared(spark, since, path)  # what the stage itself wrote, and what it read
    return STAGES[-1][1](spark, docs, sf_dir)
