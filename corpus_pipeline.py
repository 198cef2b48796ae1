"""The corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, mixing of sources, BPE encoding.

Each stage works on everything that the stage before it kept: documents without a language go; of each class of near
duplicates the document with the smallest id stays; passages that an earlier document holds are cut out of the texts, and
documents of which nothing is left go; documents of lighter sources are repeated until the weights of the sources meet the
repetition limit, and none is lost; and what is left is encoded: the last stage adds the ids, how many they are, and the
hashes of the ids and of the text that they decode to. Stages keep all columns of their input, null sources and rows without
a doc_id included. The first stage rejects texts without a letter, and those whose language is told with a score under
language.LEAST_SCORE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import bpe, language, mixing, ngram_join, passages
from tidemill.llm.common import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.language_stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_stage(spark, docs, sf_dir)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.passage_stage(spark, docs, sf_dir)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, max_repetition=mixing.MAX_REPETITION)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_stage(spark, docs, sf_dir)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: SQL has no trained network, suffix array or BPE: tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
