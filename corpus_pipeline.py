"""A corpus goes through language ID, exact and near deduplication, decontamination and tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared
folder and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontam, exact_dedup, langid, near_dedup
from tidemark.llm.common import stash
from tidemark.llm.queries import table, vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; those they reject go, and so do texts without letters, null ones too."""
    return langid.keep_identified(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest text, then least id, of each group of equal texts; a repeated row stays once."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each near-duplicate component at a similarity of 0.8; texts without words stay."""
    return near_dedup.drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no benchmark item; all of them when there is none."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each document."""
    return bpe.token_digest(docs, vocabulary_path())


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("decontamination", clean), ("BPE", tokens)]
#: No stage but exact deduplication can be said in SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
