"""A training corpus from raw documents: language, quality, near copies, mix, sequences.

Each stage works on all that the one before it kept, and its decisions take effect; all but the last return
the columns of documents. ORACLE_SQL is None, for SQL cannot express the learned and packed stages; tests
hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabspark.llm import host_rules, language, mixing, ngram_join, packing
from tabspark.llm.common import small_batches
from tabspark.session import scratch_path

ORACLE_SQL = None


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; those without a letter or with a narrow margin go."""
    small_batches(spark)
    return language.known_documents(docs)


def kept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules themselves and whose host passes them."""
    return host_rules.kept_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the mix of sources wants them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    import public_tokenizers
    small_batches(spark)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", told_language), ("quality", kept_quality), ("near_duplicates", one_of_each), ("mix", mixed), ("pack", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
