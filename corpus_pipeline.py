"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfscope.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from shelfscope.llm.common import begin, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; the source of a document takes the part of its host, and nothing that of its suffix."""
    begin(spark)
    return language_id.drop_rejected(docs, declared=docs["lang"], host=docs["source"])


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    begin(spark)
    return exact_dedup.drop_duplicates(docs)


def unlike_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    begin(spark)
    return near_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go."""
    begin(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    begin(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), separator=2)
    return pieces.withColumnRenamed("__id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", unique_texts),
    ("near_dedup", unlike_texts),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# No SQL: language scores, weighted samples and packing are not expressible. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
