"""A training corpus from raw documents: five stages, each over all that the one before kept.

The language stage rejects documents without letters or with a score below a floor that follows the held-out
documents, LEAST_SCORE at least; one document of each near-duplicate class stays (five-word shingles, 0.8);
benchmark passages are cut out; sources are mixed to their weights; what remains is written as coded token files
and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import decontaminate, language_id, mixing, near_dedup, token_output
from marquee.llm.common import Scratch
from marquee.llm.queries import tokenizer_path

LEAST_SCORE = 0.1


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.with_language(docs, LEAST_SCORE)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.without_copies(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.copies_of(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, written and read back."""
    return token_output.encoded_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", recognised),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_ids", encoded),
]

#: Learned profiles, MinHash classes and token files are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result but the last is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
