"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_trie,
    decontaminate,
    instruction_packing,
    language_id,
    mixing,
    near_dedup,
    phrases,
    quality_rules,
    sharding,
    token_counts,
    token_output,
    toxicity,
    url_filter,
)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every document, with the entries and scores of the 32k vocabulary."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return sharding.sharded(read(spark, sf_dir, "documents"), 40)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles."""
    return language_id.identified(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with source weights 3, 1, 2 takes from every document."""
    return mixing.mixed(read(spark, sf_dir, "documents")).drop("text_hash")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, learned from the labels. These are 0 and 1; grade 2 is made of the toxic
    documents of the sample with more than the median number of cues (see toxicity)."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.severities(read(spark, sf_dir, "documents"), labels)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.judged(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "learned_verdict")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether its language and source let it pass."""
    return quality_rules.judged(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as coded blocks and read back."""
    return token_output.encoded_documents(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose three-word shingles agree to 85 %."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of each language, counted over all documents."""
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into training sequences of at most 1024 tokens."""
    pieces = instruction_packing.packed_documents(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("total").alias("doc_tokens"), "sequence_id", "offset")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of conversations with common heads."""
    return conversation_trie.rebuilt_trie(read(spark, sf_dir, "conversations"))


QUERIES = {q.__name__: q for q in (
    op1_token_counts, op2_sharding, op3_language_id, op4_mixing, op5_toxicity, op6_url_filter, op7_decontamination,
    op8_quality_rules, op9_token_ids, op10_near_dedup, op11_phrases, op12_packing, op13_conversation_trie)}
ORACLES: dict[str, str] = {}
