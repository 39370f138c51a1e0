"""The registered training-data queries and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import decontamination, language_id, line_dedup, mixing, ngram_join, quality_rules, secret_scan, suffix_dedup, token_counts, token_files
from assaykit.llm._common import shared_dir, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (doc_id, item_id) of documents that hold a benchmark item."""
    return decontamination.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, read back from them."""
    docs = table(spark, sf_dir, "documents")
    parts = token_files.write_token_files(docs, shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, parts)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix of all sources takes."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole document."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by base rules and Markov models."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that strings of 200 bytes repeat."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether base rules and certified thresholds keep it."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand in ten documents or more."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and its number of links."""
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_token_files": op3_token_files,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_secret_scan": op6_secret_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_join": op10_ngram_join,
}
ORACLES = {
    "op2_decontamination": decontamination.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
}
