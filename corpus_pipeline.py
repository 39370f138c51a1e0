"""A training corpus from raw documents: five operators in turn.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import decontamination, language_id, mixing, ngram_join, token_files
from assaykit.llm._common import discard, materialize, placed, release, shared_dir, table

#: Score below which a document's language counts as unknown: half the way from random letters to known words.
LEAST_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: neither ``und`` nor below LEAST_SCORE. Null and empty texts, and texts without a
    letter, go; repeated rows and long texts are judged each, whole."""
    return language_id.keep_identified(docs, language_id.train(docs), LEAST_SCORE)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar ones, the least doc_id. Null texts all stay; of rows that agree in id
    and text one stays."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null, empty and short texts hold none and stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, in the order of its schedule. Null and empty texts have no
    words and are not taken; a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, in the order of the mix; their place in them, read back. Null and empty texts have the
    end id alone."""
    order = ("_metadata.file_name", "_metadata.row_index")
    parts = token_files.write_token_files(placed(docs), shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"), end_id=2, order=order)
    return token_files.read_token_files(spark, parts)


STAGES = [
    ("language_id", identified),
    ("ngram_join", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
        release(spark)
    return docs


#: Language models and a tokenizer's merges are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None
