"""Corpus pipeline: from raw documents to token counts.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm import decontaminate, near_duplicates, quality, sentencepiece_bpe, substring_dedup
from upkeep.llm.storage import default_small_batches, written

PASSAGE_WORDS = 40
SHINGLE_WORDS = 5
BENCHMARK_WORDS = 10


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted to the labels."""
    default_small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_documents(docs, quality.train(docs, quality.grades_of(labels)))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates
    (five-word shingles, similarity 0.8 or more)."""
    default_small_batches(spark)
    return near_duplicates.deduplicated(docs, size=SHINGLE_WORDS, percent=80)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``PASSAGE_WORDS`` or more words that a document
    of a smaller id has; n_chars follows the text."""
    default_small_batches(spark)
    found = substring_dedup.without_repeats(docs, length=PASSAGE_WORDS)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window of ``BENCHMARK_WORDS`` words."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=BENCHMARK_WORDS)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    default_small_batches(spark)
    return sentencepiece_bpe.encode_documents(docs, str(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("substrings", unrepeated),
    ("decontamination", uncontaminated),
    ("sentencepiece", tokenized),
]

# The classifier's decisions come from a fitted model, so SQL cannot give the rows;
# tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return functools.reduce(lambda d, stage: written(stage[1](spark, d, sf_dir), stage[0]), STAGES, docs)
