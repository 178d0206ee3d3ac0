"""Corpus preparation: quality, near duplicates, decontamination, mixing, token shards, each on what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latentlake.llm import decontam, jaccard, mixing, quality, tokens
from latentlake.llm.common import narrow_batches, read, scratch_path, settle, ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality that are not toxic (operator 4)."""
    ship(spark)
    with narrow_batches(spark):
        return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more (operator 9)."""
    ship(spark)
    with narrow_batches(spark):
        return jaccard.keep_one(docs, k=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item (operator 10)."""
    ship(spark)
    with narrow_batches(spark):
        return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (operator 2)."""
    ship(spark)
    with narrow_batches(spark):
        return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; one row per sequence (operator 8)."""
    ship(spark)
    with narrow_batches(spark):
        return tokens.ordered_sequences(docs, tokens.shared_uri(scratch_path(spark, "shards")))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token-ID output", token_stage),
]

#: Trained weights, alignments and permutations are outside SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
