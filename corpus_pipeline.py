"""Corpus pipeline: quality rules, near copies, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import jaccard, mixing, packing, quality
from helixframe.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are robust outliers go."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id."""
    return jaccard.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the budgets of their domain, language and source use them."""
    return mixing.mix(docs)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's length bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("mix_sources", mix_sources), ("pack_lengths", pack_lengths)]

#: Robust estimates, components of a similarity graph and seeded hashes have no DuckDB form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
