"""The corpus pipeline: stages that each take and return documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skarn.llm import exact, neardup, packing, quality, substring
from skarn.llm.scratch import Scratch, released


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither their own rules nor their host's verdict rejects."""
    return quality.keep(spark, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.keep(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % or more of its five-word shingles."""
    return neardup.keep(spark, docs, k=5, part=80, whole=100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that a document with a smaller id has too."""
    return substring.clean(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack(spark, docs, packing.default_tokenizer())


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("minhash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with released():  # a stage's own tables go as soon as its result is written
            docs = scratch.cut(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
