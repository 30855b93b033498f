"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last returns its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanfuse.llm import bpe, decontaminate, exact_dedup, quality, simhash
from scanfuse.llm.common import staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text one stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return simhash.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token ids with their digests."""
    return bpe.round_trip(docs, bpe.public_path())


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("SimHash near-dedup", near_stage), ("benchmark decontamination", benchmark_stage), ("BPE encoding", encode_stage)]

ORACLE_SQL = None  # the fitted classifier, string tiling and BPE have no SQL form; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
