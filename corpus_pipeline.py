"""Five stages from raw documents to packed token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import decontam, mixing, neardup, quality, tokenfile
from emberlog.llm.registry import tokenizer_path
from emberlog.llm.scratch import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.cascade(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.deduplicate(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix of sources takes it."""
    return mixing.mixture(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shard files, and per document its place in them."""
    return tokenfile.token_index(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", dedup_stage),
    ("benchmark decontamination", decontam_stage),
    ("source mix", mix_stage),
    ("token ids", token_stage),
]

#: Near copies, alignment and tokenizing are beyond SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage", release=True)
    return docs
