"""Corpus clean-up in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, decontam, neardup, passages, quality
from tessella.llm.common import scratch_path

STAGES = [
    ("quality_rules", quality.stage),
    ("near_duplicates", neardup.stage),
    ("repeated_passages", passages.stage),
    ("decontamination", decontam.stage),
    ("bpe_tokens", bpe.stage),
]

#: Sketches and alignments have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
