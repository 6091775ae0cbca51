"""Queries of the training-data operators, by name, and their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, merkle, multiindex, neardup, ngram, pages, passages, quality, sharding, toxicity, urls, whiten


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_near_duplicates": neardup.op2_near_duplicates,
        "op3_sharding": sharding.op3_sharding,
        "op4_repeated_passages": passages.op4_repeated_passages,
        "op5_bpe": bpe.op5_bpe,
        "op6_decontamination": decontam.op6_decontamination,
        "op7_html_text": pages.op7_html_text,
        "op8_url_filter": urls.op8_url_filter,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_lm_score": ngram.op10_lm_score,
        "op11_embedding_duplicates": multiindex.op11_embedding_duplicates,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_embedding_whitening": whiten.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_duplicates": neardup.ORACLE_OP2,
        "op6_decontamination": decontam.ORACLE_OP6,
        "op9_quality_rules": quality.oracle_op9(),
        "op11_embedding_duplicates": multiindex.ORACLE_OP11,
        "op12_merkle_manifest": merkle.ORACLE_OP12,
    }
