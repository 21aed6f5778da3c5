"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, jaccard, lmscore, pii, quality, secrets, toxicity, wavelet
from .common import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents labelled as of good quality and not toxic."""
    target = read_table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return lmscore.lm_scores(read_table(spark, sf_dir, "documents"), target)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read_table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(read_table(spark, sf_dir, "documents"))


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.wavelet(read_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_chat": chat.op2_chat,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_secrets": op4_secrets,
        "op5_jaccard": op5_jaccard,
        "op6_decontamination": op6_decontamination,
        "op7_toxicity": op7_toxicity,
        "op8_pii": op8_pii,
        "op9_wavelet": op9_wavelet,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality.ORACLE_SQL, "op2_chat": chat.ORACLE_SQL, "op5_jaccard": jaccard.ORACLE_SQL, "op6_decontamination": decontam.ORACLE_SQL}
