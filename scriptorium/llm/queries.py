"""The queries of the ten operators over the whole tables, with production parameters, and their oracles."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, hpylm, jaccard, langid, mixing, packing, pii, quality, tokencount, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where this installation keeps the public tokenizers; operators take a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def pii_key() -> bytes:
    """The key of the surrogates: SCRIPTORIUM_PII_KEY where it is set; the default is for tests and public data."""
    return os.environ.get("SCRIPTORIUM_PII_KEY", "public test key").encode()


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(_table(spark, sf_dir, "documents"), pii_key())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict:
    ops = (op1_mix, op2_pack, op3_jaccard_join, op4_language_id, op5_fingerprints, op6_lm_scores, op7_quality_rules, op8_pii_surrogates, op9_warc, op10_token_counts)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {}
