"""Registered queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

VOCABULARY = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents, in a session that hands few of its long rows at a time to Python."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(documents(spark, sf_dir))


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest_neighbours

    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_codes

    return bpe_codes(documents(spark, sf_dir), vocabulary_path())


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    return secret_scan(documents(spark, sf_dir))


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import poisson_mixing

    return poisson_mixing(documents(spark, sf_dir))


def queries() -> dict:
    found = (op1_license_scan, op2_exact_dedup, op3_jaccard_join, op4_backoff_lm, op5_language_id, op6_suffix_dedup, op7_hilbert_neighbours, op8_bpe, op9_secret_scan, op10_poisson_mixing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {
        "op2_exact_dedup": oracles.EXACT_DEDUP,
        "op3_jaccard_join": oracles.JACCARD_JOIN,
        "op6_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op9_secret_scan": oracles.SECRET_SCAN,
        "op10_poisson_mixing": oracles.POISSON_MIXING,
    }
