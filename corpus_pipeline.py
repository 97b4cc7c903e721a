"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the
columns of ``documents``, also further ones that the input has, under any names (the last one returns the encoded
documents).  Hard rows: a null or blank text and one without letters goes in the first stage.  Of equal texts the row with the largest
id stays, of similar ones that with the least; rows are told apart by id and text, so rows that repeat an id with
other texts are documents of their own, and of rows repeating both one stays.  A row without an id takes part in
the comparison of equal texts only.  A null source is a source.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liftloom.llm import bpe, common, exact_dedup, jaccard_join, language_id, mixing, queries

# The product of two coin flips is 0.25; of the documents of sf0.1 one in 1,000, of a single word or two, scores less than 0.41.
LEAST_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a recognised language: those with letters and a score of at least ``LEAST_SCORE``."""
    common.small_batches(spark)
    return language_id.accepted(docs, language_id.fit_language_model(docs), LEAST_SCORE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    common.small_batches(spark)
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    common.small_batches(spark)
    return jaccard_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that all sources weigh the same, at the same expected number of rows; shuffled."""
    return mixing.poisson_mixing(docs).select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with their digests, and its ``lang`` and ``source`` where the input has them."""
    common.small_batches(spark)
    keep = tuple(name for name in ("lang", "source") if name in docs.columns)
    return bpe.bpe_codes(docs, queries.vocabulary_path(), full=True, keep=keep).drop("decoded")


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encode_stage),
]

# Language ID, near-duplicate pivots and BPE are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn.  Each stage's result is written once, as Parquet in the shared folder, and read again by the next, whose
    steps each read their input; it is deleted when the next stage's is there, so at most two are held."""
    docs, before = queries.documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = common.scratch(spark, f"pipeline{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                common.remove(spark, before)
            before = path
    return docs
