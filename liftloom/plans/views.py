"""Causal tables over the test schema, as DataFrames and as the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers: five priority arms, 0 the lowest priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_mktsegment")
    key = F.col("o_orderkey")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        key.alias("row_id"),
        (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("t"),
        (F.col("c_acctbal") / 1e4).alias("x0"),
        ((key % 97).cast("double") / F.lit(97.0)).alias("x1"),
        (F.col("o_totalprice") / 1e5).alias("y"),
        F.col("c_mktsegment").alias("seg"),
        F.col("o_orderstatus").alias("status"),
        (key % 5).cast("int").alias("fold"),
    )


MULTI = """v_multi AS (SELECT o_orderkey AS row_id, CAST(5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS INT) AS t, c_acctbal / 1e4 AS x0,
    CAST(o_orderkey % 97 AS DOUBLE) / 97e0 AS x1, o_totalprice / 1e5 AS y, c_mktsegment AS seg, o_orderstatus AS status, CAST(o_orderkey % 5 AS INT) AS fold
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi(spark, sf_dir).where("t in (0, 1)")


BINARY = MULTI + ", v_bin AS (SELECT * FROM v_multi WHERE t IN (0, 1))"


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as times to an event; censored unless a purchase or an error."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("row_id"), F.col("value").alias("time"), F.col("event_type").isin("purchase", "error").cast("int").alias("event"), (F.col("user_id") % 2).cast("int").alias("t"), (F.col("user_id") % 7).cast("int").alias("g"))


SURVIVAL = "v_surv AS (SELECT event_id AS row_id, value AS time, CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS event, CAST(user_id % 2 AS INT) AS t, CAST(user_id % 7 AS INT) AS g FROM events)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: quality as the outcome, toxicity as the treatment."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "lang", "source")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("row_id"), F.col("toxic").cast("int").alias("t"), F.col("quality").cast("double").alias("y"), (F.col("n_chars") / 1e4).alias("x0"), "lang", "source")


LABELLED = "v_lab AS (SELECT labels.doc_id AS row_id, CAST(toxic AS INT) AS t, CAST(quality AS DOUBLE) AS y, n_chars / 1e4 AS x0, lang, source FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("row_id"), (F.col("label") % 2).cast("int").alias("t"), "embedding")
