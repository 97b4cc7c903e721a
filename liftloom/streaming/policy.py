"""Streams of decisions: scoring with fitted models and rolling policy values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_stream(stream: DataFrame, model) -> DataFrame:
    """A stream with a fitted model's predictions; scoring is a projection, so it needs no state."""
    return model.predict(stream)


def _sums(reward: str, action: str, pscore: str, policy: str) -> list[Column]:
    w = F.when(F.col(action) == F.col(policy), 1 / F.col(pscore)).otherwise(F.lit(0.0))
    return [F.sum(w * F.col(reward)).alias("_wr"), F.sum(w).alias("_w"), F.count(F.lit(1)).alias("n")]


def rolling_policy_value(df: DataFrame, ts: str = "ts", window: str = "1 day", slide: str | None = None, late: str = "1 day", reward: str = "y", action: str = "t", pscore: str = "p", policy: str = "pi") -> DataFrame:
    """(start, end, n, ips, snips) per time window, of a stream (late rows up to ``late`` count) or a table."""
    rows = df
    if df.isStreaming:  # a watermark needs a timestamp with a time zone
        rows = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    over = F.window(ts, window, slide) if slide else F.window(ts, window)
    found = rows.groupBy(over.alias("_w_")).agg(*_sums(reward, action, pscore, policy))
    snips = F.coalesce(F.try_divide(F.col("_wr"), F.when(F.col("_w") != 0, F.col("_w"))), F.lit(0.0))
    return found.select(F.col("_w_.start").alias("start"), F.col("_w_.end").alias("end"), "n", (F.col("_wr") / F.col("n")).alias("ips"), snips.alias("snips"))
