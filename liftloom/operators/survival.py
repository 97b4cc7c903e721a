"""Censoring survival and inverse-probability-of-censoring outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running


def censoring_table(df: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """(time, at_risk, censored) per distinct time; ``at_risk`` counts rows with at least that time."""
    counts = df.groupBy(F.col(time).cast("double").alias("time")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(event) == 0).alias("censored"))
    return running(counts, [F.col("time").desc()], {"at_risk": ("sum", F.col("n"))}).select("time", "at_risk", "censored")


def km_censoring(df: DataFrame, horizon: float, time: str = "time", event: str = "event") -> DataFrame:
    """(g): Kaplan-Meier probability of not being censored up to the horizon; 1 without censoring."""
    left = (F.col("at_risk") - F.col("censored")).cast("double") / F.col("at_risk")
    factors = censoring_table(df, time, event).where((F.col("time") <= horizon) & (F.col("censored") > 0)).withColumn("f", left)
    return factors.agg(F.when(F.count_if(F.col("f") == 0) > 0, 0.0).otherwise(F.coalesce(F.exp(F.sum(F.when(F.col("f") > 0, F.ln("f")))), F.lit(1.0))).alias("g"))


def ipcw_survival_pseudo_outcome(df: DataFrame, horizon: float, time: str = "time", event: str = "event", censoring_clip: float = 1e-3, out: str = "y") -> DataFrame:
    """``df`` with the outcome ``time > horizon`` over the clipped censoring survival at the horizon."""
    g = F.broadcast(km_censoring(df, horizon, time, event).withColumnRenamed("g", "_censoring"))  # one row
    weighted = F.when(F.col(time) > horizon, F.lit(1.0)).otherwise(0.0) / F.greatest(F.col("_censoring"), F.lit(censoring_clip))
    return df.crossJoin(g).withColumn(out, weighted).drop("_censoring")
