"""Covariate balance, overlap and positivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Usual thresholds of balance.
SMD_MOST, RATIO_LEAST, RATIO_MOST = 0.1, 0.5, 2.0


def long_features(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """(keep, feature, x): one row per feature."""
    entries = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))
    return df.select(*keep, F.explode(entries).alias("_f")).select(*keep, "_f.feature", "_f.x")


def _moments(df: DataFrame, features: list[str], treatment: str, weight: str | None) -> DataFrame:
    """(feature, m1, v1, m0, v0, n1, n0): population moments by arm."""
    rows = long_features(df, features, treatment, *([weight] if weight else []))
    t, x = F.col(treatment), F.col("x")
    if weight is None:
        out = rows.groupBy("feature").agg(*(f(F.when(t == a, x)).alias(f"{name}{a}") for a in (1, 0) for name, f in (("m", F.avg), ("v", F.var_pop))), *(F.count_if(t == a).alias(f"n{a}") for a in (1, 0)))
    else:
        w = F.col(weight).cast("double")
        means = rows.groupBy("feature").agg(*(F.try_divide(F.sum(F.when(t == a, w * x)), F.sum(F.when(t == a, w))).alias(f"m{a}") for a in (1, 0)), *(F.count_if(t == a).alias(f"n{a}") for a in (1, 0)))
        # a second pass around the means; sums of squares would cancel
        centred = rows.join(F.broadcast(means), "feature").withColumn("_e", x - F.when(t == 1, F.col("m1")).otherwise(F.col("m0")))
        out = centred.groupBy("feature", "m1", "m0", "n1", "n0").agg(*(F.try_divide(F.sum(F.when(t == a, w * F.col("_e") * F.col("_e"))), F.sum(F.when(t == a, w))).alias(f"v{a}") for a in (1, 0)))
    return out


def _guarded(moments: DataFrame) -> DataFrame:
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    return moments.where(F.when(both, F.lit(True)).otherwise(F.raise_error("both arms are needed").cast("boolean")))


def _smd() -> Column:
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return F.when(pooled == 0, 0.0).otherwise(F.try_divide(F.col("m1") - F.col("m0"), pooled))


def standardized_mean_difference(df: DataFrame, features: list[str], treatment: str = "t", weight: str | None = None) -> DataFrame:
    """(feature, smd): difference of means over the root of the mean variance; 0 where that is 0."""
    return _guarded(_moments(df, features, treatment, weight)).select("feature", _smd().alias("smd"))


def covariate_balance(df: DataFrame, features: list[str], treatment: str = "t", weight: str | None = None) -> DataFrame:
    """(feature, mean_treated, mean_control, smd)."""
    return _guarded(_moments(df, features, treatment, weight)).select("feature", F.col("m1").alias("mean_treated"), F.col("m0").alias("mean_control"), _smd().alias("smd"))


def _ratio() -> Column:
    v1, v0 = F.col("v1"), F.col("v0")
    return F.when((v0 == 0) & (v1 == 0), 1.0).when(v0 == 0, F.lit(float("inf"))).otherwise(F.try_divide(v1, v0))


def variance_ratio(df: DataFrame, features: list[str], treatment: str = "t") -> DataFrame:
    """(feature, variance_ratio): treated over control; infinite over 0, and 1 where both are 0."""
    return _guarded(_moments(df, features, treatment, None)).select("feature", _ratio().alias("variance_ratio"))


def match_rate(original: DataFrame, matched: DataFrame, treatment: str = "t") -> DataFrame:
    """(match_rate): treated rows that were matched, as a share of all treated rows."""
    a = original.agg(F.count_if(F.col(treatment) == 1).alias("_n"))
    b = matched.agg(F.count_if(F.col(treatment) == 1).alias("_m"))
    return a.crossJoin(b).select(F.when(F.col("_n") == 0, F.raise_error("no treated rows").cast("double")).otherwise(F.try_divide(F.col("_m").cast("double"), F.col("_n").cast("double"))).alias("match_rate"))


def positivity_check(df: DataFrame, propensity: str = "e", treatment: str | None = None, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: share outside [low, high], least and largest propensity, overlap; with a treatment also the arms' extremes."""
    e = F.col(propensity).cast("double")
    outside = (e < low) | (e > high)
    cols = [F.avg(outside.cast("double")).alias("share_outside"), F.min(e).alias("min_propensity"), F.max(e).alias("max_propensity"), (F.count_if(outside) < F.count(F.lit(1))).alias("has_overlap")]
    if treatment:
        t = F.col(treatment)
        cols += [F.min(F.when(t == 1, e)).alias("min_treated"), F.max(F.when(t == 0, e)).alias("max_control")]
    return df.agg(*cols)


def overlap_report(df: DataFrame, features: list[str], treatment: str = "t") -> DataFrame:
    """(feature, smd, variance_ratio, smd_ok, variance_ratio_ok)."""
    out = _guarded(_moments(df, features, treatment, None)).select("feature", _smd().alias("smd"), _ratio().alias("variance_ratio"))
    return out.withColumn("smd_ok", F.abs("smd") <= SMD_MOST).withColumn("variance_ratio_ok", F.col("variance_ratio").between(RATIO_LEAST, RATIO_MOST))


def overlap_summary(df: DataFrame, features: list[str], treatment: str = "t") -> DataFrame:
    """One row: balanced, max_abs_smd."""
    return overlap_report(df, features, treatment).agg(F.bool_and(F.col("smd_ok") & F.col("variance_ratio_ok")).alias("balanced"), F.max(F.abs("smd")).alias("max_abs_smd"))
