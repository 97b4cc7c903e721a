"""Errors of predicted outcomes and effects, rank correlation, and dose-response scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running

EPS = 2.220446049250313e-16


def component_metric(df: DataFrame, kind: str, outcome: str = "y", treatment: str = "w", control_pred: str = "y_pred_ct", treated_pred: str = "y_pred_tr") -> DataFrame:
    """One row (control, treated, total) of the mean absolute (mae), squared (mse) or relative (mape) error.

    Each arm is judged by its own prediction; ``total`` weighs arms by their rows.
    """
    y, w = F.col(outcome).cast("double"), F.col(treatment)
    errors = {
        "mae": lambda p: F.abs(y - p),
        "mse": lambda p: (y - p) * (y - p),
        "mape": lambda p: F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPS)),
    }
    if kind not in errors:
        raise ValueError(f"unknown component metric {kind!r}")
    error = errors[kind]
    ct, tr = error(F.col(control_pred)), error(F.col(treated_pred))
    return df.agg(F.avg(F.when(w == 0, ct)).alias("control"), F.avg(F.when(w == 1, tr)).alias("treated"), F.avg(F.when(w == 1, tr).otherwise(ct)).alias("total"))


def uplift_component_mae(df: DataFrame, **columns: str) -> DataFrame:
    return component_metric(df, "mae", **columns)


def uplift_component_mse(df: DataFrame, **columns: str) -> DataFrame:
    return component_metric(df, "mse", **columns)


def uplift_component_mape(df: DataFrame, **columns: str) -> DataFrame:
    return component_metric(df, "mape", **columns)


def per_arm(df: DataFrame, *columns: str) -> DataFrame:
    """(arm, the columns): arrays exploded to a row per treated arm; plain columns are arm 1."""
    if not dict(df.dtypes)[columns[0]].startswith("array"):
        return df.withColumn("arm", F.lit(1))
    zipped = F.arrays_zip(*(F.col(c).alias(c) for c in columns))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.posexplode(zipped).alias("_at", "_z")).select(*rest, (F.col("_at") + 1).alias("arm"), *(F.col(f"_z.{c}").alias(c) for c in columns))


def pehe(df: DataFrame, true: str = "true_uplift", pred: str = "uplift") -> DataFrame:
    """(arm, pehe): root mean squared error of the effect."""
    return per_arm(df, true, pred).groupBy("arm").agg(F.sqrt(F.avg((F.col(pred) - F.col(true)) * (F.col(pred) - F.col(true)))).alias("pehe"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def kendall_uplift(df: DataFrame, true: str = "true_uplift", pred: str = "uplift", row_id: str = "row_id") -> DataFrame:
    """(arm, tau): Kendall's tau-b between true and predicted effects.

    Discordant pairs are inversions of the codes of ``pred`` in the order of ``true``.  At each bit of
    the codes, two rows with equal higher bits are inverted when a one comes before a zero, so one
    running count over (bit, higher bits) gives all inversions: n log n rows, no pair is made.
    """
    rows = per_arm(df, true, pred).select("arm", F.col(true).cast("double").alias("x"), F.col(pred).cast("double").alias("y"), F.col(row_id).alias("r"))
    codes = running(rows.groupBy("arm", "y").agg(F.count(F.lit(1)).alias("c")), [F.col("y").asc()], {"code": ("sum", F.lit(1).cast("long"))}, ("arm",))
    most = codes.agg(F.max("code")).first()[0] or 1
    bits = F.array(*(F.lit(b) for b in range(int(most).bit_length())))
    coded = rows.join(codes.select("arm", "y", "code"), ["arm", "y"]).withColumn("bit", F.explode(bits))
    coded = coded.withColumn("high", F.expr("shiftright(code, bit + 1)")).withColumn("one", F.expr("shiftright(code, bit) & 1"))
    counted = running(coded, [F.col("x").asc(), F.col("code").asc(), F.col("r").asc()], {"ones": ("sum", F.col("one"))}, ("arm", "bit", "high"))
    discordant = counted.where("one = 0").groupBy("arm").agg(F.sum("ones").alias("d"))
    n = rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n"))
    ties = [rows.groupBy("arm", *c).agg(F.count(F.lit(1)).alias("c")).groupBy("arm").agg(F.sum(_pairs(F.col("c"))).alias(name)) for name, c in (("tx", ["x"]), ("ty", ["y"]), ("txy", ["x", "y"]))]
    for t in (*ties, discordant):
        n = n.join(t, "arm", "left")
    all_pairs = _pairs(F.col("n"))
    d = F.coalesce(F.col("d"), F.lit(0)).cast("double")
    concordant = all_pairs - F.col("tx") - F.col("ty") + F.col("txy") - d
    return n.select("arm", F.try_divide(concordant - d, F.sqrt((all_pairs - F.col("tx")) * (all_pairs - F.col("ty")))).alias("tau"))


def arm_score_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """(mean, std) over arms; the deviation is the population's."""
    return scores.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def dose_response_mise(df: DataFrame, grid: list[float], true: str = "true_mu", pred: str = "mu") -> DataFrame:
    """(mise): mean over rows of the trapezoid integral of the squared error of dose-response arrays."""
    if len(grid) < 2:
        raise ValueError("the grid needs two doses or more")
    error = F.zip_with(pred, true, lambda a, b: (a - b) * (a - b))
    widths = F.array(*(F.lit(float(b) - float(a)) for a, b in zip(grid, grid[1:], strict=False)))
    n = len(grid)
    steps = F.zip_with(F.zip_with(F.slice("_e", 1, n - 1), F.slice("_e", 2, n - 1), lambda a, b: (a + b) / 2), widths, lambda m, w: m * w)
    return df.withColumn("_e", error).agg(F.avg(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)).alias("mise"))


def best_dose(df: DataFrame, grid: list[float], pred: str = "mu", out: str = "dose") -> DataFrame:
    """``df`` with the first dose of the largest predicted response."""
    doses = F.array(*(F.lit(float(g)) for g in grid))
    return df.withColumn(out, F.element_at(doses, F.array_position(pred, F.array_max(pred)).cast("int")))
