"""Gain, Qini and cost curves, their areas, and lift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import against_control, arms_of, check_binary, descending
from .running import running


def _curve_value(kind: str) -> Column:
    nt, nc, yt, yc, k = (F.col(c).cast("double") for c in ("_nt", "_nc", "_yt", "_yc", "k"))
    if kind == "gain":
        return (F.when(nt > 0, yt / nt).otherwise(0.0) - F.when(nc > 0, yc / nc).otherwise(0.0)) * k
    if kind == "qini":
        return yt - yc * F.when(nc > 0, nt / nc).otherwise(0.0)
    raise ValueError(f"unknown curve {kind!r}")


def paired(df: DataFrame, uplift: str = "uplift", treatment: str = "t", arms: list[int] | None = None) -> DataFrame:
    """Rows per (arm, row) with ``w`` and the arm's score ``u``.

    ``uplift`` is a double column (one treated arm) or an array with a score per treated arm.
    """
    several = dict(df.dtypes)[uplift].startswith("array")
    if not several:
        check_binary(df, treatment)
        return df.withColumn("arm", F.lit(1)).withColumn("w", F.col(treatment).cast("int")).withColumn("u", F.col(uplift).cast("double"))
    arms = arms or arms_of(df, treatment)
    if arms != list(range(len(arms))):
        raise ValueError("arms must be 0..K-1")
    return against_control(df, arms, treatment).withColumn("u", F.element_at(F.col(uplift), F.col("arm")).cast("double"))


def curve_points(pairs: DataFrame, kind: str, outcome: str = "y", row_id: str = "row_id", by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """(by, k, value) for k = 1..n of the pairs in descending order of ``u``, ties by ``row_id``."""
    w, y = F.col("w"), F.col(outcome).cast("double")
    sums = {
        "k": ("sum", F.lit(1).cast("long")),
        "_nt": ("sum", w.cast("long")),
        "_nc": ("sum", (1 - w).cast("long")),
        "_yt": ("sum", w * y),
        "_yc": ("sum", (1 - w) * y),
    }
    out = running(pairs, [*descending("u"), F.col(row_id).asc()], sums, by)
    return out.withColumn("value", _curve_value(kind))


def curve(df: DataFrame, kind: str = "gain", uplift: str = "uplift", outcome: str = "y", treatment: str = "t", row_id: str = "row_id") -> DataFrame:
    """(arm, k, value): the cumulative gain or Qini curve of each treated arm from k = 0."""
    points = curve_points(paired(df, uplift, treatment), kind, outcome, row_id).select("arm", "k", "value")
    start = points.select("arm").distinct().select("arm", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("value"))
    return points.unionByName(start)


def cumulative_gain_curve(df: DataFrame, **columns: str) -> DataFrame:
    return curve(df, "gain", **columns)


def qini_curve(df: DataFrame, **columns: str) -> DataFrame:
    return curve(df, "qini", **columns)


def area(points: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """(by, auc): the trapezoid area of curves that start at 0."""
    return points.groupBy(*by).agg((F.sum("value") - F.lit(0.5) * F.max_by("value", "k")).alias("auc"))


def uplift_score(df: DataFrame, kind: str = "gain", uplift: str = "uplift", outcome: str = "y", treatment: str = "t", row_id: str = "row_id", normalize: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, arm, score): the area under the curve, by default over that of the order of ``y w - y (1 - w)``.

    A best area of 0 gives 0.  The model's and the best order are accumulated in one pass.
    """
    y = F.col(outcome).cast("double")
    pairs = paired(df, uplift, treatment)
    orders = [F.struct(F.lit(0).alias("best"), F.col("u"))]
    if normalize:
        orders.append(F.struct(F.lit(1).alias("best"), F.when(F.col("w") == 1, y).otherwise(-y).alias("u")))
    pairs = pairs.withColumn("_order", F.explode(F.array(*orders))).withColumn("u", F.col("_order.u")).withColumn("_best", F.col("_order.best")).drop("_order")
    keys = (*by, "arm", "_best")
    areas = area(curve_points(pairs, kind, outcome, row_id, keys), keys)
    if not normalize:
        return areas.select(*by, "arm", F.col("auc").alias("score"))
    found = areas.groupBy(*by, "arm").agg(F.max(F.when(F.col("_best") == 0, F.col("auc"))).alias("_model"), F.max(F.when(F.col("_best") == 1, F.col("auc"))).alias("_ideal"))
    return found.select(*by, "arm", F.when(F.col("_ideal") == 0, 0.0).otherwise(F.try_divide("_model", "_ideal")).alias("score"))


def auuc_score(df: DataFrame, **options) -> DataFrame:
    return uplift_score(df, "gain", **options)


def qini_score(df: DataFrame, **options) -> DataFrame:
    return uplift_score(df, "qini", **options)


def lift_at_k(df: DataFrame, k: float = 0.3, uplift: str = "uplift", outcome: str = "y", treatment: str = "t", row_id: str = "row_id") -> DataFrame:
    """(arm, lift): the gain at ``round(k n)`` (half to even), 0 at 0."""
    if not 0 < k <= 1:
        raise ValueError("k must be in (0, 1]")
    pairs = paired(df, uplift, treatment)
    points = curve_points(pairs, "gain", outcome, row_id)
    sizes = points.groupBy("arm").agg(F.max("k").alias("n"), F.lit(0).alias("_")).withColumn("at", F.bround(F.col("n") * F.lit(k), 0).cast("long"))
    found = points.join(sizes, "arm").where(F.col("k") == F.col("at")).select("arm", F.col("value").alias("lift"))
    return sizes.select("arm").join(found, "arm", "left").select("arm", F.coalesce("lift", F.lit(0.0)).alias("lift"))


def cost_based_targeting_curve(df: DataFrame, uplift: str = "uplift", costs: list[float] | float = 0.0, row_id: str = "row_id") -> DataFrame:
    """(k, value): running sum of each row's best net uplift, best first, from k = 0; negative nets count."""
    points = running(df.withColumn("u", best_net(df, uplift, costs)), [*descending("u"), F.col(row_id).asc()], {"k": ("sum", F.lit(1).cast("long")), "value": ("sum", F.col("u"))})
    start = df.sparkSession.createDataFrame([(0, 0.0)], "k long, value double")
    return points.select("k", "value").unionByName(start)


def net_uplift(df: DataFrame, uplift: str, costs: list[float] | float) -> Column:
    """Array of scores less costs, one entry per treated arm."""
    u = F.col(uplift)
    if not dict(df.dtypes)[uplift].startswith("array"):
        u = F.array(u.cast("double"))
    if isinstance(costs, (int, float)):
        return F.transform(u, lambda x: x - F.lit(float(costs)))
    return F.zip_with(u, F.array(*(F.lit(float(c)) for c in costs)), lambda a, b: a - b)


def best_net(df: DataFrame, uplift: str, costs: list[float] | float) -> Column:
    return F.array_max(net_uplift(df, uplift, costs))


def optimal_treatment_assignment(df: DataFrame, uplift: str = "uplift", costs: list[float] | float = 0.0, out: str = "assigned") -> DataFrame:
    """``df`` with the arm of the first largest net uplift, or 0 where that is not positive."""
    net = net_uplift(df, uplift, costs)
    best = F.array_max(net)
    return df.withColumn(out, F.when(best > 0, F.array_position(net, best)).otherwise(0).cast("int"))


def top_mask(df: DataFrame, score: str, k: int, row_id: str = "row_id", out: str = "chosen") -> DataFrame:
    """``df`` with 1 for the ``k`` largest scores; of equal scores the larger row ids come first."""
    if k <= 0:
        return df.withColumn(out, F.lit(0))
    ranked = running(df, [F.col(score).desc_nulls_last(), F.col(row_id).desc()], {"_rank": ("sum", F.lit(1))})
    return ranked.withColumn(out, (F.col("_rank") <= k).cast("int")).drop("_rank")


def budget_size(n: int, budget: float | None = None, top_k: int | None = None) -> int:
    """Number of rows to treat: ``round(budget n)`` (half to even) or ``top_k``."""
    if (budget is None) == (top_k is None):
        raise ValueError("give one of budget and top_k")
    if budget is not None:
        if not 0 < budget <= 1:
            raise ValueError("budget must be in (0, 1]")
        return round(budget * n)
    if not 0 <= top_k <= n:
        raise ValueError("top_k must be between 0 and the number of rows")
    return top_k
