"""Off-policy evaluation: one aggregation for any set of estimators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESTIMATORS = ("ips", "snips", "dm", "dr", "switch_dr", "dr_os")


def _at(q: Column, action: Column) -> Column:
    return F.element_at(q, action.cast("int") + 1)


def estimate(name: str, reward: Column, action: Column, pscore: Column, policy: Column, q: Column | None = None, tau: float = 10.0, lambda_: float = 100.0) -> Column:
    """The aggregate that estimates the value of ``policy`` from logged actions.

    ``pscore``: propensity of the logged action, positive (else the query fails); ``q``: array of predicted rewards by arm.
    """
    safe = F.when(pscore > 0, pscore).otherwise(F.raise_error("propensities must be positive").cast("double"))
    w = F.when(action == policy, 1 / safe).otherwise(F.lit(0.0))
    if name == "ips":
        return F.avg(w * reward)
    if name == "snips":
        return F.coalesce(F.when(F.sum(w) != 0, F.try_divide(F.sum(w * reward), F.sum(w))), F.lit(0.0))
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known are {', '.join(ESTIMATORS)}")
    if q is None:
        raise ValueError(f"{name} needs predicted rewards")
    direct, residual = _at(q, policy), reward - _at(q, action)
    if name == "dm":
        return F.avg(direct)
    if name == "switch_dr":
        w = F.when(w <= tau, w).otherwise(F.lit(0.0))
    if name == "dr_os":
        if lambda_ < 0:
            raise ValueError("lambda_ must not be negative")
        w = w * lambda_ / (w * w + lambda_) if lambda_ > 0 else F.lit(0.0)
    return F.avg(direct + w * residual)


def evaluate(df: DataFrame, estimators: tuple[str, ...] = ESTIMATORS, reward: str = "y", action: str = "t", pscore: str = "p", policy: str = "pi", q: str | None = None, **options: float) -> DataFrame:
    """One row with a column per estimator, in one pass over ``df``."""
    args = (F.col(reward).cast("double"), F.col(action), F.col(pscore).cast("double"), F.col(policy))
    return df.agg(*(estimate(e, *args, F.col(q) if q else None, **options).alias(e) for e in estimators))


def ips(df: DataFrame, **columns) -> DataFrame:
    return evaluate(df, ("ips",), **columns)


def snips(df: DataFrame, **columns) -> DataFrame:
    return evaluate(df, ("snips",), **columns)


def direct_method(df: DataFrame, q: str = "q", **columns) -> DataFrame:
    return evaluate(df, ("dm",), q=q, **columns)


def doubly_robust(df: DataFrame, q: str = "q", **columns) -> DataFrame:
    return evaluate(df, ("dr",), q=q, **columns)


def switch_dr(df: DataFrame, q: str = "q", tau: float = 10.0, **columns) -> DataFrame:
    return evaluate(df, ("switch_dr",), q=q, tau=tau, **columns)


def dr_os(df: DataFrame, q: str = "q", lambda_: float = 100.0, **columns) -> DataFrame:
    return evaluate(df, ("dr_os",), q=q, lambda_=lambda_, **columns)


def evaluate_policy(df: DataFrame, uplift: str = "uplift", y0: str = "y0_pred", y1: str = "y1_pred", propensity: str = "e", estimator: str = "dr", threshold: float = 0.0, reward: str = "y", treatment: str = "t", **options: float) -> DataFrame:
    """(value): the policy that follows predicted uplift.

    One treated arm: ``uplift > threshold``, ``propensity`` is P(T = 1).  Several (array columns for ``uplift``
    and ``y1``): the best positive arm, ``propensity`` an array of P(T = a) for all arms.
    """
    t = F.col(treatment).cast("int")
    if dict(df.dtypes)[uplift].startswith("array"):
        u = F.col(uplift)
        best = F.array_max(u)
        policy = F.when(best > 0, F.array_position(u, best)).otherwise(0).cast("int")
        p = F.element_at(F.col(propensity), t + 1)
        q = F.concat(F.array(F.col(y0)), F.col(y1))
    else:
        policy = (F.col(uplift) > threshold).cast("int")
        p = F.when(t == 1, F.col(propensity)).otherwise(1 - F.col(propensity))
        q = F.array(F.col(y0), F.col(y1))
    value = estimate(estimator, F.col(reward).cast("double"), t, p, policy, q, **options)
    return df.agg(value.alias("value"))


def expected_response(df: DataFrame, reward: str = "y", recommended: str = "pi", observed: str = "t", propensity: str = "p") -> DataFrame:
    """(value): the self-normalised estimate for recommended against observed treatments."""
    return evaluate(df, ("snips",), reward=reward, action=observed, pscore=propensity, policy=recommended).select(F.col("snips").alias("value"))


def policy_value(df: DataFrame, assigned: str = "assigned", propensities: str = "gps", reward: str = "y", treatment: str = "t", clip: float = 1e-3) -> DataFrame:
    """(value): mean of the outcomes of rows treated as assigned over the clipped propensity of that arm."""
    p = F.least(F.greatest(F.element_at(F.col(propensities), F.col(assigned) + 1), F.lit(clip)), F.lit(1 - clip))
    return df.agg(F.avg(F.when(F.col(treatment) == F.col(assigned), F.col(reward) / p).otherwise(0.0)).alias("value"))
