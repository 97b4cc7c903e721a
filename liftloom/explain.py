"""Importance of features: permutation, trees' own, and sampled Shapley values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import CausalFrame
from .operators.curves import uplift_score
from .operators.running import running
from .plans.lineage import cut


def shuffled(df: DataFrame, column: str, row_id: str, seed: int) -> DataFrame:
    """``df`` with the values of one column permuted: the i-th row by id gets the i-th value by a hash."""
    one = {"_n": ("sum", F.lit(1).cast("long"))}
    ids = running(df.select(row_id), [F.col(row_id).asc()], one)
    values = running(df.select(F.col(row_id).alias("_r"), F.col(column).alias("_v")), [F.xxhash64("_r", F.lit(seed), F.lit(column)).asc(), F.col("_r").asc()], one).select("_n", "_v")
    return df.drop(column).join(ids.join(values, "_n").select(row_id, F.col("_v").alias(column)), row_id)


def permutation_importance(model, frame: CausalFrame, metric: str = "auuc", n_repeats: int = 5, seed: int = 0) -> DataFrame:
    """(feature, importance_mean, importance_std): loss of score when a feature is permuted, largest first.  One treated arm."""
    if frame.arms() != [0, 1]:
        raise ValueError("permutation importance takes one treated arm")
    if metric not in ("auuc", "qini"):
        raise ValueError(f"unknown metric {metric!r}")
    kind = "gain" if metric == "auuc" else "qini"
    columns = {"outcome": frame.outcome, "treatment": frame.treatment, "row_id": frame.row_id}
    keep = [frame.row_id, frame.treatment, frame.outcome, "uplift"]
    parts = model.predict(frame.df).select(*keep, F.lit("").alias("feature"), F.lit(0).alias("repeat"))
    for f in frame.features:
        for r in range(n_repeats):
            one = model.predict(shuffled(frame.df, f, frame.row_id, seed * 1000 + r))
            parts = parts.unionByName(one.select(*keep, F.lit(f).alias("feature"), F.lit(r).alias("repeat")))
    scores = cut(uplift_score(cut(parts), kind, by=("feature", "repeat"), **columns))
    base = scores.where("feature = ''").first().score
    drops = scores.where("feature <> ''").withColumn("drop", F.lit(base) - F.col("score"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")).orderBy(F.desc("importance_mean"), "feature")


def tree_feature_importance(model) -> dict[str, float]:
    """Mean importance over a forest's trees, largest first."""
    if not hasattr(model, "importance"):
        raise AttributeError("the model has no trees")
    return model.importance()


def uplift_shap_values(model, df: DataFrame, features: list[str], row_id: str = "row_id", n_samples: int = 8, seed: int = 0) -> DataFrame:
    """(row_id, shap array, base): Shapley values of the uplift by sampled orders of the features against the features' means.

    Each sampled order replaces means by the row's values one feature at a time; all steps are scored in one pass.
    """
    import random

    rng = random.Random(seed)
    orders = []
    for _ in range(n_samples):
        order = list(range(len(features)))
        rng.shuffle(order)
        orders += [order, order[::-1]]
    means = df.agg(*(F.avg(f).alias(f) for f in features)).first()
    steps = []
    for o, order in enumerate(orders):
        known: set[int] = set()
        for at, add in enumerate([None, *order]):
            known = known if add is None else known | {add}
            values = [F.col(f).cast("double") if i in known else F.lit(float(means[f])) for i, f in enumerate(features)]
            steps.append(F.struct(F.lit(o).alias("o"), F.lit(at).alias("at"), F.lit(-1 if add is None else add).alias("f"), *(v.alias(n) for v, n in zip(values, features, strict=True))))
    rows = df.select(row_id, F.explode(F.array(*steps)).alias("_s")).select(row_id, "_s.*")
    scored = model.predict(rows).select(row_id, "o", "at", "f", "uplift")
    per = scored.groupBy(row_id, "o").agg(F.sort_array(F.collect_list(F.struct("at", "f", "uplift"))).alias("s"))
    gains = F.zip_with(F.slice("s", 2, len(features)), F.slice("s", 1, len(features)), lambda a, b: F.struct(a["f"].alias("f"), (a["uplift"] - b["uplift"]).alias("g")))
    long = per.select(row_id, F.element_at("s", 1)["uplift"].alias("base"), F.explode(gains).alias("g")).select(row_id, "base", "g.*")
    mean = long.groupBy(row_id, "f").agg(F.avg("g").alias("g"), F.avg("base").alias("base"))
    return mean.groupBy(row_id).agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "g"))), lambda x: x["g"]).alias("shap"), F.avg("base").alias("base"))
