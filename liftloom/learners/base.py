"""Base learners and propensity models, with out-of-fold prediction.

``fit`` gives an object whose ``predict`` adds a column; ``crossfit`` adds predictions made without the
row's own fold.  The closed-form learners get all folds from one aggregation (total less
own fold); the others are fitted fold by fold.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.causal import clip


def hash_fold(df: DataFrame, row_id: str, folds: int, seed: int = 0, out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(folds)).cast("int"))


def fold_numbers(df: DataFrame, fold: str) -> list[int]:
    return sorted(r[0] for r in df.select(fold).distinct().collect())


class Base:
    """Predicts a label from feature columns."""

    def fit(self, df: DataFrame, features: list[str], label: str, weight: str | None = None):
        raise NotImplementedError

    def crossfit(self, df: DataFrame, features: list[str], label: str, fold: str, out: str, train: Column | None = None, weight: str | None = None) -> DataFrame:
        """``df`` with predictions from models trained on rows of other folds that meet ``train``."""
        train = F.lit(True) if train is None else train
        parts = None
        for f in fold_numbers(df, fold):
            part = self.fit(df.where((F.col(fold) != f) & train), features, label, weight).predict(df.where(F.col(fold) == f), out)
            parts = part if parts is None else parts.unionByName(part)
        return parts


@dataclass
class Linear:
    """A fitted linear function of columns."""

    features: list[str]
    coefficients: list[float]
    intercept: float

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, sum((F.col(c).cast("double") * F.lit(float(b)) for c, b in zip(self.features, self.coefficients, strict=True)), F.lit(float(self.intercept))))


@dataclass
class OLS(Base):
    """Least squares with an optional ridge penalty (not on the intercept), solved from one aggregation of cross products."""

    ridge: float = 0.0
    features: tuple[str, ...] | None = None

    def _columns(self, features: list[str]) -> list[str]:
        return list(self.features or features)

    def _sums(self, names: list[str], label: str, weight: str | None) -> list[Column]:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        z = [F.lit(1.0), *(F.col(c).cast("double") for c in names), F.col(label).cast("double")]
        return [F.sum(w * z[i] * z[j]).alias(f"s{i}_{j}") for i in range(len(z)) for j in range(i, len(z)) if (i, j) != (len(z) - 1, len(z) - 1)]

    def _solve(self, names: list[str], value) -> Linear:
        p = len(names) + 1
        a = np.array([[value(min(i, j), max(i, j)) or 0.0 for j in range(p)] for i in range(p)], float)
        b = np.array([value(i, p) or 0.0 for i in range(p)], float)
        # centred, which keeps digits when means are large
        n = a[0, 0] or 1.0
        mean, mean_y = a[0, 1:] / n, b[0] / n
        cov = a[1:, 1:] - n * np.outer(mean, mean) + self.ridge * np.eye(p - 1)
        cross = b[1:] - n * mean * mean_y
        beta = np.linalg.lstsq(cov, cross, rcond=None)[0] if p > 1 else np.zeros(0)
        return Linear(names, beta.tolist(), float(mean_y - mean @ beta))

    def fit(self, df, features, label, weight=None):
        names = self._columns(features)
        row = df.agg(*self._sums(names, label, weight)).first().asDict()
        return self._solve(names, lambda i, j: row[f"s{i}_{j}"])

    def crossfit(self, df, features, label, fold, out, train=None, weight=None):
        names = self._columns(features)
        rows = (df if train is None else df.where(train)).groupBy(fold).agg(*self._sums(names, label, weight)).collect()
        rows = {r[fold]: r.asDict() for r in rows}
        total = {k: sum((r[k] or 0.0) for r in rows.values()) for k in next(iter(rows.values())) if k != fold}
        models = {f: self._solve(names, lambda i, j, f=f: total[f"s{i}_{j}"] - ((rows[f][f"s{i}_{j}"] or 0.0) if f in rows else 0.0)) for f in fold_numbers(df, fold)}
        value = F.lit(None).cast("double")
        for f, m in models.items():
            line = sum((F.col(c).cast("double") * F.lit(b) for c, b in zip(m.features, m.coefficients, strict=True)), F.lit(m.intercept))
            value = F.when(F.col(fold) == f, line).otherwise(value)
        return df.withColumn(out, value)


def RidgeBase(penalty: float = 1.0) -> OLS:
    return OLS(ridge=penalty)


@dataclass
class Strata:
    """A fitted table of means by strata, with the overall mean for unseen ones."""

    table: DataFrame
    keys: list[str]
    overall: float

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        named = self.table.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)), F.col("mean").alias("_mean"))
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        return df.join(named, on, "left").withColumn(out, F.coalesce("_mean", F.lit(self.overall))).drop("_mean", *(f"_k{i}" for i in range(len(self.keys))))


@dataclass
class StrataMean(Base):
    """The weighted mean of the label in strata of key columns."""

    keys: tuple[str, ...]

    @staticmethod
    def _sums(label: str, weight: str | None, train: Column | None = None) -> tuple[Column, Column]:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        if train is not None:
            w = F.when(train, w).otherwise(F.lit(0.0))
        return F.sum(w * F.col(label)).alias("_s"), F.sum(w).alias("_n")

    def fit(self, df, features, label, weight=None):
        table = df.groupBy(*self.keys).agg(*self._sums(label, weight))
        overall = df.agg(*self._sums(label, weight)).first()
        return Strata(table.select(*self.keys, F.try_divide("_s", "_n").alias("mean")), list(self.keys), (overall["_s"] or 0.0) / (overall["_n"] or 1.0))

    def crossfit(self, df, features, label, fold, out, train=None, weight=None):
        keys = list(self.keys)
        own = df.groupBy(*keys, fold).agg(*self._sums(label, weight, train))
        total = own.groupBy(*keys).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
        overall = {r[fold]: (r["_s"] or 0.0, r["_n"] or 0.0) for r in own.groupBy(fold).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).collect()}
        s, n = (sum(v[i] for v in overall.values()) for i in (0, 1))
        rest = F.lit(None).cast("double")
        for f, (fs, fn) in overall.items():
            rest = F.when(F.col(fold) == f, F.lit(float((s - fs) / (n - fn)) if n - fn else 0.0)).otherwise(rest)
        table = own.join(total, keys).select(*keys, fold, F.try_divide(F.col("_ts") - F.col("_s"), F.when(F.col("_tn") - F.col("_n") > 1e-12, F.col("_tn") - F.col("_n"))).alias("_mean"))
        return df.join(table, [*keys, fold], "left").withColumn(out, F.coalesce("_mean", rest)).drop("_mean")


@dataclass
class FittedML:
    model: object
    features: list[str]
    classifier: bool

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        done = self.model.transform(VectorAssembler(inputCols=self.features, outputCol="_x").transform(df))
        value = vector_to_array("_probability")[1] if self.classifier else F.col("_prediction")
        added = [c for c in ("_x", "_prediction", "_probability", "_raw") if c in done.columns]
        return done.withColumn(out, value).drop(*added)


@dataclass
class ML(Base):
    """Any ``pyspark.ml`` regressor or classifier (of 0/1 labels), or a function that makes one; weights go to its ``weightCol``.

    ``validation`` names a boolean column of rows that boosted trees stop early by.
    """

    estimator: object
    validation: str | None = None

    def fit(self, df, features, label, weight=None):
        from pyspark.ml.feature import VectorAssembler

        template = self.estimator if hasattr(self.estimator, "hasParam") else self.estimator()
        classifier = template.hasParam("probabilityCol")
        settings = {"featuresCol": "_x", "labelCol": label, "predictionCol": "_prediction"}
        if classifier:
            settings |= {"probabilityCol": "_probability", "rawPredictionCol": "_raw"}
        if weight:
            settings["weightCol"] = weight
        if self.validation:
            settings["validationIndicatorCol"] = self.validation
        estimator = template.copy()
        for name, value in settings.items():
            estimator.set(estimator.getParam(name), value)
        columns = [label, "_x", *([weight] if weight else []), *([self.validation] if self.validation else [])]
        model = estimator.fit(VectorAssembler(inputCols=list(features), outputCol="_x").transform(df).select(*columns))
        return FittedML(model, list(features), classifier)


def _later(module: str, name: str, options: dict) -> ML:
    """An estimator made when it is fitted, for which a session is needed."""
    return ML(lambda: getattr(importlib.import_module(module), name)(**options))


def gbt(**options) -> ML:
    return _later("pyspark.ml.regression", "GBTRegressor", {"maxIter": 60, "maxDepth": 4, "stepSize": 0.1, "maxBins": 128, "seed": 1} | options)


def forest(**options) -> ML:
    return _later("pyspark.ml.regression", "RandomForestRegressor", {"numTrees": 50, "maxDepth": 8, "maxBins": 64, "seed": 1} | options)


def logit(**options) -> ML:
    return _later("pyspark.ml.classification", "LogisticRegression", options)


# ---------------------------------------------------------------- propensities


@dataclass
class FittedPropensity:
    """Adds an array of clipped propensities by arm."""

    models: list  # one per arm, each with predict
    bound: float
    normalized: bool = True

    def predict(self, df: DataFrame, out: str = "gps") -> DataFrame:
        names = [f"_e{i}" for i in range(len(self.models))]
        for name, model in zip(names, self.models, strict=True):
            df = model.predict(df, name)
        return df.withColumn(out, F.array(*(clip(F.col(n), self.bound) for n in names))).drop(*names)


@dataclass
class Constant:
    value: float

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, F.lit(float(self.value)))


@dataclass
class Multinomial:
    """A fitted classifier over arms; arms that it never saw get probability 0 before clipping."""

    model: object
    features: list[str]
    arms: list[int]
    bound: float

    def predict(self, df: DataFrame, out: str = "gps") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        done = self.model.transform(VectorAssembler(inputCols=self.features, outputCol="_x").transform(df))
        p = vector_to_array("_probability")
        value = F.array(*(clip(F.coalesce(F.try_element_at(p, F.lit(a + 1)), F.lit(0.0)), self.bound) for a in self.arms))
        return done.withColumn(out, value).drop("_x", "_prediction", "_probability", "_raw")


@dataclass
class Propensity:
    """P(T = a | x) for every arm: from a base learner per arm, a multinomial logistic regression (``base="logit"``), or the arms' rates (None)."""

    base: Base | str | None = None
    bound: float = 1e-3
    regularization: float = 0.0

    def __post_init__(self):
        if not 0 < self.bound < 0.5:
            raise ValueError("the clip must be in (0, 0.5)")

    def fit(self, df: DataFrame, features: list[str], arms: list[int], treatment: str = "t"):
        t = F.col(treatment).cast("int")
        if self.base is None:
            row = df.agg(*(F.avg((t == a).cast("double")).alias(f"e{a}") for a in arms)).first()
            return FittedPropensity([Constant(row[f"e{a}"] or 0.0) for a in arms], self.bound)
        if self.base == "logit":
            from pyspark.ml.classification import LogisticRegression
            from pyspark.ml.feature import VectorAssembler

            rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df).select("_x", t.cast("double").alias("_t"))
            family = "binomial" if len(arms) == 2 else "multinomial"
            model = LogisticRegression(featuresCol="_x", labelCol="_t", probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw", family=family, regParam=self.regularization).fit(rows)
            return Multinomial(model, list(features), arms, self.bound)
        models = []
        for a in arms:
            models.append(self.base.fit(df.withColumn("_is", (t == a).cast("double")), features, "_is"))
        return FittedPropensity(models, self.bound)

    def crossfit(self, df: DataFrame, features: list[str], arms: list[int], fold: str, out: str = "gps", treatment: str = "t") -> DataFrame:
        t = F.col(treatment).cast("int")
        if isinstance(self.base, Base):
            names = [f"_e{a}" for a in arms]
            for a, name in zip(arms, names, strict=True):
                df = self.base.crossfit(df.withColumn("_is", (t == a).cast("double")), features, "_is", fold, name).drop("_is")
            return df.withColumn(out, F.array(*(clip(F.col(n), self.bound) for n in names))).drop(*names)
        parts = None
        for f in fold_numbers(df, fold):
            part = self.fit(df.where(F.col(fold) != f), features, arms, treatment).predict(df.where(F.col(fold) == f), out)
            parts = part if parts is None else parts.unionByName(part)
        return parts
