"""Meta-learners, policy learner and survival wrapper.

``fit(frame)`` takes a CausalFrame and gives a fitted model; its ``predict(df)`` adds ``uplift`` (a double
for one treated arm, else an array by arm), and with ``components=True`` also ``y0_pred`` and
``y1_pred``.  Arms and folds are handled on the driver, rows only in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import CausalFrame
from ..functions.causal import aipw_outcome, imputed_effect, relative_propensity, transformed_outcome
from ..operators.curves import budget_size, optimal_treatment_assignment, top_mask
from ..operators.survival import ipcw_survival_pseudo_outcome
from ..plans.lineage import cut
from .base import ML, Base, FittedML, Multinomial, Propensity, hash_fold, logit


@dataclass
class FittedUplift:
    """Adds predictions of all treated arms."""

    arms: list[int]
    name: str = "uplift"

    def outcomes(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_y0`` and for each treated arm k ``_y{k}`` (predicted outcome) ."""
        raise NotImplementedError

    def predict(self, df: DataFrame, components: bool = False, out: str = "uplift") -> DataFrame:
        done = self.outcomes(df)
        treated = [a for a in self.arms if a]
        if len(treated) == 1:
            effect, y1 = F.col(f"_y{treated[0]}") - F.col("_y0"), F.col(f"_y{treated[0]}")
        else:
            effect, y1 = F.array(*(F.col(f"_y{a}") - F.col("_y0") for a in treated)), F.array(*(F.col(f"_y{a}") for a in treated))
        done = done.withColumn(out, effect)
        if components:
            done = done.withColumn("y0_pred", F.col("_y0")).withColumn("y1_pred", y1)
        return done.drop("_y0", *(f"_y{a}" for a in treated))


@dataclass
class PerArm(FittedUplift):
    """A model per arm, of outcomes (``base`` the control's) or of effects (no ``base``: the control predicts 0)."""

    models: dict[int, object] = field(default_factory=dict)
    base: object = None
    effects: bool = False

    def outcomes(self, df):
        df = self.base.predict(df, "_y0") if self.base is not None else df.withColumn("_y0", F.lit(0.0))
        for a, model in self.models.items():
            df = model.predict(df, f"_y{a}")
            if self.effects:
                df = df.withColumn(f"_y{a}", F.col(f"_y{a}") + F.col("_y0"))
        return df


@dataclass
class Learner:
    """Settings shared by the meta-learners; ``fold`` names a fold column, else ids are hashed into ``n_folds``."""

    n_folds: int = 5
    fold: str | None = None
    seed: int = 0
    name: str | None = None

    @property
    def display_name(self) -> str:
        return self.name or type(self).__name__

    def folded(self, frame: CausalFrame) -> tuple[DataFrame, str]:
        if self.fold:
            return frame.df, self.fold
        return hash_fold(frame.df, frame.row_id, self.n_folds, self.seed, "_fold"), "_fold"

    def fit(self, frame: CausalFrame) -> FittedUplift:
        raise NotImplementedError


def _weighted(learner, frame: CausalFrame, arms: list[int]) -> tuple[DataFrame, str | None]:
    """The frame's rows with out-of-fold weights 1 / P(T = t), if a propensity model is set."""
    if learner.propensity is None:
        return frame.df, learner.weight
    df, fold = learner.folded(frame)
    df = learner.propensity.crossfit(df, list(frame.features), arms, fold, "_gps", frame.treatment)
    w = 1 / F.element_at("_gps", F.col(frame.treatment).cast("int") + 1)
    return df.withColumn("_ipw", w * F.col(learner.weight) if learner.weight else w).drop("_gps", "_fold"), "_ipw"


@dataclass
class FittedS(FittedUplift):
    model: object = None

    def outcomes(self, df):
        own = "_t" in df.columns
        for a in self.arms:
            df = self.model.predict(df.withColumn("_t", F.lit(float(a))), f"_y{a}")
        return df if own else df.drop("_t")


@dataclass
class SLearner(Learner):
    """One model of the outcome on treatment and features."""

    model: Base | None = None
    propensity: Propensity | None = None
    weight: str | None = None

    def fit(self, frame):
        arms = frame.arms()
        df, weight = _weighted(self, frame, arms)
        df = df.withColumn("_t", F.col(frame.treatment).cast("double"))
        return FittedS(arms, self.display_name, self.model.fit(df, ["_t", *frame.features], frame.outcome, weight))


@dataclass
class TLearner(Learner):
    """A model of the outcome per arm."""

    model: Base | None = None
    model_treated: Base | None = None
    propensity: Propensity | None = None
    weight: str | None = None

    def fit(self, frame):
        arms = frame.arms()
        df, weight = _weighted(self, frame, arms)
        fit = lambda a: ((self.model_treated or self.model) if a else self.model).fit(df.where(F.col(frame.treatment) == a), list(frame.features), frame.outcome, weight)
        models = {a: fit(a) for a in arms}
        return PerArm(arms, self.display_name, {a: m for a, m in models.items() if a}, models[0])


@dataclass
class FittedX(FittedUplift):
    effects: dict[int, tuple] = field(default_factory=dict)
    base: object = None
    propensity: object = None

    def outcomes(self, df):
        df = self.propensity.predict(self.base.predict(df, "_y0"), "_gps")
        for a, (from_control, from_treated) in self.effects.items():
            df = from_treated.predict(from_control.predict(df, "_d0"), "_d1")
            g = relative_propensity(F.element_at("_gps", self.arms.index(a) + 1), F.element_at("_gps", 1))
            df = df.withColumn(f"_y{a}", F.col("_y0") + g * F.col("_d0") + (1 - g) * F.col("_d1")).drop("_d0", "_d1")
        return df.drop("_gps")


def _oof_outcomes(df: DataFrame, frame: CausalFrame, arms: list[int], model: Base, treated: Base | None, fold: str) -> DataFrame:
    """Out-of-fold predictions ``_m{a}`` of every arm's outcome for all rows."""
    for a in arms:
        df = ((treated or model) if a else model).crossfit(df, list(frame.features), frame.outcome, fold, f"_m{a}", F.col(frame.treatment) == a)
    return df


@dataclass
class XLearner(Learner):
    """Imputed effects of treated and control rows, weighed by the relative propensity."""

    model: Base | None = None
    model_treated: Base | None = None
    effect_model: Base | None = None
    effect_model_treated: Base | None = None
    propensity: Propensity = field(default_factory=Propensity)

    def fit(self, frame):
        arms, features, t = frame.arms(), list(frame.features), F.col(frame.treatment)
        df, fold = self.folded(frame)
        df = _oof_outcomes(df, frame, arms, self.model, self.model_treated, fold)
        effect = self.effect_model or self.model
        effects = {}
        for a in arms[1:]:
            rows = df.where(t.isin(0, a)).withColumn("_d", imputed_effect((t == a).cast("int"), F.col(frame.outcome), F.col("_m0"), F.col(f"_m{a}")))
            effects[a] = (effect.fit(rows.where(t == 0), features, "_d"), (self.effect_model_treated or effect).fit(rows.where(t == a), features, "_d"))
        base = self.model.fit(frame.df.where(t == 0), features, frame.outcome)
        return FittedX(arms, self.display_name, effects, base, self.propensity.fit(frame.df, features, arms, frame.treatment))


@dataclass
class RLearner(Learner):
    """Residual-on-residual regression for each treated arm against the control."""

    outcome_model: Base | None = None
    effect_model: Base | None = None
    propensity: Propensity = field(default_factory=Propensity)
    residual_threshold: float = 1e-2

    def fit(self, frame):
        arms, features, t, y = frame.arms(), list(frame.features), F.col(frame.treatment), F.col(frame.outcome)
        rows, fold = self.folded(frame)
        models = {}
        for a in arms[1:]:
            df = rows.where(t.isin(0, a)).withColumn("_w", (t == a).cast("int"))
            df = self.outcome_model.crossfit(df, features, frame.outcome, fold, "_m")
            if self.propensity.base is None:
                df = self.propensity.fit(df, features, [0, 1], "_w").predict(df, "_gps")
            else:
                df = self.propensity.crossfit(df, features, [0, 1], fold, "_gps", "_w")
            r = F.col("_w") - F.element_at("_gps", 2)
            df = df.where(F.abs(r) >= self.residual_threshold).withColumn("_z", (y - F.col("_m")) / r).withColumn("_r2", r * r)
            if df.isEmpty():
                raise ValueError("no row has a treatment residual over the threshold")
            models[a] = self.effect_model.fit(df, features, "_z", "_r2")
        return PerArm(arms, self.display_name, models)


@dataclass
class DRLearner(Learner):
    """Regression of doubly robust pseudo-outcomes."""

    outcome_model: Base | None = None
    outcome_model_treated: Base | None = None
    effect_model: Base | None = None
    propensity: Propensity = field(default_factory=Propensity)

    def pseudo_outcomes(self, frame: CausalFrame) -> DataFrame:
        """The rows with ``_phi{a}`` for each treated arm."""
        arms, t = frame.arms(), F.col(frame.treatment)
        df, fold = self.folded(frame)
        df = _oof_outcomes(df, frame, arms, self.outcome_model, self.outcome_model_treated, fold)
        if self.propensity.base is None:
            df = self.propensity.fit(df, list(frame.features), arms, frame.treatment).predict(df, "_gps")
        else:
            df = self.propensity.crossfit(df, list(frame.features), arms, fold, "_gps", frame.treatment)
        for i, a in enumerate(arms[1:], 1):
            df = df.withColumn(f"_phi{a}", aipw_outcome(F.col(frame.outcome), t == a, t == 0, F.col(f"_m{a}"), F.col("_m0"), F.element_at("_gps", i + 1), F.element_at("_gps", 1)))
        return df

    def fit(self, frame):
        arms, features = frame.arms(), list(frame.features)
        df = cut(self.pseudo_outcomes(frame))
        base = self.outcome_model.fit(frame.df.where(F.col(frame.treatment) == 0), features, frame.outcome)
        models = {a: self.effect_model.fit(df, features, f"_phi{a}") for a in arms[1:]}
        return PerArm(arms, self.display_name, models, base, effects=True)


@dataclass
class ZLearner(Learner):
    """Regression of the transformed outcome."""

    effect_model: Base | None = None
    propensity: Propensity = field(default_factory=Propensity)

    def fit(self, frame):
        arms, features, t = frame.arms(), list(frame.features), F.col(frame.treatment)
        rows, fold = self.folded(frame)
        models = {}
        for a in arms[1:]:
            df = rows.where(t.isin(0, a)).withColumn("_w", (t == a).cast("int"))
            df = self.propensity.fit(df, features, [0, 1], "_w").predict(df, "_gps") if self.propensity.base is None else self.propensity.crossfit(df, features, [0, 1], fold, "_gps", "_w")
            df = df.withColumn("_z", transformed_outcome(F.col("_w"), F.col(frame.outcome), F.element_at("_gps", 2)))
            models[a] = self.effect_model.fit(df, features, "_z")
        return PerArm(arms, self.display_name, models)


@dataclass
class Chooser:
    """The arm that a classifier, or the first of the largest of one model per arm, gives each row."""

    arms: list[int]
    classifier: object = None
    models: list = field(default_factory=list)

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        if self.classifier is not None:
            df = self.classifier.predict(df, "_scores")
        else:
            names = [f"_p{a}" for a in self.arms]
            for name, model in zip(names, self.models, strict=True):
                df = model.predict(df, name)
            df = df.withColumn("_scores", F.array(*names)).drop(*names)
        at = F.array_position("_scores", F.array_max("_scores")).cast("int")
        return df.withColumn(out, F.element_at(F.array(*(F.lit(a) for a in self.arms)), at)).drop("_scores")


@dataclass
class FittedPolicy(FittedUplift):
    cate: FittedUplift | None = None
    policy: object = None
    threshold: float = 0.0
    propensity: object = None
    row_id: str = "row_id"

    def predict(self, df, components=False, out="uplift"):
        done = self.cate.predict(df, False, out)
        if components:
            zero = F.lit(0.0)
            done = done.withColumn("y0_pred", zero).withColumn("y1_pred", F.col(out))
        return done

    def assign(self, df: DataFrame, threshold: float | None = None, budget: float | None = None, top_k: int | None = None, out: str = "assigned") -> DataFrame:
        """Arms by the policy; by a threshold on the effect; or the best rows within a budget or number."""
        scored = self.cate.predict(df)
        several = len(self.arms) > 2
        if budget is not None or top_k is not None:
            scored = cut(scored)
            k = budget_size(scored.count(), budget, top_k)
            if not several:
                return top_mask(scored, "uplift", k, self.row_id, out)
            best = optimal_treatment_assignment(scored.withColumn("_best", F.array_max("uplift")), "uplift", 0.0, "_arm")
            return top_mask(best, "_best", k, self.row_id, "_in").withColumn(out, F.when(F.col("_in") == 1, F.col("_arm")).otherwise(0)).drop("_best", "_arm", "_in")
        if threshold is None and self.policy is not None:
            if several:
                return self.policy.predict(scored, out)
            return self.policy.predict(scored, "_p").withColumn(out, (F.col("_p") > 0.5).cast("int")).drop("_p")
        if several:
            return optimal_treatment_assignment(scored, "uplift", 0.0, out)
        limit = self.threshold if threshold is None else threshold
        return scored.withColumn(out, (F.col("uplift") > limit).cast("int"))


@dataclass
class PolicyLearner(Learner):
    """A classifier of who to treat, or of the best arm, weighed by the size of the estimated effect.

    With several arms a row weighs by its best effect, so rows that no arm helps weigh nothing; ``assign`` with a
    threshold asks for the rule on the effects instead.  Where all rows get one label that rule decides, too.
    """

    cate: Learner | None = None
    policy_model: Base | None = None
    threshold: float = 0.0
    propensity: Propensity = field(default_factory=Propensity)

    def fit(self, frame):
        arms, features = frame.arms(), list(frame.features)
        cate = self.cate.fit(frame)
        rows = cate.predict(frame.df)
        if len(arms) == 2:
            rows = rows.withColumn("_label", (F.col("uplift") > self.threshold).cast("double")).withColumn("_w", F.abs("uplift"))
        else:
            best = F.greatest(F.array_max("uplift"), F.lit(0.0))
            rows = optimal_treatment_assignment(rows, "uplift", 0.0, "_label").withColumn("_label", F.col("_label").cast("double")).withColumn("_w", best)
        # as many labels as arms at most
        labels = sorted(int(r[0]) for r in rows.select("_label").distinct().collect())
        policy, base = None, self.policy_model or logit()
        if len(labels) > 1:
            policy = base.fit(rows, features, "_label", "_w") if len(arms) == 2 or isinstance(base, ML) else None
            if len(arms) > 2:
                if isinstance(policy, FittedML) and policy.classifier:
                    policy = Chooser(arms, Multinomial(policy.model, features, arms, 0.0))
                else:
                    policy = Chooser(labels, None, [base.fit(rows.withColumn("_is", (F.col("_label") == a).cast("double")), features, "_is", "_w") for a in labels])
        return FittedPolicy(arms, self.display_name, cate, policy, self.threshold, self.propensity.fit(frame.df, features, arms, frame.treatment), frame.row_id)


@dataclass
class SurvivalUplift(Learner):
    """An inner learner on the survival outcome at a horizon, weighed for censoring (pooled over arms)."""

    model: Learner | None = None
    horizon: float = 1.0
    time: str = "time"
    event: str = "event"
    censoring_clip: float = 1e-3

    def fit(self, frame):
        df = ipcw_survival_pseudo_outcome(frame.df, self.horizon, self.time, self.event, self.censoring_clip, "_survival")
        return self.model.fit(CausalFrame(df, frame.features, frame.row_id, frame.treatment, "_survival"))


