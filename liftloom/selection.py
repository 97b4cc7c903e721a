"""Search spaces, a tuner, and automatic choice of a model."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import CausalFrame
from .operators.curves import uplift_score
from .plans.lineage import cut


class Suggest:
    """A value to be drawn by ``draw(rng)``."""

    def __init__(self, draw: Callable[[random.Random], object]):
        self.draw = draw


class SuggestCategorical(Suggest):
    def __init__(self, choices: list):
        super().__init__(lambda rng: rng.choice(list(choices)))


class SuggestFloat(Suggest):
    def __init__(self, low: float, high: float, step: float | None = None, log: bool = False):
        def draw(rng: random.Random) -> float:
            if log:
                return math.exp(rng.uniform(math.log(low), math.log(high)))
            return rng.uniform(low, high) if step is None else low + step * rng.randint(0, round((high - low) / step))

        super().__init__(draw)


class SuggestInt(Suggest):
    def __init__(self, low: int, high: int, step: int = 1, log: bool = False):
        def draw(rng: random.Random) -> int:
            if log:
                return min(high, round(math.exp(rng.uniform(math.log(low), math.log(high)))))
            return rng.randrange(low, high + 1, step)

        super().__init__(draw)


def split_space(*spaces: dict) -> list[tuple[dict, dict]]:
    """(constants, searched parameters) of each dictionary."""
    return [({k: v for k, v in s.items() if not isinstance(v, Suggest)}, {k: v for k, v in s.items() if isinstance(v, Suggest)}) for s in spaces]


@dataclass
class Tuner:
    """Random search over ``func(*dicts) -> score``; trials may run side by side.

    With several spaces the searched names are prefixed by their position, as ``0_name``.
    """

    func: Callable
    spaces: tuple[dict, ...]
    n_trials: int = 100
    direction: str = "maximize"
    seed: int = 0
    parallelism: int = 1
    trials: list[tuple[dict, float]] = field(default_factory=list)

    def __post_init__(self):
        if self.direction not in ("maximize", "minimize"):
            raise ValueError("direction must be maximize or minimize")

    def optimize(self) -> Tuner:
        rng, parts = random.Random(self.seed), split_space(*self.spaces)
        many = len(parts) > 1
        plans = []
        for _ in range(self.n_trials if any(s for _, s in parts) else 1):
            drawn = [{k: s.draw(rng) for k, s in search.items()} for _, search in parts]
            names = {f"{i}_{k}" if many else k: v for i, d in enumerate(drawn) for k, v in d.items()}
            plans.append((names, [c | d for (c, _), d in zip(parts, drawn, strict=True)]))
        with ThreadPoolExecutor(self.parallelism) as pool:
            scores = list(pool.map(lambda plan: self.func(*plan[1]), plans))
        self.trials = [(names, float(score)) for (names, _), score in zip(plans, scores, strict=True)]
        return self

    @property
    def has_completed_trials(self) -> bool:
        return bool(self.trials)

    def _best(self) -> tuple[dict, float]:
        if not self.trials:
            raise RuntimeError("no trial has completed")
        return (max if self.direction == "maximize" else min)(self.trials, key=lambda t: t[1])

    @property
    def best_params(self) -> dict:
        return self._best()[0]

    @property
    def best_score(self) -> float:
        return self._best()[1]


@dataclass
class AutoUplift:
    """Tunes candidates (factory, space) on a split within arms, refits the best on all rows and averages them.  One treated arm."""

    candidates: list[tuple[Callable, dict]]
    metric: str = "qini"
    n_trials: int = 10
    validation_size: float = 0.25
    top_k: int = 1
    seed: int = 0
    leaderboard_rows: list[tuple[str, float, dict]] = field(default_factory=list)
    fitted: list = field(default_factory=list)

    def __post_init__(self):
        if self.metric not in ("auuc", "qini") or not self.candidates or not 0 < self.validation_size < 1:
            raise ValueError("need candidates, metric auuc or qini, and a validation size in (0, 1)")

    def fit(self, frame: CausalFrame, validation: DataFrame | None = None) -> AutoUplift:
        if frame.arms() != [0, 1]:
            raise ValueError("automatic choice takes one treated arm")
        if validation is None:
            # a hash of the id splits each arm in the same proportion
            rows = cut(frame.df.withColumn("_u", F.pmod(F.xxhash64(F.col(frame.row_id), F.lit(self.seed)), F.lit(10_000)) / 10_000.0))
            train, validation = rows.where(F.col("_u") >= self.validation_size), rows.where(F.col("_u") < self.validation_size)
        else:
            train = frame.df
        kind = "gain" if self.metric == "auuc" else "qini"
        part = CausalFrame(train, frame.features, frame.row_id, frame.treatment, frame.outcome)

        def score(factory: Callable, params: dict) -> float:
            scored = factory(**params).fit(part).predict(validation)
            return uplift_score(scored, kind, "uplift", frame.outcome, frame.treatment, frame.row_id).first().score

        found, names = [], {}
        for factory, space in self.candidates:
            tuner = Tuner(lambda p, f=factory: score(f, p), (space,), self.n_trials, seed=self.seed).optimize()
            constants = split_space(space)[0][0]
            learner = factory(**(constants | tuner.best_params))
            name = learner.display_name
            names[name] = names.get(name, -1) + 1
            found.append((name if not names[name] else f"{name}_{names[name]}", tuner.best_score, tuner.best_params, learner))
        found.sort(key=lambda x: (-x[1], x[0]))
        self.leaderboard_rows = [x[:3] for x in found]
        self.fitted = [x[3].fit(frame) for x in found[: self.top_k]]
        return self

    def leaderboard(self, spark) -> DataFrame:
        """(model, val_score, best_params), best first."""
        rows = [(n, s, {k: str(v) for k, v in p.items()}) for n, s, p in self.leaderboard_rows]
        return spark.createDataFrame(rows, "model string, val_score double, best_params map<string,string>").orderBy(F.desc("val_score"), "model")

    def predict(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("fit first")
        names = [f"_u{i}" for i in range(len(self.fitted))]
        for name, model in zip(names, self.fitted, strict=True):
            df = model.predict(df, False, name)
        return df.withColumn("uplift", sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names)
