"""Data-parallel training and scoring of neural models in Spark.

In each round every partition starts from the same weights, takes one pass of mini-batch steps over its own rows,
and the partitions' weights are averaged by their rows.  Rows stay where they are; what reaches the
driver is at most ``MERGERS`` sets of weights a round.  One partition is plain stochastic training.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructType

from ..frame import CausalFrame
from ..learners.meta import FittedUplift
from .models import Net
from .tape import Tensor

MERGERS = 16


@dataclass
class Scaler:
    """Shift and scale of columns: identity, standard, robust (lower median and median deviation) or minmax."""

    kind: str = "robust"
    eps: float = 1e-6
    shift: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, columns: list[str]) -> Scaler:
        x = [F.col(c).cast("double") for c in columns]
        p = range(len(columns))
        lower = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")
        if self.kind == "identity":
            self.shift, self.scale = [0.0] * len(x), [1.0] * len(x)
        elif self.kind == "standard":
            r = df.agg(*(f(x[i]).alias(f"{n}{i}") for i in p for n, f in (("a", F.avg), ("b", F.stddev_pop)))).first()
            self.shift, self.scale = [r[f"a{i}"] for i in p], [r[f"b{i}"] + self.eps for i in p]
        elif self.kind == "minmax":
            r = df.agg(*(f(x[i]).alias(f"{n}{i}") for i in p for n, f in (("a", F.min), ("b", F.max)))).first()
            self.shift, self.scale = [r[f"a{i}"] for i in p], [r[f"b{i}"] - r[f"a{i}"] + self.eps for i in p]
        elif self.kind == "robust":
            named = df.select(*(c.alias(f"c{i}") for i, c in enumerate(x)))
            m = named.agg(*(lower(f"c{i}").alias(f"m{i}") for i in p)).first()
            d = named.agg(*(lower(f"abs(c{i} - {m[f'm{i}']!r}D)").alias(f"d{i}") for i in p)).first()
            self.shift, self.scale = [float(m[f"m{i}"]) for i in p], [float(d[f"d{i}"]) + self.eps for i in p]
        else:
            raise ValueError(f"unknown scaler {self.kind!r}")
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.shift)) / np.array(self.scale)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return x * np.array(self.scale) + np.array(self.shift)


@dataclass
class Adam:
    rate: float = 1e-3
    beta1: float = 0.9
    beta2: float = 0.999
    step: int = 0
    state: dict = field(default_factory=dict)

    def update(self, p: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            m, v = self.state.get(k, (0.0, 0.0))
            m, v = self.beta1 * m + (1 - self.beta1) * g, self.beta2 * v + (1 - self.beta2) * g * g
            self.state[k] = m, v
            p[k] = p[k] - self.rate * (m / (1 - self.beta1**self.step)) / (np.sqrt(v / (1 - self.beta2**self.step)) + 1e-8)


def steps(net: Net, p: dict[str, np.ndarray], adam: Adam, x: np.ndarray, t: np.ndarray, y: np.ndarray, batch: int, rng, decay: float = 0.0) -> None:
    """One pass of mini-batches over the rows."""
    order = rng.permutation(len(x))
    for lo in range(0, len(order), batch):
        at = order[lo : lo + batch]
        tensors = {k: Tensor(v) for k, v in p.items()}
        loss = net.objective(tensors, x[at], t[at], y[at])
        if not np.isfinite(loss.data):
            raise RuntimeError("the loss is not finite")
        loss.backward()
        adam.update(p, {k: v.grad + decay * p[k] for k, v in tensors.items() if v.grad is not None})


@dataclass
class SGD(Adam):
    """Plain gradient steps."""

    def update(self, p, grads):
        self.step += 1
        for k, g in grads.items():
            p[k] = p[k] - self.rate * g


OPTIMIZERS = {"adam": Adam, "sgd": SGD}


@dataclass
class FittedNeural(FittedUplift):
    net: Net | None = None
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    x_scaler: Scaler | None = None
    y_scaler: Scaler | None = None
    inverse: Callable[[np.ndarray], np.ndarray] | None = None

    def to_outcomes(self, y: np.ndarray) -> np.ndarray:
        y = self.y_scaler.inverse(y) if self.y_scaler else y
        return self.inverse(y) if self.inverse else y

    def _map(self, df: DataFrame, columns: dict[str, DataType], values) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self)
        names = list(self.features)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            me = sent.value
            for pdf in batches:
                x = me.x_scaler.transform(pdf[names].to_numpy(float))
                yield pdf.assign(**values(me, x))

        schema = StructType(list(df.schema.fields))
        for name, kind in columns.items():
            schema = schema.add(name, kind)
        return df.mapInPandas(work, schema)

    def outcomes(self, df):
        arms = list(self.arms)

        def values(me, x):
            y = me.to_outcomes(me.net.outcomes(me.weights, x))
            return {f"_y{a}": y[:, i] for i, a in enumerate(arms)}

        return self._map(df, {f"_y{a}": DoubleType() for a in arms}, values)

    def predict_dose_response(self, df: DataFrame, grid: list[float], out: str = "mu") -> DataFrame:
        """``df`` with an array of predicted outcomes over the doses of ``grid``."""

        def values(me, x):
            return {out: list(me.to_outcomes(me.net.dose_response(me.weights, x, grid)))}

        return self._map(df, {out: ArrayType(DoubleType())}, values)


@dataclass
class NeuralUplift:
    """Fits an architecture; ``normalize_y`` scales outcomes like features (off for value losses).

    ``y_transform`` is a column function of the outcome before scaling, ``y_inverse`` its inverse on arrays;
    ``schedule`` gives the learning rate's factor in each epoch.
    """

    net: Net
    epochs: int = 20
    batch_size: int = 128
    learning_rate: float = 1e-3
    scaler: str = "robust"
    normalize_y: bool = False
    weight_decay: float = 0.0
    partitions: int | None = None
    seed: int = 1
    name: str | None = None
    optimizer: str = "adam"
    schedule: Callable[[int], float] | None = None
    y_transform: Callable[[Column], Column] | None = None
    y_inverse: Callable[[np.ndarray], np.ndarray] | None = None

    @property
    def display_name(self) -> str:
        return self.name or type(self.net).__name__

    def fit(self, frame: CausalFrame) -> FittedNeural:
        features = list(frame.features)
        if len(features) != self.net.input_size:
            raise ValueError(f"the net takes {self.net.input_size} features, not {len(features)}")
        arms = [0, 1] if self.net.dose else frame.arms()
        if not self.net.dose and arms != list(range(self.net.n_treatments)):
            raise ValueError("arms must be 0..n_treatments-1")
        rows = frame.df.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(frame.treatment).cast("double").alias("_t"), (self.y_transform or (lambda c: c))(F.col(frame.outcome).cast("double")).alias("_y"))
        if self.partitions:
            rows = rows.repartition(self.partitions)
        rows = rows.persist()
        xs = Scaler(self.scaler).fit(rows, features)
        ys = Scaler(self.scaler).fit(rows, ["_y"]) if self.normalize_y else None
        net, batch, decay, seed = self.net, self.batch_size, self.weight_decay, self.seed
        p = net.init(np.random.default_rng(seed))
        if self.optimizer not in OPTIMIZERS or (self.y_transform is None) != (self.y_inverse is None):
            raise ValueError("unknown optimizer, or only one of y_transform and y_inverse")
        adam = OPTIMIZERS[self.optimizer](self.learning_rate)
        for epoch in range(self.epochs):
            adam.rate = self.learning_rate * (self.schedule(epoch) if self.schedule else 1.0)
            sent = rows.sparkSession.sparkContext.broadcast((p, adam, xs, ys))

            def work(batches: Iterator[pd.DataFrame], sent=sent, epoch=epoch) -> Iterator[pd.DataFrame]:
                start, optimizer, x_scaler, y_scaler = pickle.loads(pickle.dumps(sent.value))
                rng, n = np.random.default_rng([seed, epoch]), 0
                for pdf in batches:
                    y = pdf[["_y"]].to_numpy()
                    steps(net, start, optimizer, x_scaler.transform(pdf[features].to_numpy()), pdf[["_t"]].to_numpy(), y_scaler.transform(y) if y_scaler else y, batch, rng, decay)
                    n += len(pdf)
                if n:
                    yield pd.DataFrame({"part": [TaskContext.get().partitionId() % MERGERS], "n": [n], "data": [pickle.dumps((start, optimizer))]})

            def merge(pdf: pd.DataFrame) -> pd.DataFrame:
                found = [(n, *pickle.loads(d)) for n, d in zip(pdf["n"], pdf["data"], strict=True)]
                return pd.DataFrame({"part": pdf["part"].iloc[:1], "n": [sum(f[0] for f in found)], "data": [pickle.dumps(average(found))]})

            schema = "part int, n long, data binary"
            done = rows.mapInPandas(work, schema).groupBy("part").applyInPandas(merge, schema).collect()
            p, adam = average([(r.n, *pickle.loads(r.data)) for r in sorted(done, key=lambda r: r.part)])
            sent.unpersist()
        rows.unpersist()
        return FittedNeural(arms, self.display_name, net, p, features, xs, ys, self.y_inverse)


def average(found: list[tuple[int, dict, Adam]]) -> tuple[dict, Adam]:
    """Weights and optimiser moments averaged by rows."""
    total = sum(n for n, *_ in found)
    mean = lambda get: sum(get(p, a) * (n / total) for n, p, a in found)
    p = {k: mean(lambda q, _, k=k: q[k]) for k in found[0][1]}
    first = found[0][2]
    state = {k: (mean(lambda _, a, k=k: a.state[k][0]), mean(lambda _, a, k=k: a.state[k][1])) for k in first.state}
    return p, type(first)(first.rate, first.beta1, first.beta2, max(a.step for *_, a in found), state)
