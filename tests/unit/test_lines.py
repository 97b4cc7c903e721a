"""Kernel sums by lines against sums over all pairs."""

from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftloom.operators import boxes, lines
from liftloom.operators import matching as m
from liftloom.plans.lineage import cut

KERNELS = {"epanechnikov": lambda u: np.where(u <= 1, 0.75 * (1 - u * u), 0), "triangular": lambda u: np.where(u <= 1, 1 - u, 0), "uniform": lambda u: np.where(u <= 1, 1.0, 0)}
H = 0.05


def points(rng, n):
    """Copies, pairs exactly a bandwidth apart, lines almost on each other, and outliers."""
    x = np.stack([rng.integers(0, 1000, n) / 1e4, rng.integers(0, 9, n) / 40], 1)
    x[:9, 0], x[:9, 1] = [0.3, 0.35, 0.3999999, 0.45, 5, 5.05, 1e5, 2, 2], [0, 0, 0, 0.025, 0, 0, 0, 0, 0.05]
    x[9:30, 1] += 1e-7
    return x


@pytest.mark.parametrize("kernel", KERNELS)
def test_sums_by_lines(kernel):
    rng = np.random.default_rng(3)
    x, y = points(rng, 3000), points(rng, 3000)
    charge = 1 / rng.uniform(0.01, 100, 3000)
    weigh = lambda d: KERNELS[kernel](d / H)
    want = weigh(np.sqrt((x[:, None, 0] - y[None, :, 0]) ** 2 + (x[:, None, 1] - y[None, :, 1]) ** 2)) @ charge
    found = lines.sums(x, y, charge, 1, kernel, H, weigh, H * (1 + 1e-9))
    sure = ~np.isnan(found)
    assert sure.sum() > 2900
    assert found[sure] == pytest.approx(want[sure], rel=1e-10)
    assert (want[~sure] > 0).all() and (want[~sure] < 2 * lines.SMALL * charge.sum()).all()


@pytest.mark.parametrize("kernel", KERNELS)
def test_lines_are_taken_where_less_work(kernel):
    rng = np.random.default_rng(4)
    few = np.stack([rng.random(16_000), rng.integers(0, 10, 16_000) / 97], 1)
    assert lines.axis(few, few, kernel) == 1 and lines.axis(few[:, ::-1], few[:, ::-1], kernel) == 0
    assert lines.axis(rng.random((16_000, 2)), few, kernel) is None and lines.axis(few[:20], few, kernel) is None


@pytest.mark.parametrize("kernel", KERNELS)
def test_kernel_weights_by_lines(spark, kernel):
    rng = np.random.default_rng(6)
    x = points(rng, 12_000)
    t = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, int(t[i]), float(x[i, 0]), float(x[i, 1])) for i in range(len(x))], "row_id long, t int, a double, b double")
    a, b = np.flatnonzero(t == 1), np.flatnonzero(t == 0)
    w = KERNELS[kernel](np.sqrt((x[a][:, None, 0] - x[b][None, :, 0]) ** 2 + (x[a][:, None, 1] - x[b][None, :, 1]) ** 2) / H)
    share = (w / np.where(w.sum(1) > 0, w.sum(1), 1)[:, None]).sum(0)
    want = {int(i): 1.0 for i in a[w.sum(1) > 0]} | {int(j): s for j, s in zip(b, share, strict=True) if s > 0}
    found = {r.row_id: r.weight for r in m.KernelMatcher(("a", "b"), kernel=kernel, bandwidth=H).transform(df).collect()}
    assert found == pytest.approx(want, rel=1e-9)


def rows_sent(spark, monkeypatch, kernel):
    """Weights by tiny boxes and by brute force, and the rows that were sent to boxes for each treated row, in both passes."""
    rng = np.random.default_rng(5)
    n, h, sent = 8000, 0.2, []
    x, t = np.stack([rng.uniform(0, 1, n), rng.integers(0, 3, n) / 20], 1), np.arange(n) % 2
    df = spark.createDataFrame([(i, int(t[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)], "row_id long, t int, a double, b double")
    monkeypatch.setattr(boxes, "POINTS", 32)
    plain = boxes.BoxBackend._sent
    monkeypatch.setattr(boxes.BoxBackend, "_sent", lambda *a: sent.append((out := plain(*a)).count()) or out)
    got = {r.row_id: r.weight for r in m.KernelMatcher(("a", "b"), kernel=kernel, bandwidth=h).transform(df).select("row_id", "weight").collect()}
    w = KERNELS[kernel](np.sqrt(((x[t == 1][:, None] - x[t == 0][None]) ** 2).sum(-1)) / h)
    want = dict.fromkeys(np.flatnonzero(t == 1).tolist(), 1.0) | dict(zip(np.flatnonzero(t == 0).tolist(), (w / w.sum(1, keepdims=True)).sum(0).tolist(), strict=True))
    assert got == pytest.approx(want, rel=1e-9)
    return [s / (t == 1).sum() for s in sent]


def test_triangular_rows_go_to_few_boxes(spark, monkeypatch):
    assert max(rows_sent(spark, monkeypatch, "triangular")) < 3


def test_uniform_rows_go_to_few_boxes(spark, monkeypatch):
    assert max(rows_sent(spark, monkeypatch, "uniform")) < 3


def uniform_weights(spark, x, t, h):
    """Weights found and by brute force."""
    df = spark.createDataFrame([(i, int(t[i]), float(x[i, 0]), float(x[i, 1])) for i in range(len(x))], "row_id long, t int, a double, b double")
    a, b = np.flatnonzero(t == 1), np.flatnonzero(t == 0)
    w = KERNELS["uniform"](np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(-1)) / h)
    share = (w / np.where(w.sum(1) > 0, w.sum(1), 1)[:, None]).sum(0)
    want = {int(i): 1.0 for i in a[w.sum(1) > 0]} | {int(j): s for j, s in zip(b, share, strict=True) if s > 0}
    return {r.row_id: r.weight for r in m.KernelMatcher(("a", "b"), kernel="uniform", bandwidth=h).transform(df).collect()}, want


def test_uniform_leaves_only_its_weights_on_disk(spark):
    """Both sides and the sums are gone once weights are written, and the sums make no second shuffle."""
    rng = np.random.default_rng(8)
    x, t = np.stack([rng.uniform(0, 1, 12_000), rng.integers(0, 3, 12_000) / 20], 1), np.arange(12_000) % 2
    cut(spark.range(1))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(folder))
    found, want = uniform_weights(spark, x, t, 0.1)
    assert found == pytest.approx(want, rel=1e-9)
    assert len(set(os.listdir(folder)) - before) == 1
    sides = [cut(spark.createDataFrame([(i, x[i].tolist()) for i in np.flatnonzero(t == arm).tolist()], "id long, x array<double>")) for arm in (1, 0)]
    plan = boxes.BoxBackend().sums(*sides, lambda d: (d <= 0.1).astype(float), 0.1, ("uniform", 0.1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(cell") == 2 and plan.count("Exchange") == 2


@pytest.mark.parametrize("case", ["a cell for each box", "boxes of several cells", "few treated rows", "few controls", "arms apart"])
def test_uniform_whichever_side_is_sent(spark, monkeypatch, case):
    rng = np.random.default_rng(9)
    x = np.stack([rng.uniform(0, 3, 9000), rng.integers(0, 3, 9000) / 20], 1)
    t = (rng.random(9000) < {"few treated rows": 0.2, "few controls": 0.8}.get(case, 0.5)).astype(int)
    if case == "arms apart":
        x[t == 1, 0] += 2.5
    monkeypatch.setattr(boxes, "POINTS", 256)
    monkeypatch.setattr(boxes, "WIDE", 1)
    if case == "boxes of several cells":
        monkeypatch.setattr(boxes, "LONG", 200)
    placed, plain = [], boxes.BoxBackend._placed
    monkeypatch.setattr(boxes.BoxBackend, "_placed", lambda *a: placed.append(out := plain(*a)) or out)
    found, want = uniform_weights(spark, x, t, 0.1)
    assert found == pytest.approx(want, rel=1e-9)
    assert len(placed[0].lo) > 4
    assert [p.single for p in placed] == [case != "boxes of several cells"] * 2
    assert (placed[0].treated is None) == (case in ("boxes of several cells", "few treated rows"))


def test_cut_frees_its_shuffle_files(spark):
    files = lambda: str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")).count("/shuffle_")
    setting = lambda: spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    before, was = files(), setting()
    df = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    deadline = time.time() + 20
    while files() > before and time.time() < deadline:
        time.sleep(0.2)
    assert files() <= before and df.count() == 7
    assert setting() == was
