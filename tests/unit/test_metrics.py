"""Curves, scores, balance and policy values against hand-made numbers and plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftloom.frame import CausalFrame, against_control, arms_of
from liftloom.operators import balance, curves, ope, scores, survival
from liftloom.operators.running import running


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def simulated(n=400, seed=0, arms=2):
    rng = np.random.default_rng(seed)
    u = np.round(rng.normal(size=(n, arms - 1)), 1)
    return np.arange(n), u, rng.integers(0, arms, n), np.round(rng.normal(size=n), 3)


def plain_curve(kind, y, u, t):
    order = np.lexsort((np.arange(len(u)), -u))
    y, t = y[order], t[order]
    nt, nc, k = np.cumsum(t), np.cumsum(1 - t), np.arange(1, len(y) + 1)
    yt, yc = np.cumsum(t * y), np.cumsum((1 - t) * y)
    safe = lambda a, b: np.divide(a, b, out=np.zeros(len(y)), where=b > 0)
    value = (safe(yt, nt) - safe(yc, nc)) * k if kind == "gain" else yt - yc * safe(nt.astype(float), nc)
    return np.concatenate([[0], value])


def plain_score(kind, y, u, t):
    area = lambda v: (v[1:] + v[:-1]).sum() / 2
    best = area(plain_curve(kind, y, np.where(t == 1, y, -y), t))
    return area(plain_curve(kind, y, u, t)) / best if best else 0.0


def test_gain_by_hand(spark):
    df = table(spark, [(0, 4.0, 1, 2.0), (1, 3.0, 1, 2.0), (2, 2.0, 0, 1.0), (3, 1.0, 0, 5.0)], "row_id long, uplift double, t int, y double")
    got = {r.k: r.value for r in curves.cumulative_gain_curve(df).collect()}
    assert got == {0: 0.0, 1: 2.0, 2: 4.0, 3: 3.0, 4: pytest.approx((2 - 3) * 4)}


@pytest.mark.parametrize("kind", ["gain", "qini"])
def test_curves_and_scores_equal_numpy_with_ties(spark, kind):
    i, u, t, y = simulated()
    df = table(spark, [(int(a), float(b), int(c), float(d)) for a, b, c, d in zip(i, u[:, 0], t, y)], "row_id long, uplift double, t int, y double")
    got = np.array([r.value for r in curves.curve(df, kind).orderBy("k").collect()])
    assert np.allclose(got, plain_curve(kind, y, u[:, 0], t))
    assert curves.uplift_score(df, kind).first().score == pytest.approx(plain_score(kind, y, u[:, 0], t))


def test_scores_of_several_arms(spark):
    i, u, t, y = simulated(arms=4)
    df = table(spark, [(int(a), [float(x) for x in b], int(c), float(d)) for a, b, c, d in zip(i, u, t, y)], "row_id long, uplift array<double>, t int, y double")
    got = {r.arm: r.score for r in curves.auuc_score(df).collect()}
    for k in (1, 2, 3):
        m = (t == 0) | (t == k)
        assert got[k] == pytest.approx(plain_score("gain", y[m], u[m, k - 1], (t[m] == k).astype(int)))
    lift = {r.arm: r.lift for r in curves.lift_at_k(df, 0.25).collect()}
    m = (t == 0) | (t == 1)
    assert lift[1] == pytest.approx(plain_curve("gain", y[m], u[m, 0], t[m])[round(0.25 * m.sum())])


def test_oracle_order_scores_one(spark):
    i, _, t, y = simulated()
    best = np.where(t == 1, y, -y)
    df = table(spark, [(int(a), float(b), int(c), float(d)) for a, b, c, d in zip(i, best, t, y)], "row_id long, uplift double, t int, y double")
    assert curves.qini_score(df).first().score == pytest.approx(1.0)


def test_nan_scores_come_last_and_one_empty_arm(spark):
    df = table(spark, [(0, float("nan"), 1, 5.0), (1, 1.0, 1, 1.0), (2, 2.0, 1, 1.0)], "row_id long, uplift double, t int, y double")
    got = [r.value for r in curves.cumulative_gain_curve(df).orderBy("k").collect()]
    assert got == [0.0, 1.0, 2.0, pytest.approx(7.0)]


def test_bad_inputs(spark):
    df = table(spark, [(0, 1.0, 2, 1.0), (1, 1.0, 0, 1.0)], "row_id long, uplift double, t int, y double")
    with pytest.raises(ValueError):
        curves.cumulative_gain_curve(df)
    with pytest.raises(ValueError):
        curves.lift_at_k(df.withColumn("t", F.lit(1)), 0.0)
    with pytest.raises(ValueError):
        arms_of(df.where("t = 2"), "t")
    with pytest.raises(ValueError):
        CausalFrame(df.withColumn("y", F.lit(None).cast("double"))).validated()
    with pytest.raises(ValueError):
        curves.budget_size(10, budget=0.1, top_k=3)


def test_running_over_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(x), i) for i, (g, x) in enumerate(zip(rng.integers(0, 3, 500), np.round(rng.normal(size=500), 1)))]
    df = table(spark, rows, "g int, x double, i long")
    got = {r.i: (r.s, r.m, r.c) for r in running(df, [F.col("x").asc(), F.col("i").asc()], {"s": ("sum", F.col("x")), "m": ("max", F.col("i")), "c": ("min", F.col("i"))}, ("g",)).collect()}
    for g in range(3):
        seen = []
        for _, x, i in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            seen.append((x, i))
            assert got[i] == (pytest.approx(sum(v for v, _ in seen)), max(j for _, j in seen), min(j for _, j in seen))


def test_against_control(spark):
    df = table(spark, [(0, 0), (1, 1), (2, 2)], "row_id long, t int")
    got = sorted((r.row_id, r.arm, r.w) for r in against_control(df, [0, 1, 2]).collect())
    assert got == [(0, 1, 0), (0, 2, 0), (1, 1, 1), (2, 2, 1)]


def test_assignment_and_top(spark):
    df = table(spark, [(0, [1.0, 2.0]), (1, [-1.0, -2.0]), (2, [3.0, 3.0])], "row_id long, uplift array<double>")
    assert [r.assigned for r in curves.optimal_treatment_assignment(df).orderBy("row_id").collect()] == [2, 0, 1]
    assert [r.assigned for r in curves.optimal_treatment_assignment(df, costs=[0.0, 1.5]).orderBy("row_id").collect()] == [1, 0, 1]
    tied = table(spark, [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.0)], "row_id long, s double")
    assert [r.chosen for r in curves.top_mask(tied, "s", 2).orderBy("row_id").collect()] == [0, 1, 1, 0]
    assert curves.budget_size(5, budget=0.5) == 2
    costs = [r.value for r in curves.cost_based_targeting_curve(df, costs=1.0).orderBy("k").collect()]
    assert costs == [0.0, 2.0, 3.0, 1.0]


def test_components_pehe_and_doses(spark):
    df = table(spark, [(1.0, 0, 2.0, 9.0), (3.0, 1, 9.0, 1.0), (0.0, 1, 9.0, 1.0)], "y double, w int, y_pred_ct double, y_pred_tr double")
    assert tuple(scores.uplift_component_mae(df).first()) == (1.0, 1.5, pytest.approx(4 / 3))
    assert tuple(scores.uplift_component_mse(df).first()) == (1.0, 2.5, 2.0)
    assert scores.uplift_component_mape(df).first().control == 1.0
    assert scores.pehe(table(spark, [([1.0, 0.0], [0.0, 2.0])], "true_uplift array<double>, uplift array<double>")).orderBy("arm").collect()[1].pehe == 2.0
    dose = table(spark, [([0.0, 1.0, 1.0], [0.0, 0.0, 0.0])], "mu array<double>, true_mu array<double>")
    assert scores.dose_response_mise(dose, [0.0, 0.5, 1.0]).first().mise == pytest.approx(0.75)
    assert scores.best_dose(dose, [0.0, 0.5, 1.0]).first().dose == 0.5


def test_kendall(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 12, 150), rng.integers(0, 9, 150)
    c = d = ta = tb = 0
    for i in range(150):
        for j in range(i):
            s = np.sign(a[i] - a[j]) * np.sign(b[i] - b[j])
            c, d, ta, tb = c + (s > 0), d + (s < 0), ta + (a[i] == a[j]), tb + (b[i] == b[j])
    n = 150 * 149 / 2
    df = table(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "row_id long, true_uplift double, uplift double")
    assert scores.kendall_uplift(df).first().tau == pytest.approx((c - d) / ((n - ta) * (n - tb)) ** 0.5)


def test_balance(spark):
    df = table(spark, [(1, 1.0, 5.0), (1, 3.0, 5.0), (0, 1.0, 5.0), (0, 2.0, 5.0)], "t int, a double, c double")
    got = {r.feature: r.smd for r in balance.standardized_mean_difference(df, ["a", "c"]).collect()}
    assert got == {"a": pytest.approx(0.5 / ((1 + 0.25) / 2) ** 0.5), "c": 0.0}
    ratio = {r.feature: r.variance_ratio for r in balance.variance_ratio(df, ["a", "c"]).collect()}
    assert ratio == {"a": 4.0, "c": 1.0}
    weighted = balance.covariate_balance(df.withColumn("w", F.lit(2.0)), ["a"], weight="w").first()
    assert weighted.smd == pytest.approx(got["a"]) and weighted.mean_treated == 2.0
    overlap = balance.positivity_check(table(spark, [(0.01, 1), (0.5, 0)], "e double, t int"), "e", "t").first()
    assert overlap.share_outside == 0.5 and overlap.has_overlap and overlap.max_control == 0.5
    assert not balance.overlap_summary(df, ["a", "c"]).first().balanced
    assert balance.match_rate(df, df.where("a = 1")).first().match_rate == 0.5
    with pytest.raises(Exception, match="both arms"):
        balance.standardized_mean_difference(df.where("t = 1"), ["a"]).collect()


def test_policy_values(spark):
    rng = np.random.default_rng(1)
    n = 300
    a, pi, p, r = rng.integers(0, 3, n), rng.integers(0, 3, n), rng.uniform(0.2, 0.9, n), rng.normal(size=n)
    q = rng.normal(size=(n, 3))
    df = table(spark, [(int(x), int(y), float(z), float(v), [float(w) for w in row]) for x, y, z, v, row in zip(a, pi, p, r, q)], "t int, pi int, p double, y double, q array<double>")
    got = ope.evaluate(df, q="q", tau=2.0, lambda_=5.0).first()
    w = (a == pi) / p
    direct, gap = q[np.arange(n), pi], r - q[np.arange(n), a]
    want = {"ips": (w * r).mean(), "snips": (w * r).sum() / w.sum(), "dm": direct.mean(), "dr": (direct + w * gap).mean(), "switch_dr": (direct + w * (w <= 2) * gap).mean(), "dr_os": (direct + w * 5 / (w * w + 5) * gap).mean()}
    for name, value in want.items():
        assert got[name] == pytest.approx(value)
    assert ope.expected_response(df).first().value == pytest.approx(want["snips"])
    assert ope.dr_os(df, lambda_=0.0).first().dr_os == pytest.approx(want["dm"])
    with pytest.raises(ValueError):
        ope.evaluate(df, ("magic",))
    with pytest.raises(ValueError):
        ope.dr_os(df, lambda_=-1.0)
    with pytest.raises(Exception, match="positive"):
        ope.ips(df.withColumn("p", F.lit(0.0))).collect()
    assert ope.snips(df.withColumn("pi", F.lit(9))).first().snips == 0.0


def test_censoring(spark):
    rng = np.random.default_rng(4)
    time, event = np.round(rng.exponential(5, 200), 1), rng.integers(0, 2, 200)
    g = 1.0
    for c in sorted({x for x, e in zip(time, event) if e == 0 and x <= 4}):
        g *= 1 - ((time == c) & (event == 0)).sum() / (time >= c).sum()
    df = table(spark, [(i, float(a), int(b)) for i, (a, b) in enumerate(zip(time, event))], "row_id long, time double, event int")
    assert survival.km_censoring(df, 4.0).first().g == pytest.approx(g)
    assert survival.km_censoring(df.withColumn("event", F.lit(1)), 4.0).first().g == 1.0
    assert survival.km_censoring(df.withColumn("event", F.lit(0)), 1e9).first().g == 0.0
    out = survival.ipcw_survival_pseudo_outcome(df, 4.0).where("time > 4").first().y
    assert out == pytest.approx(1 / g)
