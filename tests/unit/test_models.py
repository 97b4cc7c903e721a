"""Matching, learners, trees, neural models and selection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftloom import explain
from liftloom.forecast import ModelSuite, compare_models
from liftloom.frame import CausalFrame
from liftloom.learners.base import OLS, Propensity, StrataMean, gbt, logit
from liftloom.learners.meta import DRLearner, PolicyLearner, RLearner, SLearner, SurvivalUplift, TLearner, XLearner, ZLearner
from liftloom.nn import losses, models, tape
from liftloom.nn.tape import Tensor
from liftloom.nn.train import NeuralUplift, Scaler
from liftloom.operators import balance
from liftloom.operators import matching as m
from liftloom.operators.trees import CausalForest, PolicyForest, UpliftTree
from liftloom.selection import AutoUplift, SuggestCategorical, SuggestFloat, SuggestInt, Tuner, split_space
from liftloom.sources.tables import from_matrix, read_table, result_frame, write_table
from liftloom.streaming.policy import rolling_policy_value

FEATURES = tuple(f"x{i}" for i in range(5))


def known(spark, n=2000, seed=0, arms=2):
    """Outcomes with the effect 2 x0 (per arm k: 2 k x0) and small noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    t = rng.integers(0, arms, n)
    y = x[:, 1] + 0.5 * x[:, 2] + 2 * t * x[:, 0] + rng.normal(0, 0.1, n)
    df = from_matrix(spark, x, t, y, list(FEATURES)).withColumn("true_uplift", 2 * F.col("x0")).repartition(4)
    return CausalFrame(df.cache(), FEATURES)


@pytest.fixture(scope="module")
def frame(spark):
    return known(spark)


def error(model, frame):
    return model.predict(frame.df).agg(F.avg(F.abs(F.col("uplift") - F.col("true_uplift")))).first()[0]


PS = Propensity("logit")
LEARNERS = {
    "S": (SLearner(model=gbt(maxIter=80)), 0.4), "T": (TLearner(model=OLS()), 0.3), "T weighted": (TLearner(model=OLS(), propensity=PS), 0.3),
    "X": (XLearner(model=OLS(), propensity=PS), 0.2), "R": (RLearner(outcome_model=OLS(), effect_model=OLS(ridge=1.0), propensity=PS), 0.1),
    "DR": (DRLearner(outcome_model=OLS(), effect_model=OLS(), propensity=PS), 0.2), "Z": (ZLearner(effect_model=OLS(), propensity=PS), 0.5),
    "policy": (PolicyLearner(cate=TLearner(model=OLS())), 0.3), "forest": (CausalForest(n_estimators=60, max_features=None, rows_per_tree=4000), 0.45),
}


@pytest.mark.parametrize("name", LEARNERS)
def test_known_effects(frame, name):
    learner, limit = LEARNERS[name]
    assert error(learner.fit(frame), frame) < limit


def test_several_arms_and_components(spark):
    frame = known(spark, 1200, arms=3)
    for learner in (SLearner(model=OLS()), TLearner(model=OLS()), XLearner(model=OLS()), RLearner(outcome_model=OLS(), effect_model=OLS()), DRLearner(outcome_model=OLS(), effect_model=OLS()), ZLearner(effect_model=OLS()), UpliftTree(max_depth=1, criterion="ed", min_samples_leaf=50)):
        row = learner.fit(frame).predict(frame.df, components=True).first()
        assert len(row.uplift) == 2
        assert row.uplift == pytest.approx([v - row.y0_pred for v in row.y1_pred])
    with pytest.raises(ValueError):
        TLearner(model=OLS()).fit(CausalFrame(frame.df.where("t > 0"), FEATURES))


def test_cross_fitting_leaves_the_own_fold_out(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), "ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "row_id long, fold int, s string, x double, y double").repartition(3)
    means = {r.row_id: r.p for r in StrataMean(("s",)).crossfit(df, [], "y", "fold", "p").collect()}
    lines = {r.row_id: r.p for r in OLS().crossfit(df, ["x"], "y", "fold", "p").collect()}
    for i, f, s, x, _ in rows:
        other = [r for r in rows if r[1] != f]
        assert means[i] == pytest.approx(np.mean([r[4] for r in other if r[2] == s]))
        slope, level = np.polyfit([r[3] for r in other], [r[4] for r in other], 1)
        assert lines[i] == pytest.approx(level + slope * x)


def test_policy_assignment(frame):
    fitted = PolicyLearner(cate=TLearner(model=OLS()), policy_model=logit()).fit(frame)
    right = fitted.assign(frame.df).agg(F.avg((F.col("assigned") == (F.col("true_uplift") > 0).cast("int")).cast("double"))).first()[0]
    assert right > 0.9
    assert fitted.assign(frame.df, budget=0.1).agg(F.sum("assigned")).first()[0] == 200
    assert fitted.assign(frame.df, threshold=1e9).agg(F.sum("assigned")).first()[0] == 0
    forest = PolicyForest(n_estimators=40, max_features=None, rows_per_tree=4000).fit(frame)
    done = forest.assign(frame.df, top_k=50)
    assert done.agg(F.sum("assigned")).first()[0] == 50
    assert done.stat.corr("uplift", "true_uplift") > 0.85
    band = CausalForest(n_estimators=10, max_features=None).fit(frame)
    assert band.predict_interval(frame.df).where("lower > uplift or upper < uplift").isEmpty()
    assert list(band.importance())[0] == "x0"


@pytest.mark.parametrize("base", [None, OLS()], ids=["logistic", "per arm"])
def test_policy_model_of_several_arms(spark, base):
    frame = known(spark, 900, arms=3)
    fitted = PolicyLearner(cate=TLearner(model=OLS()), policy_model=base).fit(frame)
    assert fitted.policy is not None
    done = fitted.assign(frame.df).cache()
    assert {r[0] for r in done.select("assigned").distinct().collect()} <= {0, 1, 2}
    # arm 2 is best where x0 > 0; rows that no arm helps weigh nothing
    right = done.where("x0 > 0").agg(F.avg((F.col("assigned") == 2).cast("double"))).first()[0]
    assert right > 0.9
    assert fitted.assign(frame.df, top_k=10).where("assigned > 0").count() <= 10
    # a threshold asks for the rule on the effects
    rule = fitted.assign(frame.df, threshold=0.0)
    assert rule.agg(F.avg((F.col("assigned") == F.when(F.col("x0") > 0, 2).otherwise(0)).cast("double"))).first()[0] > 0.9


def test_trees_draw_from_all_rows(spark):
    df = spark.range(24000).selectExpr("id as row_id", "cast(id % 2 as int) as t", "cast(id % 7 as double) as x0", "cast(id * id % 1009 as double) as y")
    fitted = CausalForest(n_estimators=2, max_depth=0, honest=False, bootstrap=False, pseudo_outcome="ipw").fit(CausalFrame(df, ("x0",)))
    want = df.agg(F.avg("y").alias("m"), F.avg(F.when(F.col("t") == 1, F.col("y"))).alias("a"), F.avg(F.when(F.col("t") == 0, F.col("y"))).alias("b")).first()
    assert [values[0] for _, values, _ in fitted.members[1]] == pytest.approx([want.a - want.b] * 2, rel=1e-9)


def test_survival_learner(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(x), int(t), float(rng.exponential(2 + 4 * t)), int(rng.random() < 0.8)) for i, (x, t) in enumerate(zip(rng.normal(size=1500), rng.integers(0, 2, 1500)))]
    df = spark.createDataFrame(rows, "row_id long, x double, t int, time double, event int")
    frame = CausalFrame(df, ("x",), outcome="time")
    got = SurvivalUplift(model=TLearner(model=OLS()), horizon=3.0).fit(frame).predict(df).agg(F.avg("uplift")).first()[0]
    assert got == pytest.approx(np.exp(-3 / 6) - np.exp(-3 / 2), abs=0.12)


def imbalanced(spark, n=300):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(n, 2)), 2)
    t = (rng.normal(size=n) + x[:, 0] > 0.5).astype(int)
    return x, t, from_matrix(spark, x, t, np.zeros(n), ["a", "b"]).withColumn("e", 1 / (1 + F.exp(-F.round("a", 1)))).repartition(3)


def test_nearest_neighbours_and_weights(spark):
    x, t, df = imbalanced(spark)
    d = np.sqrt(((x[t == 1][:, None] - x[t == 0][None]) ** 2).sum(-1))
    ids, cids = np.flatnonzero(t == 1), np.flatnonzero(t == 0)
    for k, caliper in ((1, None), (3, None), (2, 0.2)):
        want = {(int(i), int(cids[j])) for row, i in zip(d, ids) for j in np.lexsort((cids, row))[:k] if caliper is None or row[j] <= caliper}
        matcher = m.NearestNeighborMatcher(("a", "b"), n_neighbors=k, caliper=caliper)
        assert {(r.treated, r.control) for r in matcher.edges(df).collect()} == want
        weights = {r.row_id: r.weight for r in matcher.transform(df).collect()}
        assert all(weights[i] == 1 for i, _ in want)
        for c in {c for _, c in want}:
            assert weights[c] == pytest.approx(sum(1 for _, o in want if o == c) / k)
    radius = m.NearestNeighborMatcher(("a", "b"), radius=0.5).transform(df)
    assert radius.where("t = 0").agg(F.sum("weight")).first()[0] == pytest.approx(radius.where("t = 1").count())
    with pytest.raises(ValueError):
        m.NearestNeighborMatcher(("a", "b"), n_neighbors=10_000).transform(df)
    with pytest.raises(ValueError):
        m.NearestNeighborMatcher(("a",), radius=1.0, caliper=1.0)
    with pytest.raises(ValueError):
        m.NearestNeighborMatcher(("a",), n_neighbors=0)
    own = m.NearestNeighborMatcher(("a", "b"), metric=lambda p, q: float(abs(p - q).max())).edges(df)
    assert own.count() == (t == 1).sum()


@pytest.mark.parametrize("k,caliper", [(1, None), (2, None), (1, 0.1)])
def test_greedy_is_the_sequential_rule(spark, k, caliper):
    x, t, df = imbalanced(spark, 140)
    used, want = set(), set()
    for i in np.flatnonzero(t == 1):
        free = [(float(np.sqrt(((x[i] - x[c]) ** 2).sum())), int(c)) for c in np.flatnonzero(t == 0) if c not in used]
        for dist, c in sorted(free)[:k]:
            if caliper is None or dist <= caliper:
                used.add(c)
                want.add((int(i), c))
    matcher = m.NearestNeighborMatcher(("a", "b"), n_neighbors=k, caliper=caliper, replace=False)
    assert {(r.treated, r.control) for r in matcher.edges(df).collect()} == want


def test_other_matchers(spark):
    x, t, df = imbalanced(spark)
    cov = np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(2))
    diff = x[t == 1][:, None] - x[t == 0][None]
    best = np.sqrt(np.einsum("ijk,kl,ijl->ij", diff, cov, diff)).min(1)
    got = m.MahalanobisMatcher(("a", "b")).edges(df).orderBy("treated").collect()
    assert np.allclose([r.d for r in got], best)
    e = np.array([r.e for r in df.orderBy("row_id").collect()])
    gap = np.abs(e[t == 1][:, None] - e[t == 0][None])
    scored = m.PropensityScoreMatcher(propensity="e").edges(df).orderBy("treated").collect()
    assert np.allclose([r.d for r in scored], gap.min(1))
    first = {}
    for c in np.flatnonzero(t == 0).tolist():
        first.setdefault(e[c], c)
    assert all(r.control == first[e[r.control]] for r in scored)
    band = m.MahalanobisPSCaliperMatcher(("a", "b"), caliper=0.03)
    near = {int(i) for i, row in zip(np.flatnonzero(t == 1), gap) if (row <= 0.03).any()}
    assert {r.treated for r in band.edges(df).collect()} == near
    assert {r.row_id for r in band.unmatched(df).collect()} == set(np.flatnonzero(t == 1).tolist()) - near
    for kernel in m.KERNELS:
        made, summed = (m.KernelMatcher(("a", "b"), kernel=kernel, bandwidth=0.7) for _ in range(2))
        a = {r.row_id: r.weight for r in m.att_weights(made.edges(df)).collect()}
        b = {r.row_id: r.weight for r in summed.weights(df).collect()}
        assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i]) for i in a)
    auto = m.KernelMatcher(("a", "b")).transform(df)
    assert auto.where("t = 0").agg(F.sum("weight")).first()[0] == pytest.approx((t == 1).sum())
    with pytest.raises(ValueError):
        m.KernelMatcher(("a",), kernel="round")
    vector = m.EmbeddingMatcher(vector="v").edges(df.withColumn("v", F.array("a", "b")))
    assert vector.count() == (t == 1).sum()
    with pytest.raises(TypeError):
        m.EmbeddingMatcher(vector="v", encoder=3).edges(df.withColumn("v", F.array("a", "b")))


def test_exact_strata(spark):
    rows = [(i, 1 - i % 2, float(i // 50), "rare" if i < 4 else "common") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, t int, x double, c string").repartition(3)
    cem = m.CoarsenedExactMatcher(("x",), n_bins=4)
    assert cem.summary(df).first().match_rate == 1.0
    assert m.CoarsenedExactMatcher(("x", "c"), rare_threshold=0.5).transform(df).count() == 200
    lone = df.unionByName(spark.createDataFrame([(999, 1, 50.0, "z")], df.schema))
    by_level = m.CoarsenedExactMatcher(("c",))
    assert by_level.summary(lone).first().n_strata_dropped == 1
    assert by_level.transform(lone).where("row_id = 999").isEmpty()
    kept = m.CoarsenedExactMatcher(("c",), drop_unmatched=False).transform(lone).where("row_id = 999").first()
    assert kept.weight == 1.0 and kept.stratum == 2
    assert m.CoarsenedExactMatcher(("x",), bin_edges={"x": [0.0, 1.5, 3.0]}).transform(df).select("stratum").distinct().count() == 2


def test_matching_lowers_imbalance(spark):
    _, _, df = imbalanced(spark, 600)
    before = abs(balance.standardized_mean_difference(df, ["a"]).first().smd)
    sample = m.PropensityScoreMatcher(propensity="e", caliper=0.05).transform(df)
    assert abs(balance.standardized_mean_difference(sample, ["a"], weight="weight").first().smd) < before / 2


def test_uplift_tree_finds_the_split(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(z), int(t), float(rng.random() < (0.2 + 0.6 * t * (x > 0.3)))) for i, (x, z, t) in enumerate(zip(rng.normal(size=2000), rng.normal(size=2000), rng.integers(0, 2, 2000)))]
    frame = CausalFrame(spark.createDataFrame(rows, "row_id long, x double, z double, t int, y double"), ("x", "z"))
    for kind in ("kl", "ed", "chi"):
        tree = UpliftTree(max_depth=2, criterion=kind, max_candidates=20).fit(frame)
        assert tree.trees[0].feature == "x" and abs(tree.trees[0].threshold - 0.3) < 0.2
    got = tree.predict(frame.df).groupBy(F.col("x") > 0.6).agg(F.avg("uplift").alias("u")).orderBy("u").collect()
    assert got[1].u > 0.5 and got[0].u < 0.25
    few = CausalFrame(frame.df.withColumn("b", (F.col("x") > 0.3).cast("double")), ("b",))
    assert UpliftTree(max_depth=1).fit(few).trees[0].threshold == 0.5
    with pytest.raises(ValueError):
        UpliftTree(criterion="gini").fit(frame)


@pytest.mark.parametrize("name", models.MODELS)
def test_gradients(name):
    rng = np.random.default_rng(0)
    kind = models.MODELS[name]
    for arms in (2, 3) if kind.multi_arm else (2,):
        net = kind(3, hidden_size=6, n_treatments=arms)
        p = net.init(rng)
        x, y = rng.normal(size=(30, 3)), np.maximum(rng.normal(size=(30, 1)), 0)
        t = rng.random((30, 1)) if net.dose else rng.integers(0, arms, (30, 1)).astype(float)
        value = lambda q: net.objective({k: Tensor(v) for k, v in q.items()}, x, t, y)
        tensors = {k: Tensor(v) for k, v in p.items()}
        net.objective(tensors, x, t, y).backward()
        for k, v in tensors.items():
            if v.grad is not None:
                at = tuple(rng.integers(0, s) for s in p[k].shape)
                up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
                up[k][at] += 1e-6
                down[k][at] -= 1e-6
                assert (value(up).data - value(down).data) / 2e-6 == pytest.approx(v.grad[at], rel=1e-4, abs=1e-6)


def test_losses():
    rng = np.random.default_rng(1)
    t = (rng.random((40, 1)) < 0.5).astype(float)
    rep = Tensor(rng.normal(size=(40, 3)) + t)
    for kind in ("mmd2_lin", "mmd_lin", "mmd2_rbf", "mmd_rbf", "wass", "wass2", "lindisc"):
        assert losses.compute_imbalance(rep, t, kind).data > 0
    same = Tensor(np.vstack([rep.data[:20], rep.data[:20]]))
    half = np.repeat([[1.0], [0.0]], 20, axis=0)
    assert losses.mmd2_lin(same, half).data == pytest.approx(0) and losses.mmd2_rbf(same, half).data == pytest.approx(0)
    assert losses.compute_imbalance(rep, np.ones((40, 1))).data == 0
    y = np.array([[0.0], [2.0]])
    logits = np.array([[0.3, 0.1, -0.2], [1.0, 0.4, 0.5]])
    scale = np.logaddexp(0, logits[:, 2]) + 1e-6
    nll = np.log(1 + np.exp(logits[:, 0])) - logits[:, 0] * [0, 1]
    nll[1] += (np.log(2) - 0.4) ** 2 / 2 / scale[1] ** 2 + np.log(scale[1]) + np.log(2) + 0.5 * np.log(2 * np.pi)
    assert losses.ziln(y, Tensor(logits)).data == pytest.approx(nll.mean())
    assert losses.zero_inflated_lognormal_pred(logits)[1] == pytest.approx(1 / (1 + np.exp(-1)) * np.exp(0.4 + scale[1] ** 2 / 2))
    one = np.array([[1.0]])
    assert losses.cross_group_rank(Tensor([[5.0]]), Tensor([[5.0]]), one, one).data == 128
    assert losses.cross_group_rank(Tensor([[3.0]]), Tensor([[0.0]]), np.array([[2.0]]), one).data == 0
    assert losses.cross_group_rank(Tensor(np.zeros((0, 1))), Tensor(one), np.zeros((0, 1)), one).data == 0
    # of the pairs (2, 1) and (1, 2) each is ordered against the outcomes: gaps 1 - (-3) and back, over four pairs
    assert losses.within_group_rank(Tensor([[2.0], [1.0]]), np.array([[0.0], [3.0]])).data == pytest.approx(2 * 16 / 4)
    assert losses.within_group_rank(Tensor([[1.0], [2.0]]), np.array([[0.0], [3.0]])).data == 0
    small, large = losses.CFRLoss("smooth_l1")(Tensor([[0.004]]), Tensor([[0.0]]), np.zeros((1, 1)), np.zeros((1, 1))), losses.CFRLoss("smooth_l1")(Tensor([[2.0]]), Tensor([[0.0]]), np.zeros((1, 1)), np.zeros((1, 1)))
    assert small.data == pytest.approx(0.5 * 0.004**2 / 0.01) and large.data == pytest.approx(2 - 0.005)
    # drawn rows come from each arm, and only the pairwise terms are thinned
    rng = np.random.default_rng(2)
    y8, t8 = rng.random((8, 1)), np.array([[1.0], [0.0]] * 4)
    heads = Tensor(rng.normal(size=(8, 3))), Tensor(rng.normal(size=(8, 3)))
    sampled = losses.RERUMLoss(ranking_sample_size=2, cross_ranking_weight=1.0)
    drawn = [sampled.drawn(np.flatnonzero(t8[:, 0] == 1)).tolist() for _ in range(20)]
    assert all(len(d) == 2 for d in drawn) and len({i for d in drawn for i in d}) == 4
    assert losses.RERUMLoss(ranking_sample_size=1, within_ranking_weight=0.0)(*heads, t8, y8).data == pytest.approx(losses.RERUMLoss(within_ranking_weight=0.0)(*heads, t8, y8).data)
    tilted = losses.RERUMLoss(beta=1.0)(*heads, t8, y8, logit=Tensor(np.zeros((8, 1))), epsilon=Tensor(np.ones((8, 1))))
    assert tilted.data > losses.RERUMLoss(beta=0.0)(*heads, t8, y8, logit=Tensor(np.zeros((8, 1))), epsilon=Tensor(np.ones((8, 1)))).data


def test_transport_plan_and_scaled_imbalance():
    rng = np.random.default_rng(3)
    t = np.repeat([[1.0], [0.0]], [6, 9], axis=0)
    rep = Tensor(rng.normal(size=(15, 2)) + t)
    a, b = rep.data[:6], rep.data[6:]
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    rows, columns = np.full(6, 1 / 6), np.full(9, 1 / 9)
    for _ in range(50):
        rows = 1 / 6 / (np.exp(-cost / 10) @ columns + 1e-9)
        columns = 1 / 9 / (np.exp(-cost / 10).T @ rows + 1e-9)
    plan = rows[:, None] * np.exp(-cost / 10) * columns
    found = losses.imbalance(rep, t, "wass", r_alpha=3.0)
    assert np.allclose(found.plan.data, plan) and found.plan.pull is None
    assert np.allclose(plan.sum(0), 1 / 9) and np.allclose(plan.sum(1), 1 / 6)
    assert found.distance.data == pytest.approx((plan * cost).sum()) and found.loss.data == pytest.approx(3 * found.distance.data)
    assert losses.imbalance(rep, t, "wass", through_plan=True).plan.pull is not None
    assert losses.imbalance(rep, t, "mmd_lin", r_alpha=2.0).loss.data == pytest.approx(2 * np.sqrt(losses.mmd2_lin(rep, t).data))
    found.loss.backward()
    assert rep.grad.shape == (15, 2) and np.isfinite(rep.grad).all()
    # the gradient goes through the plan
    up, down = rep.data.copy(), rep.data.copy()
    up[2, 1] += 1e-6
    down[2, 1] -= 1e-6
    slope = (losses.compute_imbalance(Tensor(up), t, "wass", r_alpha=3.0).data - losses.compute_imbalance(Tensor(down), t, "wass", r_alpha=3.0).data) / 2e-6
    assert rep.grad[2, 1] == pytest.approx(slope, rel=1e-4)


def test_options_of_the_counterfactual_loss():
    rng = np.random.default_rng(4)
    t = np.array([[1.0], [0.0]] * 8)
    y, e, rep = rng.random((16, 1)), rng.uniform(0.2, 0.8, (16, 1)), Tensor(rng.normal(size=(16, 2)))
    call = lambda **options: float(losses.CFRLoss(**options)(Tensor(y), Tensor(y), t, y, rep=rep, weights=[Tensor([[2.0]])], rep_weights=[Tensor([[3.0]])], propensity=e).data)
    assert call(p_lambda=0.5, r_lambda=2.0) == pytest.approx(4) and call(p_lambda=0.5, rep_weight_decay=True) == pytest.approx(6.5)
    assert call(p_alpha=1.0, r_alpha=2.0) == pytest.approx(2 * losses.mmd2_lin(rep, t).data)
    assert call(p_alpha=1.0, use_p_correction=True) == pytest.approx(losses.mmd2_lin(rep, t, e).data)
    far = losses.CFRLoss("log")(Tensor([[50.0]]), Tensor([[50.0]]), np.ones((1, 1)), np.zeros((1, 1))).data
    assert far == pytest.approx(-np.log(0.0025))


def test_batch_norm_predicts_from_running_statistics():
    from liftloom.nn import models
    from liftloom.nn.train import Adam, steps

    rng = np.random.default_rng(0)
    x, t = rng.normal(2, 3, (400, 3)), rng.integers(0, 2, (400, 1)).astype(float)
    net = models.CFRNet(3, hidden_size=6, batch_norm=True)
    p = net.init(rng)
    before = {k: v.copy() for k, v in p.items()}
    for _ in range(5):
        steps(net, p, Adam(), x, t, x[:, :1] + t, 50, rng)
    assert not np.allclose(p["norm.mean"], before["norm.mean"])
    whole = net.outcomes(p, x)
    assert np.allclose(net.outcomes(p, x[:1]), whole[:1]) and np.ptp(whole) > 0


def test_imbalance_and_factual_losses_are_finite():
    from liftloom.nn import losses
    from liftloom.nn.tape import Tensor

    half = np.repeat([[1.0], [0.0]], 20, axis=0)
    y = np.array([[0.0], [2.0]])
    for loss_type in ("mse", "l1", "log", "smooth_l1"):
        assert np.isfinite(losses.CFRLoss(loss_type, reweight_sample=True, p_lambda=0.1)(Tensor(y), Tensor(y), half[:2], np.array([[0.0], [1.0]]), weights=[Tensor(y)]).data)
    assert np.isfinite(losses.PseudoPEHE()(Tensor(y), Tensor(y), np.array([[0.0], [1.0]]), y).data)
    assert tape.activation("unknown") is tape.elu


def test_neural_models_learn(spark):
    frame = known(spark, 1500)
    model = NeuralUplift(models.TARNet(5, hidden_size=24), epochs=12, learning_rate=1e-2, scaler="standard", normalize_y=True, partitions=2).fit(frame)
    assert error(model, frame) < 0.8
    doses = CausalFrame(frame.df.withColumn("t", F.pmod(F.xxhash64("row_id"), F.lit(100)) / 100.0).withColumn("y", F.col("t") * 2), FEATURES)
    curve = NeuralUplift(models.VCNet(5, hidden_size=8), epochs=15, learning_rate=1e-2, partitions=1).fit(doses).predict_dose_response(doses.df, [0.0, 1.0]).first().mu
    assert curve[1] - curve[0] == pytest.approx(2, abs=0.7)
    logged = NeuralUplift(models.EUEN(5, hidden_size=8), epochs=3, optimizer="sgd", schedule=lambda e: 0.5**e, y_transform=F.asinh, y_inverse=np.sinh, learning_rate=1e-2).fit(frame)
    assert logged.predict(frame.df).where("isnan(uplift)").isEmpty()
    with pytest.raises(ValueError):
        NeuralUplift(models.EUEN(5), optimizer="lion").fit(frame)
    rerum = models.with_rerum(models.CFRNet(5, hidden_size=6))
    assert rerum.loss.outputs == 3 and rerum.loss.imbalance == "mmd2_lin"
    with pytest.raises(TypeError):
        models.with_rerum(models.VCNet(5))
    with pytest.raises(ValueError):
        NeuralUplift(models.TARNet(4)).fit(frame)
    robust = Scaler("robust").fit(spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "x double"), ["x"])
    assert (robust.shift, robust.scale) == ([2.0], [1.0 + 1e-6])


def test_forecast_comparison_and_files(spark, frame, tmp_path):
    both = ModelSuite([TLearner(model=OLS(), name="T"), SLearner(model=gbt(maxIter=3), name="S"), TLearner(model=StrataMean(("t",)), name="strata")]).fit(frame)
    done = both.predict(frame.df, components=True)
    assert {"uplift_T", "S_y0_pred", "T_y1_pred"} <= set(done.columns)
    both.save(str(tmp_path / "model"))
    again = ModelSuite.load(spark, str(tmp_path / "model")).predict(frame.df)
    a, b = (x.orderBy("row_id").select("uplift_T", "uplift_S", "uplift_strata").limit(20).collect() for x in (done, again))
    assert a == b
    board = {r.model: r for r in compare_models(done, ["T", "S"]).collect()}
    assert board["T"].auuc > board["S"].auuc and board["T"].qini > 0.5
    assert len(compare_models(done, ["T"], ("auuc",), frame="pandas")) == 1
    with pytest.raises(ValueError):
        compare_models(done, ["T"], ("f1",))
    with pytest.raises(ValueError):
        ModelSuite([TLearner(model=OLS()), TLearner(model=OLS())])
    with pytest.raises(TypeError):
        ModelSuite([3])
    with pytest.raises(RuntimeError):
        ModelSuite([TLearner(model=OLS())]).predict(frame.df)
    write_table(frame.df.limit(5), str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path / "t.parquet")).count() == 5
    with pytest.raises(ValueError):
        result_frame(frame.df, "polars")


def test_selection(spark, frame):
    tuner = Tuner(lambda a, b: -((a["x"] - 3) ** 2) + b["z"], ({"x": SuggestInt(0, 6), "c": 1}, {"z": SuggestCategorical([0, 1])}), n_trials=60).optimize()
    assert tuner.best_params == {"0_x": 3, "1_z": 1} and tuner.has_completed_trials
    assert split_space({"a": 1, "b": SuggestFloat(0, 1)})[0][0] == {"a": 1}
    assert Tuner(lambda p: p["v"], ({"v": SuggestFloat(0.1, 10, log=True)},), 20, "minimize").optimize().best_score < 1
    auto = AutoUplift([(lambda r: TLearner(model=OLS(ridge=r)), {"r": SuggestFloat(0.1, 1)}), (lambda: SLearner(model=OLS()), {})], n_trials=2, top_k=2).fit(frame)
    board = auto.leaderboard(spark).collect()
    assert board[0].model == "TLearner" and board[0].val_score > board[1].val_score
    assert auto.predict(frame.df).where("uplift is null").isEmpty()
    with pytest.raises(ValueError):
        AutoUplift([], "qini")


def test_early_stopping_by_a_validation_column(frame):
    marked = CausalFrame(frame.df.withColumn("held", F.pmod(F.col("row_id"), F.lit(4)) == 0), FEATURES)
    base = gbt(maxIter=40)
    base.validation = "held"
    assert error(SLearner(model=base).fit(marked), marked) < 0.8


def test_approximate_backend(spark):
    _, _, df = imbalanced(spark, 200)
    exact = m.NearestNeighborMatcher(("a", "b"), radius=0.3).edges(df)
    rough = m.NearestNeighborMatcher(("a", "b"), radius=0.3, backend=m.LSHBackend(reach=0.3, bucket_length=1.0, tables=8)).edges(df)
    assert rough.join(exact, ["treated", "control"]).count() == rough.count() >= 0.9 * exact.count()


def test_explanations(spark, frame):
    model = TLearner(model=OLS()).fit(frame)
    found = explain.permutation_importance(model, frame, n_repeats=1).collect()
    assert found[0].feature == "x0" and found[0].importance_mean > 5 * abs(found[1].importance_mean)
    shap = explain.uplift_shap_values(model, frame.df.limit(30), list(FEATURES), n_samples=2)
    rows = shap.join(model.predict(frame.df), "row_id").collect()
    assert len(rows) == 30 and all(sum(r.shap) + r.base == pytest.approx(r.uplift) for r in rows)
    with pytest.raises(AttributeError):
        explain.tree_feature_importance(model)
    column = explain.shuffled(frame.df, "x0", "row_id", 3)
    assert sorted(r.x0 for r in column.collect()) == sorted(r.x0 for r in frame.df.collect())


def test_rolling_policy_value_of_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", (F.col("value") / 100).alias("y"), (F.col("user_id") % 2).cast("int").alias("t"), F.lit(1).alias("pi"), F.lit(0.5).alias("p"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    whole = {r.start: (r.n, r.snips) for r in rolling_policy_value(events).collect()}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = rolling_policy_value(stream).writeStream.outputMode("complete").format("memory").queryName("rolling").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.start: (r.n, r.snips) for r in spark.table("rolling").collect()}
    assert got.keys() == whole.keys() and all(got[k][0] == whole[k][0] and got[k][1] == pytest.approx(whole[k][1]) for k in whole)
