"""Queries of orchestration, selection, explanation, neural models and rolling policy values."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import explain
from ..forecast import ModelSuite, compare_models
from ..frame import CausalFrame
from ..functions import causal as C
from ..learners.base import OLS, Propensity, RidgeBase
from ..learners.meta import PolicyLearner, SLearner, TLearner, ZLearner
from ..nn.models import MODELS, with_rerum
from ..nn.train import NeuralUplift
from ..operators import matching as m
from ..operators import ope
from ..operators.trees import CausalForest, UpliftTree
from ..selection import AutoUplift, SuggestFloat
from ..streaming.policy import rolling_policy_value
from . import views
from .evaluation import AREAS, BOTH, PAIRS_BIN, PAIRS_MULTI, POINTS, SCORES, rounded, scored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


@query(f"WITH {PAIRS_BIN}, {BOTH}, {POINTS.format(src='o', by='arm, best')}, {AREAS}, {SCORES} SELECT 'T' AS model, CAST(arm AS INT) AS arm, round(auuc, 6) + 0e0 AS auuc, round(qini, 6) + 0e0 AS qini FROM r")
def model_comparison(spark, sf):
    frame = CausalFrame(views.binary(spark, sf), ("x0",))
    scored = ModelSuite([TLearner(model=OLS(), name="T")]).fit(frame).predict(frame.df).withColumn("uplift_T", F.round("uplift_T", 9))
    return compare_models(scored, ["T"], ("auuc", "qini")).select("model", F.col("arm").cast("int"), rounded("auuc").alias("auuc"), rounded("qini").alias("qini"))


@query()
def auto_uplift(spark, sf):
    frame = CausalFrame(views.binary(spark, sf), ("x0", "x1"))
    auto = AutoUplift([(lambda penalty: TLearner(model=RidgeBase(penalty)), {"penalty": SuggestFloat(0.1, 10.0, log=True)}), (lambda: SLearner(model=OLS()), {})], n_trials=2).fit(frame)
    return auto.leaderboard(spark)


@query()
def permutation_importance(spark, sf):
    frame = CausalFrame(views.binary(spark, sf), ("x0", "x1"))
    return explain.permutation_importance(TLearner(model=OLS()).fit(frame), frame, n_repeats=2)


def _planes(source: str, y: str = "y", by: str = "t") -> str:
    """Intercept ``a`` and slopes ``b0`` and ``b1`` of a regression on x0 and x1, by group."""
    sums = f"SELECT {by}, avg(x0) AS a0, avg(x1) AS a1, avg({y}) AS ay, var_pop(x0) AS v0, var_pop(x1) AS v1, covar_pop(x0, x1) AS c, covar_pop(x0, {y}) AS p0, covar_pop(x1, {y}) AS p1 FROM {source} GROUP BY {by}"
    slopes = f"SELECT {by}, a0, a1, ay, (p0 * v1 - p1 * c) / (v0 * v1 - c * c) AS b0, (p1 * v0 - p0 * c) / (v0 * v1 - c * c) AS b1 FROM ({sums})"
    return f"SELECT {by}, b0, b1, ay - b0 * a0 - b1 * a1 AS a FROM ({slopes})"


# the effect is linear, so each feature's share is its slope times its distance from the mean
@query(f"""WITH {views.BINARY}, m AS ({_planes("v_bin")}), d AS (SELECT k.a - c.a AS a, k.b0 - c.b0 AS b0, k.b1 - c.b1 AS b1, (SELECT avg(x0) FROM v_bin) AS x0, (SELECT avg(x1) FROM v_bin) AS x1 FROM m k JOIN m c ON k.t = 1 AND c.t = 0)
SELECT v.row_id, round(d.b0 * (v.x0 - d.x0), 6) + 0e0 AS shap_x0, round(d.b1 * (v.x1 - d.x1), 6) + 0e0 AS shap_x1, round(d.a + d.b0 * d.x0 + d.b1 * d.x1, 6) + 0e0 AS base FROM v_bin v, d""")
def shapley_values(spark, sf):
    frame = CausalFrame(views.binary(spark, sf), ("x0", "x1"))
    found = explain.uplift_shap_values(TLearner(model=OLS()).fit(frame), frame.df, ["x0", "x1"], n_samples=2)
    return found.select("row_id", rounded(F.element_at("shap", 1)).alias("shap_x0"), rounded(F.element_at("shap", 2)).alias("shap_x1"), rounded("base").alias("base"))


@query()
def forest_importance(spark, sf):
    frame = CausalFrame(views.binary(spark, sf), ("x0", "x1"))
    found = explain.tree_feature_importance(CausalForest(n_estimators=8, max_features=None).fit(frame))
    return spark.createDataFrame(list(found.items()), "feature string, importance double")


@query()
def policy_learner(spark, sf):
    frame = CausalFrame(views.binary(spark, sf), ("x0", "x1"))
    return PolicyLearner(cate=ZLearner(effect_model=OLS())).fit(frame).assign(frame.df).select("row_id", "uplift", "assigned")


# S: the slope on the arm's number is that of the outcome on what the features leave of it
@query(f"""WITH {views.MULTI}, m AS ({_planes("v_multi")}), one AS (SELECT *, 0 AS k FROM v_multi), f AS ({_planes("one", "t", "k")}), q AS (SELECT one.y, one.t - (f.a + f.b0 * x0 + f.b1 * x1) AS res FROM one JOIN f ON TRUE), s AS (SELECT covar_pop(res, y) / var_pop(res) AS b FROM q),
w AS (SELECT arm, v.*, CASE WHEN v.t = arm THEN 1e0 ELSE 0e0 END AS w FROM v_multi v JOIN (SELECT DISTINCT t AS arm FROM v_multi WHERE t > 0) ON v.t = 0 OR v.t = arm), r AS (SELECT arm, avg(w) AS e FROM w GROUP BY arm),
z AS (SELECT w.arm, x0, x1, w * y / e - (1 - w) * y / (1 - e) AS z FROM w JOIN r ON r.arm = w.arm), h AS ({_planes("z", "z", "arm")})
SELECT v.row_id, CAST(h.arm AS INT) AS arm, round((k.a + k.b0 * x0 + k.b1 * x1) - (c.a + c.b0 * x0 + c.b1 * x1), 6) + 0e0 AS uplift_T, round(s.b * h.arm, 6) + 0e0 AS uplift_S, round(h.a + h.b0 * x0 + h.b1 * x1, 6) + 0e0 AS uplift_Z,
round(c.a + c.b0 * x0 + c.b1 * x1, 6) + 0e0 AS T_y0_pred, round(k.a + k.b0 * x0 + k.b1 * x1, 6) + 0e0 AS T_y1_pred FROM v_multi v JOIN h ON TRUE JOIN m k ON k.t = h.arm JOIN m c ON c.t = 0, s""")
def forecast_columns(spark, sf):
    frame = CausalFrame(views.multi(spark, sf), ("x0", "x1"))
    models = [TLearner(model=OLS(), name="T"), SLearner(model=OLS(), name="S"), ZLearner(effect_model=OLS(), name="Z")]
    done = ModelSuite(models).fit(frame).predict(frame.df, components=True)
    arms = F.posexplode(F.arrays_zip("uplift_T", "uplift_S", "uplift_Z", "T_y1_pred")).alias("arm", "of")
    each = done.select("row_id", rounded("T_y0_pred").alias("T_y0_pred"), arms)
    return each.select("row_id", (F.col("arm") + 1).cast("int").alias("arm"), "T_y0_pred", *(rounded(F.col(f"of.{c}")).alias(c) for c in ("uplift_T", "uplift_S", "uplift_Z", "T_y1_pred")))


@query()
def neighbours_lsh(spark, sf):
    matcher = m.NearestNeighborMatcher(("x0", "x1"), backend=m.LSHBackend(reach=0.02, bucket_length=0.05))
    return matcher.edges(views.binary(spark, sf))


@query()
def uplift_tree_per_arm(spark, sf):
    frame = CausalFrame(views.multi(spark, sf).withColumn("y", (F.col("y") > 1.5).cast("double")), ("x0", "x1"))
    return UpliftTree(max_depth=1, criterion="ed", multi_arm_split="per_arm").fit(frame).predict(frame.df).select("row_id", "uplift")


@query()
def neural_rerum(spark, sf):
    frame = CausalFrame(views.binary(spark, sf), ("x0", "x1"))
    return NeuralUplift(with_rerum(MODELS["TARNet"](2, hidden_size=8)), epochs=1, name="RERUM_TARNet").fit(frame).predict(frame.df).select("row_id", "uplift")


@query()
def neural_several_arms(spark, sf):
    frame = CausalFrame(views.multi(spark, sf), ("x0", "x1"))
    return NeuralUplift(MODELS["M3TN"](2, hidden_size=8, n_treatments=5), epochs=1).fit(frame).predict(frame.df).select("row_id", "uplift")


@query()
def dose_response(spark, sf):
    frame = CausalFrame(views.binary(spark, sf).withColumn("t", F.col("x1")), ("x0", "x1"))
    return NeuralUplift(MODELS["VCNet"](2, hidden_size=8), epochs=1).fit(frame).predict_dose_response(frame.df, [0.0, 0.5, 1.0]).select("row_id", "mu")


_V = "SELECT row_id, x0, x1, t, y, 0.1e0 + 0.8e0 * x1 AS e FROM v_bin"


def _clipped(x: str) -> str:
    return f"greatest(1e-6, least(1 - 1e-6, {x}))"


@query(f"""WITH {views.BINARY}, v AS ({_V}) SELECT row_id, round(exp(-x1 * x1 / 2), 6) AS gaussian, round(0.75e0 * (1 - x1 * x1), 6) AS epanechnikov, round(1 - x1, 6) AS triangular, 1e0 AS uniform,
round(CASE WHEN t = 1 THEN 1 / e ELSE 1 / (1 - e) END, 6) AS ipw, round(t * y / e - (1 - t) * y / (1 - e), 6) AS transformed, round(greatest(0.2e0, least(0.8e0, x1)), 6) AS clipped, round(e / (e + 0.3e0), 6) AS relative,
round({_clipped("x1")} * ln({_clipped("x1")} / {_clipped("e")}) + (1 - {_clipped("x1")}) * ln((1 - {_clipped("x1")}) / (1 - {_clipped("e")})), 6) + 0e0 AS kl, round(2 * (x1 - e) * (x1 - e), 6) AS ed,
CAST(CASE WHEN x1 >= 0.25 THEN 1 ELSE 0 END + CASE WHEN x1 >= 0.5 THEN 1 ELSE 0 END AS INT) AS bin, CAST(floor(least(greatest(x1, 0), 1 - 1e-6) * 5) AS INT) AS stratum, round(x1 * x1, 6) AS square, round(pow(greatest(x1 - 1e0 / 3, 0), 2), 6) AS spline, round((x0 - 0.5e0) / 3e0, 6) + 0e0 AS scaled,
round(1 / (1 + exp(-x0)) * exp(greatest(-10, least(10, x1)) + 0.5e0 * pow(least(ln(1 + exp(x1)) + 1e-6, 5), 2)), 6) AS ziln, round(1 / (1 + exp(-x0)) * x1, 6) AS two_stage FROM v""")
def scalar_functions(spark, sf):
    df = views.binary(spark, sf).withColumn("e", F.lit(0.1) + F.lit(0.8) * F.col("x1"))
    x0, x1, t, y, e = (F.col(c) for c in ("x0", "x1", "t", "y", "e"))
    columns = {k: f(x1) for k, f in C.KERNELS.items()} | {
        "ipw": C.ipw_weight(t, e), "transformed": C.transformed_outcome(t, y, e), "clipped": C.clip(x1, 0.2), "relative": C.relative_propensity(e, F.lit(0.3)),
        "kl": C.divergence("kl", x1, e), "ed": C.divergence("ed", x1, e), "square": F.element_at(C.spline_basis(x1, 2, 2), 3), "spline": F.element_at(C.spline_basis(x1, 2, 2), 4),
        "scaled": C.scaled(x0, 0.5, 3.0), "ziln": C.ziln_mean(F.array(x0, x1, x1)), "two_stage": C.two_stage_mean(F.array(x0, x1)),
    }
    edges = F.array(F.lit(0.25), F.lit(0.5))
    return df.select("row_id", *(rounded(c).alias(k) for k, c in columns.items()), C.digitize(x1, edges).alias("bin"), C.dose_stratum(x1, 5).alias("stratum"))


@query(f"""WITH {PAIRS_MULTI}, g AS (SELECT t, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM v_multi) AS e FROM v_multi GROUP BY t),
n AS (SELECT v.row_id, k.t AS arm, round((k.a + k.b * v.x0) - (c.a + c.b * v.x0), 9) AS net FROM v_multi v JOIN m k ON k.t > 0 JOIN m c ON c.t = 0), b AS (SELECT row_id, max(net) AS best FROM n GROUP BY row_id),
a AS (SELECT b.row_id, CASE WHEN best > 0 THEN min(n.arm) ELSE 0 END AS pi FROM b JOIN n ON n.row_id = b.row_id AND n.net = b.best GROUP BY b.row_id, best)
SELECT round(avg((p.a + p.b * v.x0) + (CASE WHEN v.t = a.pi THEN 1 / g.e ELSE 0 END) * (v.y - (o.a + o.b * v.x0))), 6) AS value FROM v_multi v JOIN a ON a.row_id = v.row_id JOIN g ON g.t = v.t JOIN m p ON p.t = a.pi JOIN m o ON o.t = v.t""")
def evaluate_policy_multi(spark, sf):
    df = scored(views.multi(spark, sf))
    df = Propensity().fit(df, [], [0, 1, 2, 3, 4]).predict(df, "e")
    return ope.evaluate_policy(df).select(rounded("value").alias("value"))


for _name, _net in MODELS.items():

    def _neural(spark, sf, net=_net, name=_name):
        df = views.binary(spark, sf)
        if net.dose:
            df = df.withColumn("t", F.col("x1"))
        model = NeuralUplift(net(2, hidden_size=8), epochs=2, learning_rate=1e-2).fit(CausalFrame(df, ("x0", "x1")))
        return model.predict(df).select("row_id", "uplift")

    query(name=f"neural_{_name.lower()}")(_neural)


@query("""WITH e AS (SELECT date_trunc('day', ts) AS start, value / 100e0 AS y, CAST(user_id % 2 AS INT) AS t, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS pi FROM events), w AS (SELECT *, CASE WHEN t = pi THEN 2e0 ELSE 0e0 END AS w FROM e)
SELECT start, start + INTERVAL 1 DAY AS "end", count(*) AS n, round(sum(w * y) / count(*), 6) + 0e0 AS ips, round(coalesce(sum(w * y) / nullif(sum(w), 0), 0), 6) + 0e0 AS snips FROM w GROUP BY start""")
def rolling_policy(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("ts", (F.col("value") / 100).alias("y"), (F.col("user_id") % 2).cast("int").alias("t"), (F.col("event_id") % 3 == 0).cast("int").alias("pi"), F.lit(0.5).alias("p"))
    return rolling_policy_value(e).withColumns({"ips": rounded("ips"), "snips": rounded("snips")})
