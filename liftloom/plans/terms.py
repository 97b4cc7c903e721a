"""Queries of loss terms, imbalance measures, scalers, weights, saved models and policy models, with SQL of the same rows."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import forecast
from ..frame import CausalFrame
from ..functions import causal as C
from ..learners.base import OLS, Propensity, StrataMean
from ..learners.meta import PolicyLearner, TLearner
from ..nn import losses as L
from ..nn.tape import Tensor
from ..nn.train import Scaler
from . import views
from .evaluation import LINES, PAIRS_BIN, rounded
from .lineage import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- losses

GROUP_KEYS = 64  # order keys in a group, so that pairs of a group's rows stay bounded at any size
TERMS = ("mse", "mae", "pehe", "two_stage", "ziln", "ziln_rows", "within", "cross", "listwise", "targeted", "dragon", "rerum", "mmd_lin", "mmd_rbf", "mmd_root", "lindisc", "smooth", "logistic", "weighted")


def terms(pdf: pd.DataFrame) -> pd.DataFrame:
    """All terms over one group of rows."""
    pdf = pdf.sort_values("row_id")
    column = lambda name: pdf[[name]].to_numpy(float)
    x0, x1, t, y = (column(c) for c in ("x0", "x1", "t", "y"))
    e = 0.1 + 0.8 * x1
    y0, y1 = Tensor(x0 + 0.5), Tensor(x0 + 0.7 + x1)
    head0, head1 = Tensor(np.hstack([x0 - 0.4, x1, x0])), Tensor(np.hstack([x0, x1 + 0.2, x0]))
    m0, m1 = L._mean(head0), L._mean(head1)
    treated, control = np.flatnonzero(t[:, 0] == 1), np.flatnonzero(t[:, 0] == 0)
    rep, logit, epsilon = Tensor(np.hstack([x0, x1])), Tensor(x0), Tensor(0.1)
    rerum = L.RERUMLoss(within_ranking_weight=0.5, cross_ranking_weight=0.5, listwise_ranking_weight=0.5)
    dragon = L.DragonNetLoss(outcome_ranking_weight=0.5, uplift_ranking_weight=0.5, beta=0.5)
    found = {
        "mse": L.MSELoss()(y0, y1, t, y), "mae": L.MAELoss()(y0, y1, t, y), "pehe": L.PseudoPEHE()(y0, y1, t, y, propensity=e),
        "two_stage": L.TwoStageLoss()(head0[:, 0:2], head1[:, 0:2], t, y), "ziln": L.ziln(y, head1, t), "ziln_rows": L.zero_inflated_lognormal_loss(y, head1).mean(),
        "within": L.within_group_rank(L.chosen(m0, m1, t), y), "cross": L.cross_group_rank(m1[treated], m0[control], y[treated], y[control]),
        "listwise": L.listwise_uplift_rank(m1 - m0, t, y), "targeted": L.targeted(m0, m1, t, y, logit, epsilon),
        "dragon": dragon(head0, head1, t, y, logit=logit, epsilon=epsilon), "rerum": rerum(head0, head1, t, y),
        "mmd_lin": L.compute_imbalance(rep, t, "mmd2_lin", e), "mmd_rbf": L.compute_imbalance(rep, t, "mmd2_rbf", e, sigma=0.5), "mmd_root": L.compute_imbalance(rep, t, "mmd_lin", e, r_alpha=2.0),
        "lindisc": L.compute_imbalance(rep, t, "lindisc", e), "smooth": L.CFRLoss("smooth_l1")(y0, y1, t, y), "logistic": L.CFRLoss("log")(y0, y1, t, (y > 0).astype(float)),
        "weighted": L.CFRLoss("mse", reweight_sample=True)(y0, y1, t, y, propensity=e),
    }
    return pd.DataFrame({"g": [int(pdf["g"].iloc[0])]} | {k: [float(v.data)] for k, v in found.items()})


def _scale(x: str) -> str:
    return f"greatest(1e-6, least(5, ln(1 + exp({x})) + 1e-6))"


def _mean(l: str, loc: str) -> str:
    return f"1 / (1 + exp(-({l}))) * exp(greatest(-10, least(10, {loc})) + pow({_scale('x0')}, 2) / 2)"


def _bce(l: str, label: str) -> str:
    return f"(ln(1 + exp({l})) - ({l}) * {label})"


def _nll(loc: str, scale: str) -> str:
    return f"CASE WHEN y > 0 THEN pow((ln(y) - ({loc})) / {scale}, 2) / 2 + ln({scale}) + ln(y) + ln(2 * pi()) / 2 ELSE 0 END"


def _w(arm: int) -> str:
    return "(1 / (2 * e))" if arm else "(1 / (2 * (1 - e)))"


def _centre(x: str, arm: int) -> str:
    return f"sum({_w(arm)} * {x}) FILTER (t = {arm}) / sum({_w(arm)}) FILTER (t = {arm})"


_CHOSEN = "(CASE WHEN t = 1 THEN {1} ELSE {0} END)"
_OWN, _OWN_MEAN = _CHOSEN.format("p0", "p1"), _CHOSEN.format("m0", "m1")
_TWO, _TWO_VALUE = _CHOSEN.format("(x0 - 0.4)", "x0"), _CHOSEN.format("x1", "(x1 + 0.2)")
_BOTH_ARMS = "CASE WHEN sum(t) > 0 AND sum(1 - t) > 0 THEN {} ELSE 0e0 END"
_GAP2 = f"(pow({_centre('x0', 1)} - {_centre('x0', 0)}, 2) + pow({_centre('x1', 1)} - {_centre('x1', 0)}, 2))"
_E2 = "((1 / (1 + exp(-x0)) + 0.01) / 1.02)"
_RES = f"abs({_OWN} - y)"
_PROB = f"greatest(0.0025, least(0.9975, 1 / (1 + exp(-{_OWN}))))"


def _pair(a: str, b: str) -> str:
    return f"CASE WHEN ({a}) * ({b}) < 0 THEN pow(({a}) - ({b}), 2) ELSE 0 END"


_TERMS_SQL = f"""WITH {views.BINARY}, v AS (SELECT CAST(floor(row_id / {GROUP_KEYS}) AS BIGINT) AS g, row_id, t, x0, x1, CASE WHEN y > 1 THEN y ELSE 0 END AS y, CASE WHEN y > 1 THEN 1 ELSE 0 END AS b, 0.1e0 + 0.8e0 * x1 AS e, x0 + 0.5e0 AS p0, x0 + 0.7e0 + x1 AS p1,
{_mean("x0 - 0.4e0", "x1")} AS m0, {_mean("x0", "x1 + 0.2e0")} AS m1 FROM v_bin),
s AS (SELECT *, ln(sum(exp(m1 - m0)) OVER (PARTITION BY g)) AS z, {_OWN_MEAN} AS m FROM v),
o AS (SELECT g, avg(pow({_OWN} - y, 2)) AS mse, avg({_RES}) AS mae,
  pow(avg(p1 - p0) - (sum(t / e * y) / (sum(t / e) + 1e-8) - sum((1 - t) / (1 - e) * y) / (sum((1 - t) / (1 - e)) + 1e-8)), 2) AS pehe,
  avg({_bce(_TWO, "b")}) + sum(b * pow({_TWO_VALUE} - y, 2)) / greatest(1, sum(b)) AS two_stage,
  sum(t * ({_bce("x0", "b")} + {_nll("x1 + 0.2", _scale("x0"))})) / greatest(1, sum(t)) AS ziln, sum((1 - t) * ({_bce("x0 - 0.4", "b")} + {_nll("x1", _scale("x0"))})) / greatest(1, sum(1 - t)) AS ziln_c,
  avg({_nll("x1 + 0.2", "(ln(1 + exp(x0)) + 1e-6)")}) + avg({_bce("x0", "b")}) AS ziln_rows,
  -sum((m1 - m0 - z) * t * y) / greatest(1, sum(t)) + sum((m1 - m0 - z) * (1 - t) * y) / greatest(1, sum(1 - t)) AS listwise,
  avg(pow(m + 0.1 * (t / {_E2} - (1 - t) / (1 - {_E2})) - y, 2)) AS targeted, avg({_bce("x0", "t")}) AS ce, {_BOTH_ARMS.format(_GAP2)} AS mmd_lin,
  avg(CASE WHEN {_RES} < 0.01 THEN pow({_RES}, 2) * 50 ELSE {_RES} - 0.005 END) AS smooth, avg(-(b * ln({_PROB}) + (1 - b) * ln(1 - {_PROB}))) AS logistic,
  avg((t / (2 * e) + (1 - t) / (2 * (1 - e))) * pow({_OWN} - y, 2)) AS weighted, coalesce(sum({_w(1)}) FILTER (t = 1), 0) AS w1, coalesce(sum({_w(0)}) FILTER (t = 0), 0) AS w0, sum(t) AS n1, sum(1 - t) AS n0 FROM s GROUP BY g),
r AS (SELECT i.g, avg({_pair("i.m - j.m", "i.y - j.y")}) AS within, coalesce(avg({_pair("i.m1 - j.m1", "i.y - j.y")}) FILTER (i.t = 1 AND j.t = 1), 0) AS within1, coalesce(avg({_pair("i.m0 - j.m0", "i.y - j.y")}) FILTER (i.t = 0 AND j.t = 0), 0) AS within0,
  coalesce(avg(CASE WHEN (i.m1 - j.y) * (i.y - j.m0) < 0 THEN pow(i.m1 - j.y + j.m0 - i.y, 2) ELSE 0 END) FILTER (i.t = 1 AND j.t = 0), 0) * 2 AS "cross",
  sum((CASE WHEN i.t = j.t THEN 1 ELSE -1 END) * exp(-2 * (pow(i.x0 - j.x0, 2) + pow(i.x1 - j.x1, 2))) * (CASE WHEN i.t = 1 THEN 1 / (2 * i.e) / nullif(o.w1, 0) ELSE 1 / (2 * (1 - i.e)) / nullif(o.w0, 0) END) * (CASE WHEN j.t = 1 THEN 1 / (2 * j.e) / nullif(o.w1, 0) ELSE 1 / (2 * (1 - j.e)) / nullif(o.w0, 0) END)) AS rbf
  FROM s i JOIN s j ON i.g = j.g JOIN o ON o.g = i.g GROUP BY i.g),
a AS (SELECT o.*, within, "cross", CASE WHEN n1 > 0 AND n0 > 0 THEN rbf ELSE 0 END AS mmd_rbf, CASE WHEN n1 > 0 AND n0 > 0 THEN 2 * sqrt(greatest(mmd_lin, 1e-12 / 4)) ELSE 0 END AS mmd_root, CASE WHEN n1 > 0 AND n0 > 0 THEN sqrt(greatest(mmd_lin, 1e-12)) ELSE 0 END AS lindisc,
  ziln + ziln_c + within * 0.5 + listwise * 0.5 + ce + targeted * 0.5 AS dragon, ziln + ziln_c + (within1 + within0) * 0.5 + "cross" * 0.5 + listwise * 0.5 AS rerum FROM o JOIN r ON r.g = o.g)
SELECT g, {", ".join(f'round("{c}", 6) + 0e0 AS "{c}"' for c in TERMS)} FROM a"""


@query(_TERMS_SQL)
def loss_terms(spark, sf):
    df = views.binary(spark, sf).select("row_id", F.floor(F.col("row_id") / GROUP_KEYS).cast("long").alias("g"), "t", "x0", "x1", F.when(F.col("y") > 1, F.col("y")).otherwise(0.0).alias("y"))
    done = df.groupBy("g").applyInPandas(terms, "g long, " + ", ".join(f"`{c}` double" for c in TERMS))
    return done.select("g", *(rounded(c).alias(c) for c in TERMS))


# ---------------------------------------------------------------- scalers and weights


@query(f"""WITH {views.BINARY}, c AS (SELECT 'x0' AS feature, x0 AS x FROM v_bin UNION ALL SELECT 'y', y FROM v_bin), m AS (SELECT feature, quantile_disc(x, 0.5) AS m FROM c GROUP BY feature),
d AS (SELECT c.feature, quantile_disc(abs(x - m), 0.5) AS d FROM c JOIN m ON m.feature = c.feature GROUP BY c.feature), k AS (SELECT feature, 'identity' AS kind, 0e0 AS shift, 1e0 AS scale FROM m
UNION ALL SELECT feature, 'standard', avg(x), stddev_pop(x) + 1e-6 FROM c GROUP BY feature UNION ALL SELECT feature, 'minmax', min(x), max(x) - min(x) + 1e-6 FROM c GROUP BY feature
UNION ALL SELECT m.feature, 'robust', m, d + 1e-6 FROM m JOIN d ON d.feature = m.feature) SELECT feature, kind, round(shift, 6) + 0e0 AS shift, round(scale, 6) AS scale FROM k""")
def feature_scaler(spark, sf):
    df, found = views.binary(spark, sf), []
    for kind in ("identity", "standard", "minmax", "robust"):
        scaler = Scaler(kind).fit(df, ["x0", "y"])
        found += [(f, kind, float(a), float(b)) for f, a, b in zip(("x0", "y"), scaler.shift, scaler.scale, strict=True)]
    return spark.createDataFrame(found, "feature string, kind string, shift double, scale double").withColumns({c: rounded(c) for c in ("shift", "scale")})


@query(f"""WITH {views.BINARY} SELECT row_id, round((CASE WHEN t = 1 THEN 1 / (0.1e0 + 0.8e0 * x1) ELSE 1 / (0.9e0 - 0.8e0 * x1) END) * (1 + x1), 6) AS both, round(CASE WHEN t = 1 THEN 1 / (0.1e0 + 0.8e0 * x1) ELSE 1 / (0.9e0 - 0.8e0 * x1) END, 6) AS alone,
round(sqrt(greatest(x0, 1e-12)), 6) AS root, round((x0 - 0.25e0) / 7e0 * 3e0 + 0.5e0, 6) + 0e0 AS restored FROM v_bin""")
def weight_functions(spark, sf):
    x0, x1, t = (F.col(c) for c in ("x0", "x1", "t"))
    e = F.lit(0.1) + F.lit(0.8) * x1
    own = C.assigned_weight(t, F.array(1 - e, e))
    columns = {"both": C.with_weight(own, 1 + x1), "alone": C.with_weight(own, None), "root": C.safe_sqrt(x0), "restored": C.unscaled(C.scaled(x0, 0.25, 7.0), 0.5, 3.0)}
    return views.binary(spark, sf).select("row_id", *(rounded(c).alias(k) for k, c in columns.items()))


@query(f"""WITH {views.MULTI}, a AS (SELECT DISTINCT t AS arm FROM v_multi), o AS (SELECT seg, fold, arm, CAST(count(*) FILTER (t = arm) AS DOUBLE) AS s, count(*) AS n FROM v_multi, a GROUP BY seg, fold, arm),
k AS (SELECT seg, arm, sum(s) AS s, sum(n) AS n FROM o GROUP BY seg, arm) SELECT v_multi.row_id, CAST(o.arm AS INT) AS arm, round(greatest(0.001e0, least(0.999e0, (k.s - o.s) / (k.n - o.n))), 6) AS e
FROM v_multi JOIN o ON o.seg = v_multi.seg AND o.fold = v_multi.fold JOIN k ON k.seg = o.seg AND k.arm = o.arm""")
def oof_multiclass(spark, sf):
    df = Propensity(StrataMean(("seg",))).crossfit(views.multi(spark, sf), [], [0, 1, 2, 3, 4], "fold", "gps")
    return df.select("row_id", F.posexplode("gps").alias("arm", "e")).select("row_id", F.col("arm").cast("int"), rounded("e").alias("e"))


# ---------------------------------------------------------------- models


@query(f"WITH {PAIRS_BIN} SELECT row_id, round(u, 6) + 0e0 AS uplift FROM p")
def saved_models(spark, sf):
    frame = CausalFrame(views.binary(spark, sf), ("x0",))
    path = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    forecast.ModelSuite([TLearner(model=OLS(), name="T")]).fit(frame).save(path)
    loaded = forecast.ModelSuite.load(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return loaded.predict(frame.df).select("row_id", rounded("uplift_T").alias("uplift"))


def _weighted_line(label: str, weight: str, source: str, by: str = "") -> str:
    """Slope ``b`` and intercept ``a`` of a weighted regression of a label on x0."""
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    sums = f"SELECT {head}sum({weight}) AS sw, sum({weight} * x0) AS sx, sum({weight} * {label}) AS sy, sum({weight} * x0 * x0) AS sxx, sum({weight} * x0 * {label}) AS sxy FROM {source} {group}"
    return f"SELECT {head}(sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b, (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw AS a FROM ({sums})"


@query(f"""WITH {PAIRS_BIN}, d AS (SELECT row_id, x0, u - 0.01e0 AS margin, u, CASE WHEN u > 0.01e0 THEN 1e0 ELSE 0e0 END AS l, abs(u) AS w FROM p), k AS ({_weighted_line("l", "w", "d")})
SELECT row_id, round(u, 6) + 0e0 AS uplift, CASE WHEN (SELECT min(l) = max(l) FROM d) THEN CAST(l AS INT) WHEN k.a + k.b * x0 > 0.5 THEN 1 ELSE 0 END AS assigned FROM d, k""")
def policy_model(spark, sf):
    frame = CausalFrame(views.binary(spark, sf), ("x0",))
    model = PolicyLearner(cate=TLearner(model=OLS()), policy_model=OLS(), threshold=0.01).fit(frame)
    return model.assign(frame.df).select("row_id", rounded("uplift").alias("uplift"), "assigned")


@query(f"""WITH {views.MULTI}, {LINES.format("v_multi")}, n AS (SELECT v.row_id, v.x0, k.t AS arm, (k.a + k.b * v.x0) - (c.a + c.b * v.x0) AS u FROM v_multi v JOIN m k ON k.t > 0 JOIN m c ON c.t = 0),
d AS (SELECT row_id, any_value(x0) AS x0, greatest(max(u), 0) AS w, CASE WHEN max(u) > 0 THEN arg_max(arm, u) ELSE 0 END AS l FROM n GROUP BY row_id), a AS (SELECT DISTINCT l AS arm FROM d),
i AS (SELECT arm, x0, w, CASE WHEN l = arm THEN 1e0 ELSE 0e0 END AS y FROM d, a), k AS ({_weighted_line("y", "w", "i", "arm")}),
s AS (SELECT row_id, arm, row_number() OVER (PARTITION BY row_id ORDER BY k.a + k.b * x0 DESC, arm) AS r FROM d, k)
SELECT d.row_id, CASE WHEN (SELECT count(*) FROM a) = 1 THEN d.l ELSE s.arm END AS assigned FROM d JOIN s ON s.row_id = d.row_id AND s.r = 1""")
def policy_model_multi(spark, sf):
    frame = CausalFrame(views.multi(spark, sf), ("x0",))
    return PolicyLearner(cate=TLearner(model=OLS()), policy_model=OLS()).fit(frame).assign(frame.df).select("row_id", "assigned")
