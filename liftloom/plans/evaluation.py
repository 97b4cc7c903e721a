"""Queries of curves, scores, balance, off-policy evaluation and survival, with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import CausalFrame
from ..learners.base import OLS
from ..learners.meta import TLearner
from ..operators import balance, curves, ope, scores, survival
from . import views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def scored(df: DataFrame) -> DataFrame:
    """With the uplift of a T-learner on x0, rounded so that both engines order rows alike."""
    done = TLearner(model=OLS()).fit(CausalFrame(df, ("x0",))).predict(df, components=True)
    if dict(done.dtypes)["uplift"].startswith("array"):
        return done.withColumn("uplift", F.transform("uplift", lambda u: F.round(u, 9)))
    return done.withColumn("uplift", F.round("uplift", 9))


LINES = "m AS (SELECT t, regr_slope(y, x0) AS b, regr_intercept(y, x0) AS a FROM {} GROUP BY t)"
PAIRS_MULTI = f"""{views.MULTI}, {LINES.format("v_multi")},
p AS (SELECT v.row_id, k.t AS arm, CASE WHEN v.t = k.t THEN 1 ELSE 0 END AS w, v.y, round((k.a + k.b * v.x0) - (c.a + c.b * v.x0), 9) AS u
      FROM v_multi v JOIN m k ON k.t > 0 AND (v.t = 0 OR v.t = k.t) JOIN m c ON c.t = 0)"""
PAIRS_BIN = f"""{views.BINARY}, {LINES.format("v_bin")},
p AS (SELECT v.row_id, 1 AS arm, v.t AS w, v.y, v.x0, v.x1, round((k.a + k.b * v.x0) - (c.a + c.b * v.x0), 9) AS u
      FROM v_bin v JOIN m k ON k.t = 1 JOIN m c ON c.t = 0)"""
POINTS = """s AS (SELECT *, row_number() OVER o AS k, sum(w) OVER o AS nt, sum(1 - w) OVER o AS nc, sum(w * y) OVER o AS yt, sum((1 - w) * y) OVER o AS yc
    FROM {src} WINDOW o AS (PARTITION BY {by} ORDER BY u DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, ((CASE WHEN nt > 0 THEN yt / nt ELSE 0 END) - (CASE WHEN nc > 0 THEN yc / nc ELSE 0 END)) * k AS gain, yt - yc * (CASE WHEN nc > 0 THEN CAST(nt AS DOUBLE) / nc ELSE 0 END) AS qini FROM s)"""
BOTH = "o AS (SELECT arm, row_id, w, y, u, 0 AS best FROM p UNION ALL SELECT arm, row_id, w, y, CASE WHEN w = 1 THEN y ELSE -y END, 1 FROM p)"
AREAS = "x AS (SELECT arm, best, sum(gain) - 0.5e0 * arg_max(gain, k) AS gain, sum(qini) - 0.5e0 * arg_max(qini, k) AS qini FROM c GROUP BY arm, best)"
SCORES = "r AS (SELECT arm, max(gain) FILTER (best = 0) / max(gain) FILTER (best = 1) AS auuc, max(qini) FILTER (best = 0) / max(qini) FILTER (best = 1) AS qini FROM x GROUP BY arm)"


def _curve_sql(kind: str) -> str:
    return f"WITH {PAIRS_BIN}, {POINTS.format(src='p', by='arm')} SELECT CAST(arm AS INT) AS arm, CAST(k AS BIGINT) AS k, round({kind}, 3) + 0e0 AS value FROM c UNION ALL SELECT 1, 0, 0e0"


def _score_sql(pairs: str) -> str:
    return f"WITH {pairs}, {BOTH}, {POINTS.format(src='o', by='arm, best')}, {AREAS}, {SCORES} SELECT CAST(arm AS INT) AS arm, round(auuc, 6) + 0e0 AS auuc, round(qini, 6) + 0e0 AS qini FROM r"


def _scores(df: DataFrame) -> DataFrame:
    a = curves.auuc_score(df).withColumnRenamed("score", "auuc")
    return a.join(curves.qini_score(df).withColumnRenamed("score", "qini"), "arm").select(F.col("arm").cast("int"), rounded("auuc").alias("auuc"), rounded("qini").alias("qini"))


@query(_score_sql(PAIRS_MULTI))
def uplift_scores_multi(spark, sf):
    return _scores(scored(views.multi(spark, sf)))


@query(_score_sql(PAIRS_BIN))
def uplift_scores_binary(spark, sf):
    return _scores(scored(views.binary(spark, sf)))


@query(_curve_sql("gain"))
def gain_curve(spark, sf):
    return curves.cumulative_gain_curve(scored(views.binary(spark, sf))).withColumn("value", rounded("value", 3))


@query(_curve_sql("qini"))
def qini_curve(spark, sf):
    return curves.qini_curve(scored(views.binary(spark, sf))).withColumn("value", rounded("value", 3))


@query(f"WITH {PAIRS_MULTI}, {POINTS.format(src='p', by='arm')} SELECT CAST(arm AS INT) AS arm, round((sum(gain) - 0.5e0 * arg_max(gain, k)) / 1e6, 6) + 0e0 AS score FROM c GROUP BY arm")
def auuc_raw(spark, sf):
    return curves.auuc_score(scored(views.multi(spark, sf)), normalize=False).select("arm", rounded(F.col("score") / 1e6).alias("score"))


@query(f"WITH {PAIRS_MULTI}, {POINTS.format(src='p', by='arm')}, n AS (SELECT arm, round_even(count(*) * 0.3, 0) AS at FROM p GROUP BY arm) SELECT CAST(c.arm AS INT) AS arm, round(c.gain, 6) + 0e0 AS lift FROM c JOIN n ON c.arm = n.arm AND c.k = n.at")
def lift_at_k(spark, sf):
    return curves.lift_at_k(scored(views.multi(spark, sf)), 0.3).withColumn("lift", rounded("lift"))


@query(f"WITH {PAIRS_BIN} SELECT CAST(row_number() OVER (ORDER BY u - 0.01e0 DESC, row_id) AS BIGINT) AS k, round(sum(u - 0.01e0) OVER (ORDER BY u - 0.01e0 DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) + 0e0 AS value FROM p UNION ALL SELECT 0, 0e0")
def cost_curve(spark, sf):
    return curves.cost_based_targeting_curve(scored(views.binary(spark, sf)), costs=0.01).withColumn("value", rounded("value", 3))


NETS = f"""WITH {views.MULTI}, {LINES.format("v_multi")},
n AS (SELECT v.row_id, k.t AS arm, round((k.a + k.b * v.x0) - (c.a + c.b * v.x0), 9) - 0.01e0 * k.t AS net FROM v_multi v JOIN m k ON k.t > 0 JOIN m c ON c.t = 0),
b AS (SELECT row_id, max(net) AS best FROM n GROUP BY row_id), a AS (SELECT n.row_id, min(n.arm) AS arm FROM n JOIN b ON n.row_id = b.row_id AND n.net = b.best GROUP BY n.row_id)
SELECT b.row_id, CAST(CASE WHEN best > 0 THEN arm ELSE 0 END AS INT) AS assigned FROM b JOIN a ON a.row_id = b.row_id"""


@query(NETS)
def best_arm_cost(spark, sf):
    return curves.optimal_treatment_assignment(scored(views.multi(spark, sf)), costs=[0.01, 0.02, 0.03, 0.04]).select("row_id", "assigned")


@query(f"WITH {PAIRS_MULTI}, {BOTH}, {POINTS.format(src='o', by='arm, best')}, {AREAS}, {SCORES} SELECT round(avg(auuc), 6) + 0e0 AS mean, round(stddev_pop(auuc), 6) + 0e0 AS std FROM r")
def arm_summary(spark, sf):
    return scores.arm_score_summary(curves.auuc_score(scored(views.multi(spark, sf)))).select(rounded("mean").alias("mean"), rounded("std").alias("std"))


def _component(spark, sf, kind):
    df = views.binary(spark, sf).withColumns({"y_pred_ct": F.col("x0") + 1, "y_pred_tr": F.col("x0") + F.col("x1") + 1}).withColumnRenamed("t", "w")
    return scores.component_metric(df, kind).select(*(rounded(c).alias(c) for c in ("control", "treated", "total")))


def _component_sql(error: str) -> str:
    return f"WITH {views.BINARY}, e AS (SELECT t, {error} AS e FROM (SELECT t, y, CASE WHEN t = 1 THEN x0 + x1 + 1 ELSE x0 + 1 END AS p FROM v_bin)) SELECT round(avg(e) FILTER (t = 0), 6) AS control, round(avg(e) FILTER (t = 1), 6) AS treated, round(avg(e), 6) AS total FROM e"


@query(_component_sql("abs(y - p)"))
def component_mae(spark, sf):
    return _component(spark, sf, "mae")


@query(_component_sql("(y - p) * (y - p)"))
def component_mse(spark, sf):
    return _component(spark, sf, "mse")


@query(_component_sql("abs(y - p) / greatest(abs(y), 2.220446049250313e-16)"))
def component_mape(spark, sf):
    return _component(spark, sf, "mape")


@query(f"WITH {views.MULTI}, e AS (SELECT 1 AS arm, (x0 - x1) * (x0 - x1) AS e FROM v_multi UNION ALL SELECT 2, (x0 * x1 - x1) * (x0 * x1 - x1) FROM v_multi) SELECT CAST(arm AS INT) AS arm, round(sqrt(avg(e)), 6) AS pehe FROM e GROUP BY arm")
def pehe(spark, sf):
    df = views.multi(spark, sf).select(F.array("x1", "x1").alias("true_uplift"), F.array(F.col("x0"), F.col("x0") * F.col("x1")).alias("uplift"))
    return scores.pehe(df).select("arm", rounded("pehe").alias("pehe"))


@query(f"""WITH {views.BINARY}, r AS (SELECT row_id, round(x0, 2) AS x, round(y, 1) AS z FROM v_bin),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.z - b.z)) AS s, sum(CASE WHEN a.x = b.x THEN 1 ELSE 0 END) AS tx, sum(CASE WHEN a.z = b.z THEN 1 ELSE 0 END) AS ty, count(*) AS n FROM r a JOIN r b ON a.row_id < b.row_id)
SELECT CAST(1 AS INT) AS arm, round(s / sqrt(CAST(n - tx AS DOUBLE) * CAST(n - ty AS DOUBLE)), 6) AS tau FROM s""")
def kendall_tau(spark, sf):
    df = views.binary(spark, sf).select("row_id", F.round("x0", 2).alias("true_uplift"), F.round("y", 1).alias("uplift"))
    return scores.kendall_uplift(df).select(F.col("arm").cast("int"), rounded("tau").alias("tau"))


GRID = [0.0, 0.25, 0.5, 1.0]


def _doses(spark, sf):
    grid = [F.lit(g) for g in GRID]
    return views.multi(spark, sf).select("row_id", F.array(*(F.col("x0") * g - g * g * F.col("x1") for g in grid)).alias("mu"), F.array(*(F.col("x1") * g for g in grid)).alias("true_mu"))


_DOSE = f"{views.MULTI}, g AS (SELECT * FROM (VALUES (1, 0e0), (2, 0.25e0), (3, 0.5e0), (4, 1e0)) AS g(i, g)), d AS (SELECT row_id, i, g, x0 * g - g * g * x1 AS mu, x1 * g AS tru FROM v_multi, g)"


@query(f"WITH {_DOSE}, e AS (SELECT row_id, g, (mu - tru) * (mu - tru) AS e, lead(g) OVER (PARTITION BY row_id ORDER BY i) AS g2, lead((mu - tru) * (mu - tru)) OVER (PARTITION BY row_id ORDER BY i) AS e2 FROM d), s AS (SELECT row_id, sum((e + e2) / 2 * (g2 - g)) AS s FROM e GROUP BY row_id) SELECT round(avg(s), 6) AS mise FROM s")
def dose_mise(spark, sf):
    return scores.dose_response_mise(_doses(spark, sf), GRID).select(rounded("mise").alias("mise"))


@query(f"WITH {_DOSE}, b AS (SELECT row_id, max(mu) AS m FROM d GROUP BY row_id) SELECT b.row_id, min(d.g) AS dose FROM b JOIN d ON d.row_id = b.row_id AND d.mu = b.m GROUP BY b.row_id")
def best_dose(spark, sf):
    return scores.best_dose(_doses(spark, sf), GRID).select("row_id", "dose")


# ---------------------------------------------------------------- balance

_LONG = f"{views.BINARY}, f AS (SELECT t, 'x0' AS feature, x0 AS x, x1 + 0.1e0 AS w FROM v_bin UNION ALL SELECT t, 'x1', x1, x1 + 0.1e0 FROM v_bin)"
_MOM = f"WITH {_LONG}, s AS (SELECT feature, avg(x) FILTER (t = 1) AS m1, avg(x) FILTER (t = 0) AS m0, var_pop(x) FILTER (t = 1) AS v1, var_pop(x) FILTER (t = 0) AS v0 FROM f GROUP BY feature)"
_SMD = "(m1 - m0) / sqrt((v1 + v0) / 2)"
FEATURES = ["x0", "x1"]


@query(f"{_MOM} SELECT feature, round({_SMD}, 6) + 0e0 AS smd FROM s")
def smd(spark, sf):
    return balance.standardized_mean_difference(views.binary(spark, sf), FEATURES).withColumn("smd", rounded("smd"))


@query(f"""WITH {_LONG}, a AS (SELECT feature, t, sum(w * x) / sum(w) AS m FROM f GROUP BY feature, t),
v AS (SELECT f.feature, f.t, m, sum(w * (x - m) * (x - m)) / sum(w) AS v FROM f JOIN a ON a.feature = f.feature AND a.t = f.t GROUP BY f.feature, f.t, m),
s AS (SELECT feature, max(m) FILTER (t = 1) AS m1, max(m) FILTER (t = 0) AS m0, max(v) FILTER (t = 1) AS v1, max(v) FILTER (t = 0) AS v0 FROM v GROUP BY feature)
SELECT feature, round(m1, 6) AS mean_treated, round(m0, 6) AS mean_control, round({_SMD}, 6) + 0e0 AS smd FROM s""")
def covariate_balance_weighted(spark, sf):
    df = views.binary(spark, sf).withColumn("w", F.col("x1") + 0.1)
    return balance.covariate_balance(df, FEATURES, weight="w").select("feature", *(rounded(c).alias(c) for c in ("mean_treated", "mean_control", "smd")))


@query(f"{_MOM} SELECT feature, round(m1, 6) AS mean_treated, round(m0, 6) AS mean_control, round({_SMD}, 6) + 0e0 AS smd FROM s")
def covariate_balance(spark, sf):
    return balance.covariate_balance(views.binary(spark, sf), FEATURES).select("feature", *(rounded(c).alias(c) for c in ("mean_treated", "mean_control", "smd")))


@query(f"{_MOM} SELECT feature, round(v1 / v0, 6) AS variance_ratio FROM s")
def variance_ratio(spark, sf):
    return balance.variance_ratio(views.binary(spark, sf), FEATURES).withColumn("variance_ratio", rounded("variance_ratio"))


@query(f"{_MOM} SELECT feature, round({_SMD}, 6) + 0e0 AS smd, round(v1 / v0, 6) AS variance_ratio, abs({_SMD}) <= 0.1 AS smd_ok, v1 / v0 BETWEEN 0.5 AND 2.0 AS variance_ratio_ok FROM s")
def overlap_report(spark, sf):
    return balance.overlap_report(views.binary(spark, sf), FEATURES).withColumns({c: rounded(c) for c in ("smd", "variance_ratio")})


@query(f"{_MOM} SELECT bool_and(abs({_SMD}) <= 0.1 AND v1 / v0 BETWEEN 0.5 AND 2.0) AS balanced, round(max(abs({_SMD})), 6) AS max_abs_smd FROM s")
def overlap_summary(spark, sf):
    return balance.overlap_summary(views.binary(spark, sf), FEATURES).select("balanced", rounded("max_abs_smd").alias("max_abs_smd"))


@query(f"WITH {views.BINARY} SELECT round(avg(CASE WHEN x1 < 0.05 OR x1 > 0.95 THEN 1e0 ELSE 0e0 END), 6) AS share_outside, round(min(x1), 6) AS min_propensity, round(max(x1), 6) AS max_propensity, count(*) FILTER (x1 < 0.05 OR x1 > 0.95) < count(*) AS has_overlap, round(min(x1) FILTER (t = 1), 6) AS min_treated, round(max(x1) FILTER (t = 0), 6) AS max_control FROM v_bin")
def positivity(spark, sf):
    out = balance.positivity_check(views.binary(spark, sf), "x1", "t")
    return out.withColumns({c: rounded(c) for c in out.columns if c != "has_overlap"})


@query(f"WITH {views.BINARY} SELECT round(CAST(count(*) FILTER (t = 1 AND seg = 'BUILDING') AS DOUBLE) / count(*) FILTER (t = 1), 6) AS match_rate FROM v_bin")
def match_rate(spark, sf):
    df = views.binary(spark, sf)
    return balance.match_rate(df, df.where("seg = 'BUILDING'")).select(rounded("match_rate").alias("match_rate"))


# ---------------------------------------------------------------- off-policy evaluation


def _logged(spark, sf):
    df = views.binary(spark, sf)
    return df.withColumns({"e": F.lit(0.2) + F.lit(0.6) * F.col("x1"), "pi": (F.col("x0") > 0.45).cast("int"), "q": F.array(F.col("x0") + 0.5, F.col("x0") + 0.7)}).withColumn("p", F.when(F.col("t") == 1, F.col("e")).otherwise(1 - F.col("e")))


_LOGGED = f"WITH {views.BINARY}, l AS (SELECT *, CASE WHEN t = 1 THEN e ELSE 1 - e END AS p, CASE WHEN pi = 1 THEN x0 + 0.7e0 ELSE x0 + 0.5e0 END AS qpi, CASE WHEN t = 1 THEN x0 + 0.7e0 ELSE x0 + 0.5e0 END AS qa FROM (SELECT *, 0.2e0 + 0.6e0 * x1 AS e, CASE WHEN x0 > 0.45 THEN 1 ELSE 0 END AS pi FROM v_bin)), w AS (SELECT *, CASE WHEN t = pi THEN 1 / p ELSE 0 END AS w FROM l)"


@query(f"{_LOGGED} SELECT round(avg(w * y), 6) AS ips, round(sum(w * y) / sum(w), 6) AS snips, round(avg(qpi), 6) AS dm, round(avg(qpi + w * (y - qa)), 6) AS dr, round(avg(qpi + (CASE WHEN w <= 3 THEN w ELSE 0 END) * (y - qa)), 6) AS switch_dr, round(avg(qpi + w * 50 / (w * w + 50) * (y - qa)), 6) AS dr_os FROM w")
def ope_estimators(spark, sf):
    out = ope.evaluate(_logged(spark, sf), q="q", tau=3.0, lambda_=50.0)
    return out.select(*(rounded(c).alias(c) for c in out.columns))


def _one(name: str, formula: str):
    def run(spark, sf):
        return ope.evaluate(_logged(spark, sf), (name,), q="q").select(rounded(name).alias(name))

    run.__name__ = f"ope_{name}"
    return query(f"{_LOGGED} SELECT round({formula}, 6) AS {name} FROM w")(run)


_one("ips", "avg(w * y)")
_one("snips", "sum(w * y) / sum(w)")
_one("dm", "avg(qpi)")
_one("dr", "avg(qpi + w * (y - qa))")
_one("switch_dr", "avg(qpi + (CASE WHEN w <= 10 THEN w ELSE 0 END) * (y - qa))")
_one("dr_os", "avg(qpi + w * 100 / (w * w + 100) * (y - qa))")


@query(f"{_LOGGED} SELECT round(sum(w * y) / sum(w), 6) AS value FROM w")
def expected_response(spark, sf):
    return ope.expected_response(_logged(spark, sf)).select(rounded("value").alias("value"))


@query(f"WITH {PAIRS_BIN}, l AS (SELECT p.*, CASE WHEN u > 0 THEN 1 ELSE 0 END AS pi, CASE WHEN w = 1 THEN 0.2e0 + 0.6e0 * x1 ELSE 1 - (0.2e0 + 0.6e0 * x1) END AS ps, c.a + c.b * x0 AS q0, k.a + k.b * x0 AS q1 FROM p JOIN m k ON k.t = 1 JOIN m c ON c.t = 0) SELECT round(avg((CASE WHEN pi = 1 THEN q1 ELSE q0 END) + (CASE WHEN w = pi THEN 1 / ps ELSE 0 END) * (y - (CASE WHEN w = 1 THEN q1 ELSE q0 END))), 6) AS value FROM l")
def evaluate_policy_binary(spark, sf):
    df = scored(views.binary(spark, sf)).withColumn("e", F.lit(0.2) + F.lit(0.6) * F.col("x1"))
    return ope.evaluate_policy(df).select(rounded("value").alias("value"))


@query(f"""WITH {PAIRS_MULTI}, g AS (SELECT t, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM v_multi) AS e FROM v_multi GROUP BY t),
n AS (SELECT v.row_id, k.t AS arm, round((k.a + k.b * v.x0) - (c.a + c.b * v.x0), 9) AS net FROM v_multi v JOIN m k ON k.t > 0 JOIN m c ON c.t = 0),
b AS (SELECT row_id, max(net) AS best FROM n GROUP BY row_id),
a AS (SELECT b.row_id, CASE WHEN best > 0 THEN min(n.arm) ELSE 0 END AS pi FROM b JOIN n ON n.row_id = b.row_id AND n.net = b.best GROUP BY b.row_id, best)
SELECT round(avg(CASE WHEN v.t = a.pi THEN v.y / g.e ELSE 0 END), 6) AS value FROM v_multi v JOIN a ON a.row_id = v.row_id JOIN g ON g.t = a.pi""")
def policy_value_multi(spark, sf):
    df = scored(views.multi(spark, sf))
    from ..learners.base import Propensity

    df = Propensity().fit(df, [], [0, 1, 2, 3, 4]).predict(df, "gps")
    return ope.policy_value(curves.optimal_treatment_assignment(df)).select(rounded("value").alias("value"))


# ---------------------------------------------------------------- survival

_KM = f"{views.SURVIVAL}, n AS (SELECT time, count(*) AS n, count(*) FILTER (event = 0) AS d FROM v_surv GROUP BY time), r AS (SELECT time, d, sum(n) OVER (ORDER BY time DESC) AS risk FROM n), g AS (SELECT exp(coalesce(sum(ln(CAST(risk - d AS DOUBLE) / risk)), 0)) AS g FROM r WHERE time <= 50 AND d > 0 AND risk > d)"


@query(f"WITH {_KM} SELECT round(g, 6) AS g FROM g")
def km_censoring(spark, sf):
    return survival.km_censoring(views.survival(spark, sf), 50.0).select(rounded("g").alias("g"))


@query(f"WITH {_KM} SELECT row_id, round((CASE WHEN time > 50 THEN 1e0 ELSE 0e0 END) / greatest(g.g, 0.001e0), 6) AS y FROM v_surv, g")
def ipcw_outcome(spark, sf):
    return survival.ipcw_survival_pseudo_outcome(views.survival(spark, sf), 50.0).select("row_id", rounded("y").alias("y"))


@query(f"WITH {_KM}, z AS (SELECT row_id, g AS grp, t, (CASE WHEN time > 50 THEN 1e0 ELSE 0e0 END) / greatest((SELECT g FROM g), 0.001e0) AS y FROM v_surv), m AS (SELECT grp, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS u FROM z GROUP BY grp) SELECT row_id, round(u, 6) + 0e0 AS uplift FROM z JOIN m ON m.grp = z.grp")
def survival_t_learner(spark, sf):
    from ..learners.base import StrataMean
    from ..learners.meta import SurvivalUplift

    # one outcome mean per (arm, user group): users are of one arm, so groups are those of both
    frame = CausalFrame(views.survival(spark, sf).drop("y"), ("g",), outcome="time")
    model = SurvivalUplift(model=TLearner(model=StrataMean(("g",))), horizon=50.0).fit(frame)
    return model.predict(frame.df).select("row_id", rounded("uplift").alias("uplift"))
