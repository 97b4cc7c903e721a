"""Queries of matching, learners, policies and trees, with SQL of the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import CausalFrame
from ..learners.base import OLS, Propensity, StrataMean
from ..learners.meta import DRLearner, RLearner, SLearner, TLearner, XLearner, ZLearner
from ..operators import curves
from ..operators import matching as m
from ..operators.trees import CausalForest, PolicyForest, UpliftTree
from . import views
from .evaluation import PAIRS_BIN, rounded, scored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- matching

XS = ("x0", "x1")
_PAIRS = "d AS (SELECT a.row_id AS treated, b.row_id AS control, {} AS d FROM v_bin a JOIN v_bin b ON a.t = 1 AND b.t = 0)"
_EUCLID = "sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1))"
_WEIGHTS = "SELECT DISTINCT treated AS row_id, 1e0 AS weight FROM e UNION ALL SELECT control, {} FROM e GROUP BY control"


def _knn_sql(distance: str, k: int, limit: str = "", band: str = "") -> str:
    return f"""WITH {views.BINARY}, {_PAIRS.format(distance)}{band}, r AS (SELECT *, row_number() OVER (PARTITION BY treated ORDER BY d, control) AS r FROM d),
e AS (SELECT * FROM r WHERE r <= {k} {limit}) {_WEIGHTS.format(f"round(count(*) / {k}e0, 6)")}"""


def _weights(df: DataFrame) -> DataFrame:
    return df.select("row_id", rounded("weight").alias("weight"))


@query(_knn_sql(_EUCLID, 2))
def knn_euclid(spark, sf):
    return _weights(m.NearestNeighborMatcher(XS, n_neighbors=2).transform(views.binary(spark, sf)))


@query(_knn_sql("abs(a.x0 - b.x0) + abs(a.x1 - b.x1)", 2))
def knn_manhattan(spark, sf):
    return _weights(m.NearestNeighborMatcher(XS, n_neighbors=2, metric="manhattan").transform(views.binary(spark, sf)))


@query(_knn_sql(_EUCLID, 2, "AND d <= 0.002"))
def knn_caliper(spark, sf):
    return _weights(m.NearestNeighborMatcher(XS, n_neighbors=2, caliper=0.002).transform(views.binary(spark, sf)))


@query(f"WITH {views.BINARY}, {_PAIRS.format(_EUCLID)}, k AS (SELECT * FROM d WHERE d <= 0.01), e AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY treated) AS w FROM k) {_WEIGHTS.format('round(sum(w), 6)')}")
def radius_match(spark, sf):
    return _weights(m.NearestNeighborMatcher(XS, radius=0.01).transform(views.binary(spark, sf)))


_COSINE = "1 - (a.x0 * b.x0 + a.x1 * b.x1) / (sqrt(a.x0 * a.x0 + a.x1 * a.x1) * sqrt(b.x0 * b.x0 + b.x1 * b.x1))"


@query(f"WITH {views.BINARY}, {_PAIRS.format(_COSINE)} SELECT treated, round(min(d), 6) + 0e0 AS d FROM d GROUP BY treated")
def knn_cosine(spark, sf):
    return m.NearestNeighborMatcher(XS, n_neighbors=1, metric="cosine").edges(views.binary(spark, sf)).select("treated", rounded("d").alias("d"))


_KERNEL_SQL = {
    "gaussian": "exp(-(d / 0.05e0) * (d / 0.05e0) / 2)",
    "epanechnikov": "CASE WHEN d / 0.05e0 <= 1 THEN 0.75e0 * (1 - (d / 0.05e0) * (d / 0.05e0)) ELSE 0 END",
    "triangular": "CASE WHEN d / 0.05e0 <= 1 THEN 1 - d / 0.05e0 ELSE 0 END",
    "uniform": "CASE WHEN d / 0.05e0 <= 1 THEN 1e0 ELSE 0e0 END",
}
for _kernel, _formula in _KERNEL_SQL.items():

    def _run(spark, sf, kernel=_kernel):
        return _weights(m.KernelMatcher(XS, kernel=kernel, bandwidth=0.05).transform(views.binary(spark, sf)))

    query(f"WITH {views.BINARY}, {_PAIRS.format(_EUCLID)}, k AS (SELECT treated, control, {_formula} AS k FROM d), e AS (SELECT treated, control, k / sum(k) OVER (PARTITION BY treated) AS w FROM k WHERE k > 0) {_WEIGHTS.format('round(sum(w), 6)')}", f"kernel_{_kernel}")(_run)


@query(f"""WITH {views.BINARY}, {_PAIRS.format(_EUCLID)}, r AS (SELECT *, row_number() OVER (PARTITION BY treated ORDER BY d, control) AS r FROM d), c AS (SELECT * FROM r WHERE r <= 10),
h AS (SELECT quantile_cont(d, 0.5) AS h FROM c WHERE d > 0), e AS (SELECT treated, control, k / sum(k) OVER (PARTITION BY treated) AS w FROM (SELECT treated, control, exp(-(d / h) * (d / h) / 2) AS k FROM c, h)) {_WEIGHTS.format('round(sum(w), 6)')}""")
def kernel_auto_bandwidth(spark, sf):
    return _weights(m.KernelMatcher(XS, candidate_mode="knn", n_neighbors=10).transform(views.binary(spark, sf)))


_MAHA = """c AS (SELECT covar_samp(x0, x0) + 1e-6 AS a, covar_samp(x0, x1) AS b, covar_samp(x1, x1) + 1e-6 AS d FROM v_bin),
d AS (SELECT a.row_id AS treated, b.row_id AS control, sqrt(greatest(0, (c.d * (a.x0 - b.x0) * (a.x0 - b.x0) - 2 * c.b * (a.x0 - b.x0) * (a.x1 - b.x1) + c.a * (a.x1 - b.x1) * (a.x1 - b.x1)) / (c.a * c.d - c.b * c.b))) AS d FROM v_bin a JOIN v_bin b ON a.t = 1 AND b.t = 0, c)"""


@query(f"WITH {views.BINARY}, {_MAHA}, r AS (SELECT treated, min(d) AS d FROM d GROUP BY treated) SELECT treated, round(d, 6) AS d FROM r")
def mahalanobis_match(spark, sf):
    return m.MahalanobisMatcher(XS).edges(views.binary(spark, sf)).select("treated", rounded("d").alias("d"))


def _with_propensity(spark, sf):
    df = views.binary(spark, sf)
    return StrataMean(("seg", "status")).fit(df.withColumn("_t", F.col("t").cast("double")), [], "_t").predict(df, "e").withColumn("e", F.round("e", 9))


_PROP = f"{views.BINARY}, g AS (SELECT seg, status, round(avg(CAST(t AS DOUBLE)), 9) AS e FROM v_bin GROUP BY seg, status), v AS (SELECT v_bin.*, g.e FROM v_bin JOIN g ON g.seg = v_bin.seg AND g.status = v_bin.status)"


@query(f"""WITH {_PROP}, c AS (SELECT e, min(row_id) AS control FROM v WHERE t = 0 GROUP BY e), s AS (SELECT DISTINCT e FROM v WHERE t = 1),
r AS (SELECT s.e, c.control, row_number() OVER (PARTITION BY s.e ORDER BY abs(s.e - c.e), c.control) AS r FROM s, c),
e AS (SELECT v.row_id AS treated, r.control FROM v JOIN r ON r.e = v.e AND r.r = 1 WHERE v.t = 1) {_WEIGHTS.format("round(count(*) * 1e0, 6)")}""")
def psm_strata(spark, sf):
    return _weights(m.PropensityScoreMatcher(propensity="e").transform(_with_propensity(spark, sf)))


@query(f"""WITH {_PROP}, z AS (SELECT row_id, t, e, (x0 - avg(x0) OVER ()) / (stddev_pop(x0) OVER () + 1e-12) AS x0, (x1 - avg(x1) OVER ()) / (stddev_pop(x1) OVER () + 1e-12) AS x1 FROM v),
c AS (SELECT covar_samp(x0, x0) + 1e-6 AS a, covar_samp(x0, x1) AS b, covar_samp(x1, x1) + 1e-6 AS d FROM z),
d AS (SELECT a.row_id AS treated, sqrt(greatest(0, (c.d * (a.x0 - b.x0) * (a.x0 - b.x0) - 2 * c.b * (a.x0 - b.x0) * (a.x1 - b.x1) + c.a * (a.x1 - b.x1) * (a.x1 - b.x1)) / (c.a * c.d - c.b * c.b))) AS d FROM z a JOIN z b ON a.t = 1 AND b.t = 0 AND abs(a.e - b.e) <= 0.004, c)
SELECT treated, round(min(d), 6) AS d FROM d GROUP BY treated""")
def ps_caliper_mahalanobis(spark, sf):
    return m.MahalanobisPSCaliperMatcher(XS, caliper=0.004).edges(_with_propensity(spark, sf)).select("treated", rounded("d").alias("d"))


@query("""WITH v AS (SELECT vec_id AS row_id, label % 2 AS t, embedding AS v FROM embeddings),
d AS (SELECT a.row_id AS treated, sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (CAST(a.v[i] AS DOUBLE) - b.v[i]) * (CAST(a.v[i] AS DOUBLE) - b.v[i])))) AS d FROM v a JOIN v b ON a.t = 1 AND b.t = 0)
SELECT treated, round(min(d), 6) AS d FROM d GROUP BY treated""")
def embedding_match(spark, sf):
    return m.EmbeddingMatcher(vector="embedding").edges(views.vectors(spark, sf)).select("treated", rounded("d").alias("d"))


@query(f"""WITH RECURSIVE {views.BINARY}, {_PAIRS.format(_EUCLID)}, c AS (SELECT treated, list(control ORDER BY d, control) AS near FROM d WHERE d <= 0.003 GROUP BY treated), o AS (SELECT *, row_number() OVER (ORDER BY treated) AS i FROM c),
g(i, treated, control, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT i, treated, control, CASE WHEN control IS NULL THEN used ELSE list_append(used, control) END
FROM (SELECT o.i, o.treated, list_filter(o.near, lambda x: NOT list_contains(g.used, x))[1] AS control, g.used FROM g JOIN o ON o.i = g.i + 1)), e AS (SELECT treated, control FROM g WHERE control IS NOT NULL) {_WEIGHTS.format("round(count(*) * 1e0, 6)")}""")
def greedy_no_replacement(spark, sf):
    return _weights(m.NearestNeighborMatcher(XS, caliper=0.003, replace=False).transform(views.binary(spark, sf)))


def _cem_sql(strata: str, extra: str = "", keep: bool = False) -> str:
    kept = "" if keep else "WHERE nt > 0 AND nc > 0"
    return f"""WITH {views.BINARY}{extra}, s AS (SELECT row_id, t, {strata} AS s FROM v_bin{", q" if "q.q" in strata else ""}),
n AS (SELECT s, count(*) FILTER (t = 1) AS nt, count(*) FILTER (t = 0) AS nc, min(row_id) AS first FROM s GROUP BY s), k AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS stratum FROM n {kept})
SELECT s.row_id, CAST(k.stratum AS BIGINT) AS stratum, round(CASE WHEN t = 0 AND nt > 0 AND nc > 0 THEN CAST(nt AS DOUBLE) / nc ELSE 1 END, 6) AS weight FROM s JOIN k ON k.s = s.s"""


_QUANT = ", q AS (SELECT list_distinct(quantile_cont(x0, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS q FROM v_bin)"


def _cem(matcher, df):
    return matcher.transform(df).select("row_id", "stratum", rounded("weight").alias("weight"))


@query(_cem_sql("len(list_filter(list_sort(q.q)[2:len(q.q) - 1], lambda e: e <= x0)) || '|' || seg", _QUANT))
def cem_quantile(spark, sf):
    return _cem(m.CoarsenedExactMatcher(("x0", "seg")), views.binary(spark, sf))


@query(_cem_sql("len(list_filter([q.q[1] + (q.q[2] - q.q[1]) * 0.2e0, q.q[1] + (q.q[2] - q.q[1]) * 0.4e0, q.q[1] + (q.q[2] - q.q[1]) * 0.6e0, q.q[1] + (q.q[2] - q.q[1]) * 0.8e0], lambda e: e <= x1)) || '|' || status", ", q AS (SELECT [min(x1), max(x1)] AS q FROM v_bin)"))
def cem_uniform(spark, sf):
    return _cem(m.CoarsenedExactMatcher(("x1", "status"), binning="uniform"), views.binary(spark, sf))


@query(_cem_sql("seg || '|' || status"))
def cem_categorical(spark, sf):
    return _cem(m.CoarsenedExactMatcher(("seg", "status")), views.binary(spark, sf))


@query(_cem_sql("CASE WHEN status IN (SELECT status FROM f) THEN status ELSE '__rare__' END", ", f AS (SELECT status FROM v_bin GROUP BY status HAVING count(*) >= 0.33e0 * (SELECT count(*) FROM v_bin))"))
def cem_rare(spark, sf):
    return _cem(m.CoarsenedExactMatcher(("status",), rare_threshold=0.33), views.binary(spark, sf))


@query(_cem_sql("CAST(row_id % 5000 AS VARCHAR)", keep=True))
def cem_keep_unmatched(spark, sf):
    df = views.binary(spark, sf).withColumn("key", (F.col("row_id") % 5000).cast("string"))
    return _cem(m.CoarsenedExactMatcher(("key",), drop_unmatched=False), df)


# ---------------------------------------------------------------- learners

_OOF = """o AS (SELECT seg, status, fold, coalesce(sum(y) FILTER (t = 1), 0) AS s1, count(*) FILTER (t = 1) AS n1, coalesce(sum(y) FILTER (t = 0), 0) AS s0, count(*) FILTER (t = 0) AS n0, sum(y) AS s, count(*) AS n FROM v_bin GROUP BY seg, status, fold),
tt AS (SELECT seg, status, sum(s1) AS s1, sum(n1) AS n1, sum(s0) AS s0, sum(n0) AS n0, sum(s) AS s, sum(n) AS n FROM o GROUP BY seg, status),
mu AS (SELECT o.seg, o.status, o.fold, (tt.s1 - o.s1) / (tt.n1 - o.n1) AS m1, (tt.s0 - o.s0) / (tt.n0 - o.n0) AS m0, (tt.s - o.s) / (tt.n - o.n) AS mm FROM o JOIN tt ON tt.seg = o.seg AND tt.status = o.status),
e AS (SELECT avg(CAST(t AS DOUBLE)) AS e FROM v_bin),
z AS (SELECT v_bin.*, m1, m0, mm, e FROM v_bin JOIN mu ON mu.seg = v_bin.seg AND mu.status = v_bin.status AND mu.fold = v_bin.fold, e)"""
_LINE = "SELECT row_id, round((SELECT regr_intercept({0}, x0) FROM z) + (SELECT regr_slope({0}, x0) FROM z) * x0, 6) + 0e0 AS uplift FROM z"
STRATA = StrataMean(("seg", "status"))


def _frame(spark, sf) -> CausalFrame:
    return CausalFrame(views.binary(spark, sf), ("x0",))


def _uplift(model, frame: CausalFrame) -> DataFrame:
    return model.fit(frame).predict(frame.df).select("row_id", rounded("uplift").alias("uplift"))


@query(f"WITH {PAIRS_BIN} SELECT row_id, round(u, 6) + 0e0 AS uplift FROM p")
def t_learner(spark, sf):
    return _uplift(TLearner(model=OLS()), _frame(spark, sf))


@query(f"WITH {views.BINARY}, s AS (SELECT covar_pop(t, t) AS tt, covar_pop(x0, x0) AS xx, covar_pop(t, x0) AS tx, covar_pop(t, y) AS ty, covar_pop(x0, y) AS xy FROM v_bin) SELECT row_id, round((ty * xx - xy * tx) / (tt * xx - tx * tx), 6) + 0e0 AS uplift FROM v_bin, s")
def s_learner(spark, sf):
    return _uplift(SLearner(model=OLS()), _frame(spark, sf))


_IPW = f"""{views.BINARY}, o AS (SELECT seg, fold, CAST(sum(t) AS DOUBLE) AS s, count(*) AS n FROM v_bin GROUP BY seg, fold), tt AS (SELECT seg, sum(s) AS s, sum(n) AS n FROM o GROUP BY seg),
z AS (SELECT v_bin.*, greatest(0.001e0, least(0.999e0, (tt.s - o.s) / (tt.n - o.n))) AS e FROM v_bin JOIN o ON o.seg = v_bin.seg AND o.fold = v_bin.fold JOIN tt ON tt.seg = o.seg)"""


@query(f"WITH {_IPW} SELECT row_id, round(e, 6) AS e FROM z")
def oof_propensity(spark, sf):
    df = Propensity(StrataMean(("seg",))).crossfit(views.binary(spark, sf), [], [0, 1], "fold", "gps")
    return df.select("row_id", rounded(F.element_at("gps", 2)).alias("e"))


@query(f"""WITH {_IPW}, w AS (SELECT *, CASE WHEN t = 1 THEN 1 / e ELSE 1 / greatest(0.001e0, least(0.999e0, 1 - e)) END AS w FROM z), a AS (SELECT t, sum(w * x0) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY t),
b AS (SELECT w.t, sum(w * (x0 - mx) * (y - my)) / sum(w * (x0 - mx) * (x0 - mx)) AS b FROM w JOIN a ON a.t = w.t GROUP BY w.t), l AS (SELECT a.t, b, my - b * mx AS a FROM a JOIN b ON b.t = a.t)
SELECT row_id, round((k.a + k.b * x0) - (c.a + c.b * x0), 6) + 0e0 AS uplift FROM v_bin JOIN l k ON k.t = 1 JOIN l c ON c.t = 0""")
def t_learner_ipw(spark, sf):
    return _uplift(TLearner(model=OLS(), propensity=Propensity(StrataMean(("seg",))), fold="fold"), _frame(spark, sf))


@query(f"""WITH {views.BINARY}, {_OOF}, l0 AS (SELECT regr_slope(m1 - y, x0) AS b, regr_intercept(m1 - y, x0) AS a FROM z WHERE t = 0), l1 AS (SELECT regr_slope(y - m0, x0) AS b, regr_intercept(y - m0, x0) AS a FROM z WHERE t = 1)
SELECT row_id, round(e * (l0.a + l0.b * x0) + (1 - e) * (l1.a + l1.b * x0), 6) + 0e0 AS uplift FROM z, l0, l1""")
def x_learner(spark, sf):
    return _uplift(XLearner(model=STRATA, effect_model=OLS(), fold="fold"), _frame(spark, sf))


@query(f"WITH {views.BINARY}, {_OOF} {_LINE.format('t * y / e - (1 - t) * y / (1 - e)')}")
def z_learner(spark, sf):
    return _uplift(ZLearner(effect_model=OLS(), fold="fold"), _frame(spark, sf))


@query(f"WITH {views.BINARY}, {_OOF} {_LINE.format('(m1 - m0 + CASE WHEN t = 1 THEN (y - m1) / e ELSE 0 END - CASE WHEN t = 0 THEN (y - m0) / (1 - e) ELSE 0 END)')}")
def dr_learner(spark, sf):
    return _uplift(DRLearner(outcome_model=STRATA, effect_model=OLS(), fold="fold"), _frame(spark, sf))


@query(f"""WITH {views.BINARY}, {_OOF}, r AS (SELECT *, (t - e) * (t - e) AS w, (y - mm) / (t - e) AS g FROM z), a AS (SELECT sum(w * x0) / sum(w) AS mx, sum(w * g) / sum(w) AS mg FROM r),
b AS (SELECT sum(w * (x0 - mx) * (g - mg)) / sum(w * (x0 - mx) * (x0 - mx)) AS b FROM r, a) SELECT row_id, round(mg + b * (x0 - mx), 6) + 0e0 AS uplift FROM v_bin, a, b""")
def r_learner(spark, sf):
    return _uplift(RLearner(outcome_model=STRATA, effect_model=OLS(), fold="fold"), _frame(spark, sf))


# ---------------------------------------------------------------- policies


@query(f"WITH {PAIRS_BIN}, r AS (SELECT row_id, row_number() OVER (ORDER BY u DESC, row_id DESC) AS r FROM p) SELECT row_id, CASE WHEN r <= 1000 THEN 1 ELSE 0 END AS chosen FROM r")
def policy_topk(spark, sf):
    return curves.top_mask(scored(views.binary(spark, sf)), "uplift", 1000).select("row_id", "chosen")


@query(f"WITH {PAIRS_BIN}, r AS (SELECT row_id, row_number() OVER (ORDER BY u DESC, row_id DESC) AS r, count(*) OVER () AS n FROM p) SELECT row_id, CASE WHEN r <= round_even(n * 0.1, 0) THEN 1 ELSE 0 END AS chosen FROM r")
def policy_budget(spark, sf):
    df = scored(views.binary(spark, sf))
    return curves.top_mask(df, "uplift", curves.budget_size(df.count(), budget=0.1)).select("row_id", "chosen")


# ---------------------------------------------------------------- trees


def _divergence_sql(kind: str, p: str, q: str) -> str:
    if kind == "ed":
        return f"2 * ({p} - {q}) * ({p} - {q})"
    p, q = (f"greatest(1e-6, least(1 - 1e-6, {x}))" for x in (p, q))
    if kind == "kl":
        return f"{p} * ln({p} / {q}) + (1 - {p}) * ln((1 - {p}) / (1 - {q}))"
    return f"({p} - {q}) * ({p} - {q}) / {q} + ({p} - {q}) * ({p} - {q}) / (1 - {q})"


def _stump_sql(kind: str) -> str:
    return f"""WITH {views.LABELLED}, c AS (SELECT DISTINCT unnest(quantile_cont(x0, list_transform(range(1, 33), lambda i: i / 33e0))) AS c FROM v_lab),
s AS (SELECT c, x0 <= c AS l, count(*) AS n, count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0, coalesce(avg(y) FILTER (t = 1), 0) AS p, coalesce(avg(y) FILTER (t = 0), 0) AS q FROM v_lab, c GROUP BY c, x0 <= c),
g AS (SELECT c, sum(n * ({_divergence_sql(kind, "p", "q")})) / sum(n) AS gain FROM s GROUP BY c HAVING count(*) = 2 AND min(n) >= 40 AND min(n1) >= 5 AND min(n0) >= 5),
b AS (SELECT arg_min(c, struct_pack(g := -round(gain, 12), c := c)) AS c FROM g),
k AS (SELECT x0 <= c AS l, coalesce(avg(y) FILTER (t = 1), 0) - coalesce(avg(y) FILTER (t = 0), 0) AS u FROM v_lab, b GROUP BY 1)
SELECT row_id, round(u, 6) + 0e0 AS uplift FROM v_lab JOIN b ON TRUE JOIN k ON k.l = (x0 <= b.c)"""


def _stump(kind: str):
    def run(spark, sf):
        frame = CausalFrame(views.labelled(spark, sf), ("x0",))
        return _uplift(UpliftTree(max_depth=1, min_samples_leaf=40, min_samples_treatment=5, criterion=kind, min_gain=-1e9), frame)

    return run


for _kind in ("kl", "ed", "chi"):
    query(_stump_sql(_kind), f"uplift_stump_{_kind}")(_stump(_kind))


@query()
def uplift_tree(spark, sf):
    frame = CausalFrame(views.multi(spark, sf).withColumn("y", (F.col("y") > 1.5).cast("double")), XS)
    return UpliftTree(max_depth=2).fit(frame).predict(frame.df).select("row_id", "uplift")


@query()
def causal_forest(spark, sf):
    frame = CausalFrame(views.binary(spark, sf), XS)
    return CausalForest(n_estimators=16, max_features=None).fit(frame).predict(frame.df).select("row_id", "uplift")


@query()
def policy_forest(spark, sf):
    frame = CausalFrame(views.binary(spark, sf), XS)
    return PolicyForest(n_estimators=16, max_features=None).fit(frame).assign(frame.df, budget=0.2).select("row_id", "uplift", "assigned")


