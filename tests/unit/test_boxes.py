"""Searches and sums by boxes against brute force, with many small boxes and no blocks of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from liftloom.operators import boxes
from liftloom.operators import matching as m


@pytest.fixture
def rows(spark, monkeypatch):
    """(frame, treated ids, controls' ids, their vectors): ties, copies and a null; boxes of 40 controls."""
    monkeypatch.setattr(boxes, "POINTS", 40)

    def refuse(*_):
        raise AssertionError("all pairs of blocks")

    monkeypatch.setattr(m.BlockBackend, "blocks", refuse)
    rng = np.random.default_rng(5)
    x = np.stack([np.round(rng.normal(size=700), 2), rng.integers(0, 9, 700) / 9], 1)
    x[:60] = x[60:120]
    x[300:340] = [0.5, 0]
    t = rng.integers(0, 2, 700)
    data = [(i, int(t[i]), float(x[i, 0]), float(x[i, 1])) for i in range(700)] + [(700, 1, None, 1.0)]
    a, b = np.flatnonzero(t == 1), np.flatnonzero(t == 0)
    return spark.createDataFrame(data, "row_id long, t int, a double, b double"), a, b, x[a], x[b]


def brute(d, a, b, k, limit=np.inf):
    return {(int(a[i]), int(b[j])) for i in range(len(a)) for j in np.lexsort((b, d[i]))[:k] if d[i, j] <= limit}


def got(edges):
    return {(r.treated, r.control) for r in edges.collect()}


def euclid(x, y):
    return np.sqrt((x[:, None, 0] - y[None, :, 0]) ** 2 + (x[:, None, 1] - y[None, :, 1]) ** 2)


def weights(matcher, df):
    return {r.row_id: r.weight for r in matcher.transform(df).collect()}


def expected(w, a, b):
    """Weights of matched rows by a matrix of kernel values."""
    share = w / np.where(w.sum(1) > 0, w.sum(1), 1)[:, None]
    return {int(i): 1.0 for i in a[w.sum(1) > 0]} | {int(j): s for j, s in zip(b, share.sum(0), strict=True) if s > 0}


def test_nearest_euclid(rows):
    df, a, b, x, y = rows
    assert got(m.NearestNeighborMatcher(("a", "b"), n_neighbors=2).edges(df)) == brute(euclid(x, y), a, b, 2)


def test_nearest_within_caliper(rows):
    df, a, b, x, y = rows
    assert got(m.NearestNeighborMatcher(("a", "b"), n_neighbors=2, caliper=0.02).edges(df)) == brute(euclid(x, y), a, b, 2, 0.02)


def test_nearest_cosine(rows):
    """A zero vector is at distance 1 from all; rounding decides between equal directions, so distances are compared."""
    df, a, b, x, y = rows
    df = df.where("row_id < 700").unionByName(df.sparkSession.createDataFrame([(701, 1, 0.0, 0.0), (702, 0, 0.0, 0.0)], df.schema))
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
    d = 1 - np.divide(x @ y.T, norm, out=np.zeros_like(norm), where=norm > 0)
    found = {r.treated: r.d for r in m.NearestNeighborMatcher(("a", "b"), metric="cosine").edges(df).collect()}
    assert found == pytest.approx({int(i): v for i, v in zip(a, np.minimum(d.min(1), 1.0), strict=True)} | {701: 1.0}, abs=1e-12)


def test_nearest_manhattan(rows):
    df, a, b, x, y = rows
    d = np.abs(x[:, None, 0] - y[None, :, 0]) + np.abs(x[:, None, 1] - y[None, :, 1])
    assert got(m.NearestNeighborMatcher(("a", "b"), n_neighbors=3, metric="manhattan").edges(df)) == brute(d, a, b, 3)


def test_nearest_mahalanobis(rows):
    df, a, b, x, y = rows
    df = df.where("row_id < 700")
    w = m.whitening(np.cov(np.concatenate([x, y]).T), 1e-6)
    found = {r.treated: r.d for r in m.MahalanobisMatcher(("a", "b")).edges(df).collect()}
    assert found == pytest.approx(dict(zip(a.tolist(), euclid(x @ w, y @ w).min(1), strict=True)), abs=1e-9)


def test_radius_weights(rows):
    df, a, b, x, y = rows
    want = expected((euclid(x, y) <= 0.05).astype(float), a, b)
    assert weights(m.NearestNeighborMatcher(("a", "b"), radius=0.05), df) == pytest.approx(want)


def test_kernel_auto_bandwidth(rows, monkeypatch):
    df, a, b, x, y = rows
    d = euclid(x, y)
    w = np.zeros_like(d)
    for i in range(len(a)):
        w[i, np.lexsort((b, d[i]))[:10]] = 1
    near = d[w > 0]
    h = np.median(near[near > 0])
    assert weights(m.KernelMatcher(("a", "b"), candidate_mode="knn", n_neighbors=10), df) == pytest.approx(expected(np.exp(-((d / h) ** 2) / 2) * w, a, b))


@pytest.mark.parametrize("n", [1, 4, 7, 150_001, 150_002])
def test_exact_median(spark, n):
    df = spark.range(n).selectExpr("cast(pmod(id * 7919, 100003) as double) / 1000 as d")
    values = (np.arange(n) * 7919 % 100003) / 1000
    want = np.median(values[values > 0]) if (values > 0).any() else None
    assert m.median_above(df, "d") == (None if want is None else pytest.approx(want, rel=1e-14))


def test_kernel_gaussian(rows):
    df, a, b, x, y = rows
    for h in (0.05, 0.7):
        u = euclid(x, y) / h
        want = expected(np.exp(-u * u / 2), a, b)
        assert weights(m.KernelMatcher(("a", "b"), kernel="gaussian", bandwidth=h), df) == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_mahalanobis_within_propensity_caliper(rows):
    """The whole band of one propensity is searched without pairs as rows."""
    df, a, b, x, y = rows
    df = df.where("row_id < 700").selectExpr("*", "round(pmod(row_id * 37, 11) / 50, 9) as e")
    e = lambda ids: np.round(ids * 37 % 11 / 50, 9)
    both = np.concatenate([x, y])
    z = [(v - both.mean(0)) / (both.std(0) + 1e-12) for v in (x, y)]
    w = m.whitening(np.cov(np.concatenate(z).T), 1e-6)
    d = np.where(np.abs(e(a)[:, None] - e(b)[None, :]) <= 0.025, euclid(z[0] @ w, z[1] @ w), np.inf)
    edges = m.MahalanobisPSCaliperMatcher(("a", "b"), caliper=0.025).edges(df)
    assert "Join" not in edges._jdf.queryExecution().executedPlan().toString()
    assert {r.treated: r.d for r in edges.collect()} == pytest.approx(dict(zip(a.tolist(), d.min(1), strict=True)), abs=1e-9)


def test_kernel_epanechnikov(rows):
    df, a, b, x, y = rows
    for h in (0.05, 0.7):
        u = euclid(x, y) / h
        want = expected(np.where(u <= 1, 0.75 * (1 - u * u), 0), a, b)
        assert weights(m.KernelMatcher(("a", "b"), kernel="epanechnikov", bandwidth=h), df) == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_kernel_triangular(rows):
    df, a, b, x, y = rows
    for h in (0.05, 0.7):
        u = euclid(x, y) / h
        want = expected(np.where(u <= 1, 1 - u, 0), a, b)
        assert weights(m.KernelMatcher(("a", "b"), kernel="triangular", bandwidth=h), df) == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_kernel_uniform(rows):
    df, a, b, x, y = rows
    for h in (0.05, 0.7):
        u = euclid(x, y) / h
        want = expected(np.where(u <= 1, 1.0, 0), a, b)
        assert weights(m.KernelMatcher(("a", "b"), kernel="uniform", bandwidth=h), df) == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_lsh_searches_buckets_without_pairs(rows, monkeypatch):
    """The same edges as the nearest of all pairs of pyspark.ml's join."""
    from pyspark.ml.feature import BucketedRandomProjectionLSHModel

    df, a, b, x, y = rows
    lsh = m.LSHBackend(reach=0.2, bucket_length=0.1, tables=2)
    matcher = m.NearestNeighborMatcher(("a", "b"), n_neighbors=2, backend=lsh)
    df = df.where("row_id < 700")
    sides = matcher.side(df, 1, matcher.plain()), matcher.side(df, 0, matcher.plain())
    want = got(m.nearest(lsh.neighbors(*sides), 2))
    monkeypatch.setattr(BucketedRandomProjectionLSHModel, "approxSimilarityJoin", lambda *_: pytest.fail("pairs"))
    assert got(matcher.edges(df)) == want


def in_turn(d, a, b, k, limit=np.inf):
    """Treated rows in the order of ids each take their k nearest unused controls."""
    out, used = set(), np.zeros(len(b), bool)
    for i in np.argsort(a):
        for j in [j for j in np.lexsort((b, d[i])) if not used[j] and d[i, j] <= limit][:k]:
            used[j] = True
            out.add((int(a[i]), int(b[j])))
    return out


@pytest.mark.parametrize(("k", "caliper"), [(1, 0.003), (2, 0.05), (1, 0.5), (1, None)])
def test_without_replacement_makes_no_edges(rows, monkeypatch, k, caliper):
    df, a, b, x, y = rows
    monkeypatch.setattr(boxes.BoxBackend, "neighbors", lambda *_: pytest.fail("edges"))
    matcher = m.NearestNeighborMatcher(("a", "b"), n_neighbors=k, caliper=caliper, replace=False)
    assert got(matcher.edges(df)) == in_turn(euclid(x, y), a, b, k, np.inf if caliper is None else caliper)


def test_without_replacement_within_propensity_caliper(rows, monkeypatch):
    df, a, b, x, y = rows
    # no ties, which rounding of the whitened columns would settle
    df = df.where("row_id < 700").selectExpr("row_id", "t", "a + row_id * row_id * 1e-7 as a", "b", "round(pmod(row_id * 37, 11) / 50, 9) as e")
    x, y = (v + np.stack([i * i * 1e-7, 0 * i], 1) for v, i in ((x, a), (y, b)))
    monkeypatch.setattr(boxes.BoxBackend, "neighbors", lambda *_: pytest.fail("edges"))
    e = lambda ids: np.round(ids * 37 % 11 / 50, 9)
    both = np.concatenate([x, y])
    z = [(v - both.mean(0)) / (both.std(0) + 1e-12) for v in (x, y)]
    w = m.whitening(np.cov(np.concatenate(z).T), 1e-6)
    d = np.where(np.abs(e(a)[:, None] - e(b)[None, :]) <= 0.025, euclid(z[0] @ w, z[1] @ w), np.inf)
    edges = m.MahalanobisPSCaliperMatcher(("a", "b"), caliper=0.025, replace=False).edges(df)
    assert got(edges) == in_turn(d, a, b, 1, 1e9)


def test_components_of_long_path(spark, monkeypatch):
    """Few rounds on a path of labels in no order, and estimates of size that do not grow with them."""
    from liftloom.operators import components as c

    rounds, cut = [], c.cut
    monkeypatch.setattr(c, "cut", lambda df: (rounds.append(1), cut(df))[1])
    found = c.components(spark.range(3000).selectExpr("pmod(id * 7919, 3001) * 2 as a", "pmod(id * 7919 + 7919, 3001) * 2 as b"))
    assert [r["count"] for r in found.groupBy("component").count().collect()] == [3001]
    assert len(rounds) < 40
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200


@pytest.mark.parametrize("bucket_length", [0.01, 100.0])
def test_lsh_searches_once_where_nearest_share_buckets(rows, monkeypatch, bucket_length):
    """One search of all rows; only those whose nearest share no bucket are searched by tables."""
    df, a, b, x, y = rows
    lsh = m.LSHBackend(reach=0.2, bucket_length=bucket_length, tables=3)
    df = df.where("row_id < 700")
    matcher = m.NearestNeighborMatcher(("a", "b"), n_neighbors=2, backend=lsh)
    sides = matcher.side(df, 1, matcher.plain()), matcher.side(df, 0, matcher.plain())
    want = got(m.nearest(lsh.neighbors(*sides), 2))
    asked, search = [], m.LSHBackend._in_table
    monkeypatch.setattr(m.LSHBackend, "_in_table", staticmethod(lambda j, treated, *more: (asked.append(treated.count()), search(j, treated, *more))[1]))
    assert got(matcher.edges(df)) == want
    # buckets part at 0, so a few rows there share none even if buckets are wide
    assert all(0 < n < (len(a) if bucket_length < 1 else 10) for n in asked)
