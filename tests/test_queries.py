"""Every query with SQL against DuckDB, and invariants of the operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from specmatch import queries as q
from specmatch.functions import columns as C
from specmatch.operators import align, bandjoin, drift, transport
from specmatch.sources.views import pair
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert not differences(q.QUERIES[name](spark, SF), con, q.ORACLES[name])


def test_band_join_equals_nested_loop(spark):
    a, b = pair(spark, SF, True)
    theta = a.alias("a").crossJoin(b.alias("b")).where("b.mz BETWEEN a.mz - a.mz*20/1e6 AND a.mz + a.mz*20/1e6").selectExpr("a.id id1", "b.id id2")
    got = bandjoin.band_join(a, b, 20.0).select("id1", "id2")
    assert got.exceptAll(theta).isEmpty() and theta.exceptAll(got).isEmpty()


def test_unknown_retention_passes_the_gate(spark):
    s = "id long, mz double, rt double"
    got = bandjoin.band_join(spark.createDataFrame([(1, 100.0, None), (2, None, 1.0), (3, -5.0, 1.0)], s), spark.createDataFrame([(7, 100.001, 50.0)], s), 20.0, rt=1.0)
    assert [(r.id1, r.id2) for r in got.collect()] == [(1, 7)]


@pytest.mark.parametrize("tau", [(1.0, 1.0), (10 / 10.5, 0.5)])
def test_transport_back_ends_agree(spark, tau):
    from specmatch.session import cut

    e = cut(q.pruned(spark, SF))
    null = transport.null_loglik(e)
    s = transport.Sinkhorn(max_iter=11, tol=0.0, tau_row=tau[0], tau_col=tau[1])
    one, two = (x.select("id1", "id2", "ot_weight", "p_row_ot", "p0_ot").toPandas().sort_values(["id1", "id2"]) for x in (transport.sinkhorn(e, s, null), transport.sinkhorn_auto(e, s, null)))
    for c in ("ot_weight", "p_row_ot", "p0_ot"):
        np.testing.assert_allclose(one[c], two[c], rtol=1e-9)
    rows = two.groupby("id1").agg(p=("p_row_ot", "sum"), p0=("p0_ot", "first"))
    np.testing.assert_allclose(rows.p + rows.p0, 1, rtol=1e-9)


def test_huber_ignores_outliers(spark):
    rng = np.random.default_rng(0)
    x = np.linspace(0, 10, 200)
    y = 2 * x + 1 + rng.normal(0, 0.01, 200)
    y[::20] += 50
    rows = [(i, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    fit = drift.robust_linear(spark.createDataFrame(rows, "id1 long, id2 long, x double, y double"), "x", "y")
    assert abs(fit.slope - 2) < 0.01 and abs(fit.intercept - 1) < 0.05


def test_lowess_knots_interpolate(spark):
    x = np.linspace(0, 6, 80)
    knots = drift.lowess_knots(x, 3 * x + 2, 10)
    m = drift.Drift("lowess", knots=knots)
    got = [r[0] for r in spark.createDataFrame([(-1.0,), (1.234,), (9.0,)], "x double").select(m.at(F.col("x"))).collect()]
    np.testing.assert_allclose(got, [2, 3 * 1.234 + 2, 20], atol=1e-6)


def test_transfer_needs_anchors():
    from specmatch.plans.config import MatchConfig

    t = align.fit_transfer(np.arange(5.0), np.arange(5.0), MatchConfig())
    assert t.policy == "unknown" and math.isnan(t.inlier_frac) and align.soft_weight(t, MatchConfig()) == 0.25


def test_value_scale_is_not_told_by_collision_energy(spark):
    s, h = C.value_scale(F.col("x"))
    got = spark.createDataFrame([("The normalized collision energy; peak area",), ("LOESS normalized, imputed",), (None,)], "x string").select(s, h).collect()
    assert [tuple(r) for r in got] == [("raw_like", ""), ("normalized", "normalized|imputed"), ("unknown", "")]


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def _correlations(spark):
    """Dense |r| between all features of SF, by feature id; 0 on the diagonal and where no sample is shared."""
    from specmatch.sources.views import expression

    x = expression(spark, SF).toPandas().astype(float)
    z = x.pivot(index="feature_id", columns="sample_id", values="v")
    sd = z.std(axis=1, ddof=1)
    z = z.sub(z.mean(axis=1), axis=0).div(sd.where(sd > 1e-8, 1.0), axis=0)
    shared = z.notna().to_numpy(float)
    r = np.abs(z.fillna(0).to_numpy() @ z.fillna(0).to_numpy().T) / (z.shape[1] - 1)
    r[(shared @ shared.T == 0) | np.eye(len(z), dtype=bool)] = 0
    return z.index.to_numpy().astype(int), r


def test_graphs_cover_every_feature(spark):
    ids, r = _correlations(spark)
    assert ids.max() > 120
    got = q.QUERIES["corr_knn"](spark, SF).toPandas().sort_values(["i", "n"])
    assert set(got.i) == set(ids)
    for k, i in enumerate(ids):
        np.testing.assert_allclose(got[got.i == i].r / 1e6, np.sort(r[k])[::-1][:5], atol=1.1e-6)
    bonus = q.QUERIES["structure_bonus"](spark, SF).toPandas()
    d = np.abs(ids[:, None] - ids[None])
    g, p = np.where(r > 0.05, r, 0), np.where(d <= 2, 1 / (1 + d), 0)
    at = {i: k for k, i in enumerate(ids)}
    want = g @ p @ g.T
    assert len(bonus) == (d <= 2).sum()
    np.testing.assert_allclose(bonus.bonus / 1e6, [want[at[a], at[b]] for a, b in zip(bonus.id1, bonus.id2)], atol=1.1e-6)


def test_stable_graph_covers_every_feature(spark):
    stable = q.QUERIES["stable_graph"](spark, SF).toPandas()
    assert stable.i.max() > 120 and stable.j.max() > 120 and stable.n.between(3, 5).all()


def test_components_cover_every_edge(spark):
    pairs = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()
    near: dict[int, set[int]] = {}
    for r in pairs:
        near.setdefault(2 * r.l_suppkey, set()).add(2 * r.l_partkey + 1)
        near.setdefault(2 * r.l_partkey + 1, set()).add(2 * r.l_suppkey)
    parts, left = [], set(near)
    while left:
        c, queue = set(), [min(left)]
        while queue:
            if (n := queue.pop()) not in c:
                c.add(n)
                queue += near[n] - c
        parts.append((min(c), c))
        left -= c
    got = {r.node: r.component for r in q.QUERIES["connected_components"](spark, SF).collect()}
    assert got == {n: least for least, c in parts for n in c}
    picked = {(r.component, r.study, r.node) for r in q.QUERIES["component_pick"](spark, SF).collect()}
    assert picked == {(least, k, min((n for n in c if n % 2 == k), key=lambda n: (-len(near[n]), n))) for least, c in parts for k in (0, 1)}


def test_cluster_table_covers_every_feature(spark):
    from specmatch.sources.views import expression

    want: dict = {}
    for r in expression(spark, SF).collect():
        at = (r.sample_id, r.feature_id % 100)
        want[at] = max(want.get(at, 0), math.floor(float(r.v) * 1e6 + 0.5))
    assert {(r.sample_id, r.cluster_id): r.v for r in q.QUERIES["cluster_expr_long"](spark, SF).collect()} == want


def test_lowess_uses_every_anchor(spark):
    rng = np.random.default_rng(4)
    x = np.sort(np.round(rng.uniform(0, 50, 3000), 2))
    y = np.sin(x / 4) + rng.normal(0, 0.2, 3000)
    frac = max(10 / 3000, 0.1)
    at = np.unique(x)
    want = []
    for a in at:
        d = np.abs(x - a)
        w = np.clip(1 - (d / np.quantile(d, frac)) ** 3, 0, None) ** 3
        slope, icept = np.polyfit(x - a, y, 1, w=np.sqrt(w))
        want.append(icept)
    df = spark.createDataFrame([(i, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id1 long, id2 long, x double, y double")
    for local in (10, 20_000):
        xs, ys = drift.lowess_curve(df, "x", "y", 10, local)
        np.testing.assert_array_equal(xs, at)
        np.testing.assert_allclose(ys, want, atol=1e-8)
    knots = np.array(drift.lowess(df, "x", "y", 10, most=100).knots)
    assert len(knots) < len(at)
    np.testing.assert_allclose(np.interp(at, *knots.T), want, atol=1.1e-6 * np.ptp(want))
