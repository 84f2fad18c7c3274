"""Mass windows against the pairs themselves, and exact quantiles by counting."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specmatch.functions import columns as C
from specmatch.operators import bandjoin, decide, stats, transport, windows

LINE = (0.4, -0.002)


@pytest.fixture(scope="module")
def sides(spark):
    """Masses drawn with repeats, some equal in both; unknown masses and retentions; ids in another order than masses."""
    rng = np.random.default_rng(5)
    grid = 200.0 + np.sort(rng.random(400)) * 0.2

    def side(n):
        rows = [(int(i), float(rng.choice(grid)) if i % 31 else None, float(rng.integers(0, 5)) if i % 13 else None) for i in rng.permutation(n)]
        return spark.createDataFrame([*rows, (n, -1.0, 0.0)], "id long, mz double, rt double").repartition(3)

    return side(500), side(400)


@pytest.fixture(scope="module")
def edges(sides):
    e = bandjoin.band_join(*sides, 20.0)
    return e.withColumn("resid", C.ppm_over_mean(F.col("mz1"), F.col("mz2")) - (F.lit(LINE[0]) + F.lit(LINE[1]) * F.col("mz1"))).cache()


@pytest.mark.parametrize("rt", [0.0, 1.0])
def test_nearest_is_the_first_of_all_pairs(sides, rt, monkeypatch):
    monkeypatch.setattr(windows, "SHARE", 50)
    want = {}
    for r in bandjoin.band_join(*sides, 20.0, rt).collect():
        d = abs((r.mz2 - r.mz1) / ((r.mz1 + r.mz2) / 2) * 1e6)
        key = (d, abs(r.rt2 - r.rt1) if None not in (r.rt1, r.rt2) else float("inf"), r.mz2, r.id2)
        want[r.id1] = min(want.get(r.id1, key), key)
    got = bandjoin.nearest(*sides, 20.0, rt)
    assert len(want) > 400 and {r.id1: r.id2 for r in got.collect()} == {k: v[3] for k, v in want.items()}
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "SortMergeJoin [_bin" not in plan  # the pairs are neither made nor sorted


@pytest.mark.parametrize("q", [0.2, 1.0])
@pytest.mark.parametrize("most", [50, 100_000])
def test_quantiles_of_residuals_are_exact(sides, edges, q, most):
    x = np.array([r.resid for r in edges.select("resid").collect()])
    assert windows.quantile(*sides, 20.0, LINE, q, None, most) == pytest.approx(np.quantile(x, q), abs=1e-12)
    assert windows.quantile(*sides, 20.0, LINE, q, 1.5, most) == pytest.approx(np.quantile(np.abs(x - 1.5), q), abs=1e-12)


@pytest.mark.parametrize("k", [3, 100_000])
def test_best_equals_top_k_of_all_pairs(sides, edges, k):
    scored = edges.withColumn("ll", C.student_t(F.col("resid"), 12.5, 3.0))
    want = {(r.id1, r.id2): r.ll for r in transport.top_k(scored, k).collect()}
    got = {(r.id1, r.id2): r.ll for r in windows.best(*sides, 20.0, LINE, 12.5, 3.0, k).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


@pytest.mark.parametrize("most", [1, 1_000_000])
def test_quantiles_by_counting(spark, most):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1e-8, 300), rng.normal(5, 3, 300), np.full(200, -2.0), [1e300, -1e300]])
    rows = [(float(v), float(i % 7), None) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (None, None, None)], "x double, y double, z double")
    for q in (0.2, 0.77):
        got = stats.quantiles(df, {c: F.col(c) for c in "xyz"}, q, most)
        assert got["x"] == pytest.approx(np.quantile(x, q), rel=1e-12) and got["y"] == np.quantile(np.arange(len(x)) % 7, q) and got["z"] is None


def test_scales_by_counting(spark):
    df = spark.createDataFrame([(1.0, 7.0, None), (1.0, 7.0, None), (1.0, 7.0, None), (9.0, 7.0, None)], "x double, y double, z double")
    want = df.select(F.stddev_pop("x")).first()[0]
    assert stats.mad_scales(df, {c: F.col(c) for c in "xyz"}) == {"x": pytest.approx(want), "y": 1e-3, "z": 1e-3}


def test_no_pairs(spark, sides):
    far = spark.createDataFrame([(1, 900.0, 1.0)], "id long, mz double, rt double")
    assert bandjoin.nearest(sides[0], far, 20.0).isEmpty() and windows.quantile(sides[0], far, 20.0, LINE, 0.5) is None
    assert windows.best(sides[0], far, 20.0, LINE, 1.0, 3.0, 2).isEmpty() and windows.mad_scale(sides[0], far, 20.0, LINE) == 1e-3


def test_lines_of_many_points_are_as_exact_as_of_few(spark):
    rng = np.random.default_rng(8)
    x = 200 + rng.random(100_000) * 8
    y = 1e-3 * x + rng.normal(0, 12, len(x))
    xs, ys = ([Fraction(v) for v in c.tolist()] for c in (x, y))
    n, sx, sy = len(xs), sum(xs), sum(ys)
    slope = (sum(a * b for a, b in zip(xs, ys, strict=True)) - sx * sy / n) / (sum(a * a for a in xs) - sx * sx / n)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    for parts in (1, 5):
        got = stats.ols(df.repartition(parts), "x", "y").first()
        assert got.n == n and abs(Fraction(got.slope) / slope - 1) < 2e-15
        assert abs(Fraction(got.intercept) - (sy / n - slope * sx / n)) < 1e-15 * abs(slope) * 204


def test_lines_of_few_or_equal_points(spark):
    df = spark.createDataFrame([(1.0, 3.0, 1.0, None), (1.0, 5.0, None, 2.0), (1.0, 4.0, None, None)], "x double, y double, u double, v double")
    got = stats.lines(df, {"a": ("x", "y"), "b": ("u", "y"), "c": ("u", "v")}).first().asDict()
    assert got == {"rows": 3, "an": 3, "aslope": 0.0, "aintercept": 4.0, "bn": 1, "bslope": 0.0, "bintercept": 0.0, "cn": 0, "cslope": 0.0, "cintercept": 0.0}


def test_a_scaling_is_computed_once(spark, monkeypatch):
    joins, cut = [], transport.cut
    monkeypatch.setattr(transport, "cut", lambda df: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or cut(df))
    rng = np.random.default_rng(3)
    e = spark.createDataFrame(pd.DataFrame({"id1": rng.integers(0, 30, 200), "id2": rng.integers(0, 40, 200), "ll": rng.normal(0, 2, 200)}).drop_duplicates(["id1", "id2"]))
    for s in (transport.Sinkhorn(max_iter=3, tau_row=10 / 10.5, tau_col=0.5), transport.Sinkhorn(max_iter=12)):
        got = {(r.id1, r.id2): r.ot_weight for r in transport.sinkhorn(e, s, -2.0).collect()}
        want = {(r.id1, r.id2): r.ot_weight for r in transport.sinkhorn_auto(e, s, -2.0).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert max(joins) == 1  # what is written never holds the scalings before it


@pytest.mark.parametrize("temperature", [1.0, 0.5])
def test_rows_of_lists_say_what_edges_say(sides, temperature, monkeypatch):
    """Softmax and entropy of ranked rows: the edges' doubles, without an exchange behind the cells."""
    monkeypatch.setattr(windows, "SHARE", 50)
    rows = transport.ranked_softmax(windows.ranked(*sides, 20.0, LINE, 12.5, 3.0, 7), -4.0, temperature)
    edges = transport.row_softmax(windows.best(*sides, 20.0, LINE, 12.5, 3.0, 7), -4.0, temperature)
    seen = lambda e: {(r.id1, r.id2, r.mz2): (r.ll, r.p_row, r.p0) for r in e.collect()}
    assert len(want := seen(edges)) > 2000 and seen(windows.each(rows, "id2", "mz2", "ll", "p_row")) == want
    entropy = {r.id1: r.entropy for r in transport.row_entropy(edges).collect()}
    assert {r.id1: r.entropy for r in transport.ranked_entropy(rows).collect()} == pytest.approx(entropy)
    assert all(list(r.p_row) == sorted(r.p_row, reverse=True) for r in rows.collect())


def test_best_of_a_row_of_lists(spark):
    """Equal probabilities go by mass, then id, whatever the order of their scores; a row may have one candidate."""
    tie = [(1, 9, 5.0, 0.25), (1, 8, 4.0, 0.25), (1, 7, 4.0, 0.25), (1, 6, 3.0, 0.125), (2, 5, 1.0, 0.5)]
    edges = spark.createDataFrame(tie, "id1 long, id2 long, mz2 double, p_row double")
    rows = spark.createDataFrame([(k, *[[x[c] for x in tie if x[0] == k] for c in (1, 2, 3)], 0.1) for k in (1, 2)], "id1 long, id2 array<long>, mz2 array<double>, p_row array<double>, p0 double")
    got = decide.ranked_top2(rows)
    assert sorted(got.select("id1", "id2", "p1", "margin").collect()) == sorted(decide.top2(edges, "p_row").select("id1", "id2", "p1", "margin").collect()) == [(1, 7, 0.25, 0.0), (2, 5, 0.5, 0.5)]
    assert sorted(got.select("id1", "p_null", "n_candidates").collect()) == [(1, 0.1, 4), (2, 0.1, 1)]
    top = decide.decided(spark.range(1, 4).withColumnRenamed("id", "id1"), got, "null_ot", 0.0, "n_candidates")
    assert sorted((r.id1, r.id2, r.decision, r.n_candidates) for r in top.collect()) == [(1, 7, "match", 4), (2, 5, "match", 1), (3, -1, "no_candidate", None)]
