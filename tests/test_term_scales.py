"""Scales of several terms of all pairs: counted along mass slices, no pair is kept."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from specmatch import plan_queries  # noqa: F401  registers its queries
from specmatch.operators import stats, windows
from specmatch.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["anchor_scales", "weighted_loglik"])
def test_scales_need_no_pairs(spark, name, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("scales from a table of pairs")

    monkeypatch.setattr(stats, "mad_scales", refuse)
    monkeypatch.setattr(stats, "quantiles", refuse)
    assert not differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name])


@pytest.mark.parametrize("q", [0.5, 0.2, 0.0, 1.0])
@pytest.mark.parametrize("most", [1_000_000, 3])
def test_quantiles_of_terms(spark, q, most):
    """Ties, unknown values, a far outlier beyond any guess, and brackets that are narrowed."""
    rng = np.random.default_rng(2)
    mz = 200 + rng.random((2, 300)) * 0.05
    rt, kind = rng.normal(size=(2, 300)) ** 3, rng.integers(0, 4, (2, 300)) / 10
    rt[1, 5] = 1e7
    rt[0, :20] = np.nan
    fit = rng.normal(size=300)
    rows = [[(k, float(m), None if np.isnan(r) else float(r), float(n), float(f)) for k, (m, r, n, f) in enumerate(zip(mz[s], rt[s], kind[s], fit))] for s in (0, 1)]
    left = spark.createDataFrame(rows[0], "id1 long, mz1 double, rt1 double, int1 double, fit_rt double").withColumns({"fit_int": F.lit(0.25), "fit_ppm": F.col("fit_rt")})
    right = spark.createDataFrame([r[:4] for r in rows[1]], "id2 long, mz2 double, rt2 double, int2 double")
    near = np.abs(mz[1][None] - mz[0][:, None]) <= mz[0][:, None] * 20 / 1e6
    ppm = (mz[1][None] - mz[0][:, None]) / ((mz[0][:, None] + mz[1][None]) / 2) * 1e6
    all_ = {"rt": rt[1][None] - rt[0][:, None] - fit[:, None], "int": kind[1][None] - kind[0][:, None] - 0.25, "ppm": ppm - fit[:, None]}
    terms = {"rt": ("rt2", "rt1"), "int": ("int2", "int1"), "ppm": ("", "")}
    middle = {k: 0.1 for k in terms}
    for about in (None, middle):
        got = windows.term_quantiles(left, right, 20.0, terms, q, about, most)
        for k, v in all_.items():
            v = v[near & ~np.isnan(v)]
            assert got[k] == pytest.approx(np.quantile(v if about is None else np.abs(v - 0.1), q), rel=1e-12, abs=1e-12)
