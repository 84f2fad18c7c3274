"""Structure: bonus modes, row trust and rank correlation against dense arithmetic; the refinement loop on a swapped pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from specmatch.operators import structure
from specmatch.plans.config import MatchConfig
from specmatch.plans.match import match_features


def graph(spark, w):
    return spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "i long, j long, w double")


@pytest.mark.parametrize("mode", ["mass", "logmass", "gw"])
def test_bonus_equals_dense_product(spark, mode):
    rng = np.random.default_rng(1)
    w1, w2 = (rng.random((4, 4)) * (1 - np.eye(4)) for _ in range(2))
    w1[3] = 0
    p = rng.random((4, 4)) * 0.25
    edges = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(4) for j in range(4)], "id1 long, id2 long, p_row_ot double")
    ids = spark.range(4)
    got = structure.structure_bonus(edges, graph(spark, w1), graph(spark, w2), mode=mode, ids1=ids, ids2=ids)
    cross = w1 @ p @ w2.T
    q1, q2 = (w1**2).sum(1), (w2**2).sum(1)
    gw = -(q1[:, None] + q2[None] - 2 * cross) / (0.5 * (np.median(q1) + np.median(q2)))
    want = {"mass": cross, "logmass": np.log(cross + 1e-8), "gw": gw}[mode]
    for r in got.collect():
        assert r.struct_bonus == pytest.approx(want[r.id1, r.id2])


def test_trust_falls_with_the_lead(spark):
    e = spark.createDataFrame([(0, 0, 0.7), (0, 1, 0.3), (0, 2, 0.1), (1, 0, 0.5)], "id1 long, id2 long, p_row_ot double")
    got = {r.id1: r._trust for r in structure.adaptive_weight(e, 0.2, 2.0).collect()}
    assert got[0] == pytest.approx((1 / 3) ** 2) and got[1] == pytest.approx((1 / 3.5) ** 2)


def test_ranks_are_averages(spark):
    x = [(s, 0, v) for s, v in enumerate([3.0, 1.0, 3.0, 7.0])]
    got = {r.sample_id: r.v for r in structure.ranked(spark.createDataFrame(x, "sample_id long, feature_id long, v double")).collect()}
    assert got == {0: 2.5, 1: 1.0, 2: 2.5, 3: 4.0}


@pytest.mark.parametrize("more", [{}, {"structure_bonus_mode": "gw", "structure_corr": "spearman"}, {"structure_anneal": True, "structure_iters": 3, "structure_ot_epsilon_mult_start": 2.0, "structure_adaptive_alpha": True}])
def test_structure_parts_a_close_pair(spark, more):
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=(2, 40))
    columns = [u, v, u + 0.01 * rng.normal(size=40), v + 0.01 * rng.normal(size=40)]
    x = spark.createDataFrame([(s, f, float(c[s])) for f, c in enumerate(columns) for s in range(40)], "sample_id long, feature_id long, v double")
    a = spark.createDataFrame(pd.DataFrame({"id": range(4), "MZ": [200.0, 200.0006, 300.0, 400.0], "RT": 1.0}))
    b = spark.createDataFrame(pd.DataFrame({"id": range(4), "MZ": [200.0004, 200.0002, 300.0, 400.0], "RT": 1.0}))
    r = match_features(a, b, MatchConfig(use_structure=True, structure_alpha=20.0, structure_k=1, mz_global_shift_model="none", retention_mode="mz_only", top1_policy="ot", allow_unmatched=False, **more), x, x)
    assert {(t.id1, t.id2) for t in r.top1.collect()} == {(i, i) for i in range(4)}
