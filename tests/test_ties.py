"""Ties that rounding or the order of rows must not settle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from specmatch.operators import cluster, decide, transport


def test_rows_with_the_same_scores_get_the_same_doubles(spark):
    ll = np.random.default_rng(0).normal(0, 3, 20).tolist()
    rows = [(i, int(j), float(j), ll[j]) for i in range(200) for j in np.random.default_rng(i).permutation(20)]
    e = spark.createDataFrame(rows, "id1 long, id2 long, mz2 double, ll double").repartition(7)
    got = transport.row_softmax(e, -3.0, 0.5).groupBy("id2").agg(F.countDistinct("p_row").alias("n"), F.countDistinct("p0").alias("n0")).collect()
    assert {(r.n, r.n0) for r in got} == {(1, 1)}


def test_a_columns_largest_weight_wins_by_any_margin(spark):
    for w, other in [(0.4979870860764374, 0.01789741716084584), (0.4987337488318487, 0.01285850605509452)]:
        more = float(np.nextafter(w, 1))
        assert w / (w + more + other) == more / (w + more + other)  # as shares they would tie
        edges = spark.createDataFrame([(1, 5, w), (2, 5, more), (3, 5, other)], "id1 long, id2 long, ot_weight double")
        top = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "id1 long, id2 long")
        assert [tuple(r) for r in decide.one_direction_mutual(top, edges).collect()] == [(2, 5)]


def test_numbers_as_names_go_by_value(spark):
    f = spark.createDataFrame([("S", n, 100.0, 1.0, 1.0) for n in ("10", "9", "x", "100008", "b")], "study_id string, feature_id string, MZ double, RT double, Intensity double")
    got = cluster._study(f, "S").orderBy("id").collect()
    assert [r.feature_id for r in got] == ["9", "10", "100008", "b", "x"]
