"""What failed at 60 times sf0.1: queries that made, sorted or gathered all pairs, and shuffle files that stayed behind their steps."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from specmatch import plan_queries  # noqa: F401  registers its queries
from specmatch import session
from specmatch.operators import bandjoin, transport
from specmatch.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"

#: Told from sorted mass slices alone.
NO_PAIRS = ["abstain_ambiguous", "abstain_confidence", "finish_probability", "hybrid_policy", "left_outer_top1", "null_quantile", "row_entropy", "row_softmax_null", "row_trust", "semi_relaxed_ot", "sink_candidates", "sinkhorn_balanced_n", "top1_decision", "top2_margin"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def refuse(*_, **__):
    raise AssertionError("all pairs, or a column's distinct values in one task")


def shuffled(spark) -> set[str]:
    """Names of the shuffle files on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return set(re.findall(r"shuffle_\w+\.data", files.mkString(" ")))


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_pairs_are_made(spark, con, name, monkeypatch):
    steps, cut = [], session.cut

    def watched(df):
        before = shuffled(spark)
        out = cut(df)
        until = time.time() + 10  # they may go a moment later
        while (left := shuffled(spark) - before) and time.time() < until:
            time.sleep(0.1)
        steps.append(len(left))
        return out

    monkeypatch.setattr(session, "cut", watched)
    monkeypatch.setattr(transport, "cut", watched)
    monkeypatch.setattr(bandjoin, "band_join", refuse)
    monkeypatch.setattr(F, "percentile", refuse)
    assert not differences(QUERIES[name](spark, SF), con, ORACLES[name])
    assert steps and not any(steps)  # what a step shuffled goes with it


def test_likelihoods_make_the_pairs_once(spark, con, monkeypatch):
    """student_t_loglik returns the pairs: its line and its scale are told without them."""
    calls, join = [], bandjoin.band_join
    monkeypatch.setattr(bandjoin, "band_join", lambda *a, **k: calls.append(a) or join(*a, **k))
    monkeypatch.setattr(F, "percentile", refuse)
    got = QUERIES["student_t_loglik"](spark, SF)
    assert len(calls) == 1 and "Window" not in got._jdf.queryExecution().toString()
    assert not differences(got, con, ORACLES["student_t_loglik"])


def test_anchor_scales_are_counted(spark, con, monkeypatch):
    """anchor_scales: no task holds the distinct residuals of a term."""
    monkeypatch.setattr(F, "percentile", refuse)
    assert not differences(QUERIES["anchor_scales"](spark, SF), con, ORACLES["anchor_scales"])


#: Asked of a left row's partners together, which come as one row.
BY_ROW = ["hybrid_policy", "null_quantile", "row_entropy", "row_softmax_null", "sink_candidates", "top1_decision", "semi_relaxed_ot", "row_trust", "top2_margin", "abstain_ambiguous", "abstain_confidence", "finish_probability", "left_outer_top1"]


@pytest.mark.parametrize("name", BY_ROW)
def test_edges_are_not_dealt_again(spark, con, name, monkeypatch):
    """What is asked of the kept edges by left row neither sorts nor deals them again."""
    monkeypatch.setattr(transport, "_row", refuse)
    got = QUERIES[name](spark, SF)
    assert "Window" not in got._jdf.queryExecution().toString()
    assert not differences(got, con, ORACLES[name])
