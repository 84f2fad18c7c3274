"""Whole commands, cluster strategies and fits, held to numpy, to known truth and to the files they write."""

from __future__ import annotations

import gzip
import json
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specmatch.cli import main
from specmatch.operators import align, cluster, drift, effects, structure, transport
from specmatch.plan_queries import PLAIN
from specmatch.plans.config import MatchConfig
from specmatch.plans.match import match_features
from specmatch.sources import readers


def stacked(spark, n: int = 40, studies: int = 3, lack: bool = True):
    rng = np.random.default_rng(5)
    mz, rt = np.sort(rng.uniform(150, 900, n)), rng.uniform(1, 15, n)
    rows = [(f"S{s}", f"f{k:03d}", float(mz[k] * (1 + (s - 1) * 1.5e-6)), float(rt[k] + 0.01 * s), 1e4 + k) for s in range(studies) for k in range(n) if not lack or k % 10 != s]
    return spark.createDataFrame(rows, "study_id string, feature_id string, MZ double, RT double, Intensity double"), mz


def measured(spark, features, samples: int = 6):
    x = features.select("study_id", "feature_id").withColumn("sample_id", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("v", (F.col("sample_id") * 2 - 2).cast("double"))
    return x.select("study_id", F.concat("study_id", F.lit("-"), "sample_id").alias("sample_id"), "feature_id", "v")


def test_template_strategies_follow_the_truth(spark):
    features, mz = stacked(spark, 24, 2)
    expr = measured(spark, features, 2)
    for soft, full in ((True, False), (False, True)):
        r = cluster.template_clusters(features, replace(PLAIN, allow_unmatched=False), "S0", expr, rounds=1, soft=soft, full=full)
        rows = r.cluster_map.collect()
        assert r.strategy == ("hub_barycenter_ot" if soft else "hub_consensus_template_ot_full")
        hits = [x for x in rows if "__" not in x.cluster_id and x.study_id != "S0"]
        assert len(hits) == 18 and all(x.cluster_id == x.feature_id for x in hits)
        if full:
            assert {x.cluster_id for x in rows if "__" in x.cluster_id} >= {f"S1__f{k:03d}" for k in (0, 10, 20)}
        meta = {x.cluster_id: x for x in r.metadata.collect()}
        assert abs(meta["f005"].MZ - mz[5]) < 5e-6 * mz[5] and meta["f005"].n_studies == 2
        cells = r.expression.where("cluster_id = 'f005'").select("study_id", "v").collect()
        assert {(x.study_id, x.v) for x in cells} == {(f"S{s}", v) for s in range(2) for v in (0.0, 2.0)}  # a measured zero is there
        assert r.expression.where("cluster_id = 'f001' AND study_id = 'S1'").isEmpty()  # what a study lacks is not


def _lines(path) -> list[list[str]]:
    text = gzip.decompress(path.read_bytes()).decode() if path.suffix == ".gz" else path.read_text()
    return [x.split("\t") for x in text.splitlines()]


def test_cli_cluster_writes_plain_files(spark, tmp_path):
    features, _ = stacked(spark, 30, 2)
    f = features.toPandas()
    rng = np.random.default_rng(6)
    specs = []
    for s, own in f.groupby("study_id"):
        table = pd.DataFrame({k: np.where(rng.random(4) < 0.3, 0, 10 + rng.random(4)) for k in own.feature_id})
        table.insert(0, "Samples", [f"{s}-{i}" for i in range(4)])
        head = pd.DataFrame([["m/z", *own.MZ], ["rt", *own.RT]], columns=table.columns)
        pd.concat([head, table]).to_csv(tmp_path / f"{s}.tsv", sep="\t", index=False)
        specs.append({"analysis_id": s, "feature_format": "mw_special_rows", "matrix_path": f"{s}.tsv"})
    (tmp_path / "m.json").write_text(json.dumps({"studies": specs}))
    args = ["cluster", "--manifest", str(tmp_path / "m.json"), "--out-dir", str(tmp_path / "out"), "--strategy", "hub", "--hub-alignment", "mutual_top1", "--hub-id", "S0", "--full-join", "--mz-global-shift-model", "none"]
    assert main(args, spark) == 0
    out = tmp_path / "out"
    cmap, meta = _lines(out / "cluster_map.tsv"), _lines(out / "cluster_metadata.tsv")
    assert cmap[0] == ["cluster_id", "study_id", "feature_id"] and len(cmap) - 1 == len(f)
    assert len({r[0] for r in cmap[1:]}) == len(meta) - 1 >= 30
    wide = _lines(out / "cluster_expr_S1.tsv.gz")
    assert len(wide) == 5 and {len(r) for r in wide} == {len(meta)} and [r[0] for r in wide[1:]] == sorted(r[0] for r in wide[1:])
    at = wide[0].index("f005")
    want = pd.read_csv(tmp_path / "S1.tsv", sep="\t").iloc[2:]["f005"].astype(float)
    assert [float(r[at]) for r in wide[1:]] == pytest.approx(want.tolist())
    assert all(r[wide[0].index("f001")] == "" for r in wide[1:])  # the study lacks it
    run = json.loads((out / "run_manifest.json").read_text())
    assert run["command"] == "cluster" and run["extras"] == {"n_studies": 2}


def _document(k: int, **more) -> str:
    return json.dumps({"METABOLOMICS WORKBENCH": {"ANALYSIS_ID": f"AN{k:06d}", "STUDY_ID": f"ST{k}"}, "CHROMATOGRAPHY": {"CHROMATOGRAPHY_TYPE": "HILIC"}, "MS": {"ION_MODE": "POSITIVE"}, "MS_METABOLITE_DATA": {"Metabolites": [{"Metabolite": "alanine"}, {"Metabolite": f"own {k}"}]}} | more)


def test_cli_reuse_and_find(spark, tmp_path):
    cache = tmp_path / "cache"
    cache.mkdir()
    features, _ = stacked(spark, 30, 2, lack=False)
    f = features.toPandas()
    for k, s in ((1, "S0"), (2, "S1")):
        own = f[f.study_id == s]
        (cache / f"AN{k:06d}.json").write_text(_document(k))
        rows = [["Samples", *own.feature_id], ["m/z", *own.MZ], ["rt", *own.RT], *([f"s{i}", *(10 + i + np.arange(30))] for i in range(3))]
        (cache / f"AN{k:06d}.untarg.tsv").write_text("\n".join("\t".join(map(str, r)) for r in rows) + "\n")
    (cache / "AN000003.json").write_text(_document(3, MS={"ION_MODE": "unclear"}))
    out = tmp_path / "out"
    assert main(["reuse", "--analysis-id", "1", "--analysis-id", "AN2", "--analysis-id", "3", "--cache-dir", str(cache), "--out-dir", str(out), "--strategy", "hub", "--hub-alignment", "mutual_top1", "--mz-global-shift-model", "none"], spark) == 0
    assert json.loads((out / "reuse_summary.json").read_text()) == {"n_requested": 3, "n_groups": 1, "n_groups_failed": 0, "failed": {}}
    assert _lines(out / "dropped_analyses.tsv") == [["analysis_id", "reason"], ["AN000003", "unknown_strata"]]
    group = out / "groups" / "positive__hilic"
    assert [r[0] for r in _lines(group / "shared_all.tsv")[1:]] == ["ALANINE"]
    cmap = _lines(group / "cluster_map.tsv")[1:]
    assert len(cmap) >= 28 and all(r[0] == r[2] for r in cmap)
    assert main(["find", "--cache-dir", str(cache), "--out", str(tmp_path / "sel.json"), "--facet", "ion_mode_norm=positive"], spark) == 0
    assert json.loads((tmp_path / "sel.json").read_text())["analysis_ids"] == ["AN000001", "AN000002"]


def test_table_is_one_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    readers.write_table(spark.range(1000).repartition(7).orderBy("id").selectExpr("id", "concat('x,', id) `na,me`"), str(path))
    back = pd.read_csv(path)
    assert path.is_file() and [p.name for p in tmp_path.iterdir()] == ["t.csv"]
    assert list(back.columns) == ["id", "na,me"] and back.id.tolist() == list(range(1000)) and back["na,me"][17] == "x,17"


def test_transport_back_ends_agree_to_convergence(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(j), float(rng.normal(-2, 1.5))) for i in range(60) for j in rng.choice(50, 4, replace=False)]
    e = spark.createDataFrame(rows, "id1 long, id2 long, ll double")
    s = transport.Sinkhorn(max_iter=200, tau_row=10 / 10.5, tau_col=0.5)
    one, two = (x.select("id1", "id2", "ot_weight", "p_row_ot").toPandas().sort_values(["id1", "id2"]) for x in (transport.sinkhorn(e, s, -4.0), transport.sinkhorn_auto(e, s, -4.0)))
    for c in ("ot_weight", "p_row_ot"):
        np.testing.assert_allclose(one[c], two[c], rtol=1e-9)


def test_two_sided_probability():
    x = np.concatenate([np.linspace(0, 6, 200), [2.999999, 3.0, 10.0, 25.0]])
    np.testing.assert_allclose(effects.erfc(x), [math.erfc(v) for v in x], rtol=2e-11)


def test_transfer_tolerance_is_of_the_narrower_study():
    rng = np.random.default_rng(8)
    rt2 = rng.uniform(0, 3, 200)
    rt1 = 8 * rt2 + 1 + rng.normal(0, 0.5, 200)
    t = align.fit_transfer(rt1, rt2, MatchConfig())
    resid = np.abs(rt1 - (8 * rt2 + 1)) <= 0.2  # 0.05 of 3 minutes is below the least tolerance
    assert 0.6 * resid.sum() <= t.n_inliers <= 1.6 * resid.sum() and t.scale == pytest.approx(8, abs=0.4)
    down = align.fit_transfer(10 - rt2, rt2, MatchConfig())
    assert (down.policy, down.note, down.scale) == ("unknown", "ransac_failed", 1.0)  # no rising line


def test_lowess_keeps_values_where_the_width_is_nothing():
    x = np.concatenate([np.full(60, 2.0), np.linspace(3, 4, 40)])
    y = np.concatenate([np.arange(60.0), np.linspace(0, 1, 40)])
    knots = dict(drift.lowess_knots(x, y, 10))
    assert knots[2.0] == pytest.approx(29.5)


def test_shrunk_correlations_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (8, 12)) @ rng.normal(0, 1, (12, 12))
    df = spark.createDataFrame([(s, f, float(x[s, f])) for s in range(8) for f in range(12)], "sample_id long, feature_id long, v double")
    got = {(r.i, r.j): r.r for r in structure.shrunk(df, 8).collect()}
    z = x - x.mean(0)
    cov, n, p = z.T @ z / 8, 8, 12
    mu = np.trace(cov) / p
    spread = ((cov - mu * np.eye(p)) ** 2).sum() / p
    noise = min(sum(((np.outer(r, r) - cov) ** 2).sum() for r in z) / (p * n * n), spread)
    w = noise / spread
    c = (1 - w) * cov + w * mu * np.eye(p)
    d = np.sqrt(np.diag(c))
    assert 0 < w < 1
    for (i, j), r in got.items():
        assert r == pytest.approx(c[i, j] / d[i] / d[j], rel=1e-9)
    signed = structure.corr_knn(df, 3, 8, "ledoit_wolf", True).toPandas()
    assert (signed.w < 0).any() and signed.groupby("i").w.apply(lambda v: v.abs().sum()).to_numpy() == pytest.approx(1)


def test_stable_graph_in_a_match(spark):
    rng = np.random.default_rng(10)
    n, samples = 12, 30
    base = rng.normal(0, 1, (samples, 4))
    x = base[:, np.arange(n) % 4] + rng.normal(0, 0.2, (samples, n))
    expr = spark.createDataFrame([(s, f, float(x[s, f])) for s in range(samples) for f in range(n)], "sample_id long, feature_id long, v double")
    found = structure.stable_knn(expr, 2, n_boot=6).collect()
    assert found and all(r.i % 4 == r.j % 4 for r in found)
    drawn = structure.draws(expr, 6, 0.8).groupBy("boot_id").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("d")).collect()
    assert {(r.n, r.d) for r in drawn} == {(24, 24)}
    mz = np.sort(rng.uniform(200, 600, n))
    f = spark.createDataFrame([(k, float(mz[k]), float(k)) for k in range(n)], "id long, MZ double, RT double")
    cfg = MatchConfig(use_structure=True, structure_alpha=1.0, structure_graph="stable", structure_k=2, ot_mode="semi_relaxed", mz_global_shift_model="none")
    r = match_features(f, f, cfg, expr, expr)
    assert r.candidates.agg(F.max("struct_bonus")).first()[0] > 0
    with pytest.raises(ValueError):
        match_features(f, f, MatchConfig(structure_graph="stable", structure_abs=False))
