"""Behaviour of whole matches on small studies with a known truth."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest

from specmatch.plans.config import MatchConfig
from specmatch.plans.match import match_features
from specmatch.sources import metadata, readers


def table(spark, **columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame(pd.DataFrame({"id": range(n), **columns}))


def same(result) -> int:
    return result.top1.where("id1 = id2").count()


def random_study(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return np.sort(rng.uniform(120, 1100, n)), rng.gamma(4, 2, n)


def test_a_study_of_masses_meets_one_of_negative_ions(spark):
    mz, rt = random_study(130, 1)
    cfg = MatchConfig(polarity="negative", mz_semantics_study_a="neutral_mass", mz_semantics_study_b="ion_mz")
    r = match_features(table(spark, MZ=mz, RT=rt), table(spark, MZ=mz - 1.007276466812, RT=rt + 0.02), cfg)
    p = r.drift_params
    assert p["mz_shift_applied"] and p["mz_shift_da_study_a"] == pytest.approx(-1.007276466812) and not p["mz_shift_da_study_b"]
    assert same(r) >= 125


def test_a_study_in_seconds_is_told(spark):
    mz, rt = random_study(90, 2)
    rt = 3 + 2 * rt
    r = match_features(table(spark, MZ=mz, RT=rt * 60), table(spark, MZ=mz * (1 + 1e-6), RT=rt), MatchConfig())
    p = r.drift_params
    assert (p["rt_unit_scale_study_a"], p["rt_unit_scale_study_b"]) == (pytest.approx(1 / 60), 1.0) and same(r) >= 85


def test_a_line_of_retention_is_found_among_wrong_anchors(spark):
    mz, rt = random_study(150, 3)
    other = (rt - 1.4) / 0.8
    other[::6] = np.random.default_rng(4).permutation(other[::6])
    r = match_features(table(spark, MZ=mz, RT=rt), table(spark, MZ=mz, RT=other), MatchConfig(ppm=8.0))
    p = r.drift_params
    assert p["rt_policy"] == "linear" and p["rt_scale"] == pytest.approx(0.8, abs=0.02) and p["rt_offset"] == pytest.approx(1.4, abs=0.15)


def test_variation_decides_between_equal_masses(spark):
    spread = [0.31, 0.05, 0.92]
    a = table(spark, MZ=[412.2, 655.9], RT=[3.3, 8.1], CV=[0.05, 0.92])
    b = table(spark, MZ=[412.2] * 3 + [655.9] * 3, RT=[3.3] * 3 + [8.1] * 3, CV=spread * 2)
    r = match_features(a, b, MatchConfig(use_cv=True, w_cv=2.0, ot_mode="semi_relaxed", allow_unmatched=False, top1_policy="ot"))
    assert {x.id1: x.id2 for x in r.top1.collect()} == {0: 1, 1: 5}


def test_empty_and_unmatched(spark):
    a = table(spark, MZ=[100.0, 500.0], RT=[1.0, 2.0])
    r = match_features(a, a.limit(0), MatchConfig())
    assert {x.decision for x in r.top1.collect()} == {"no_candidate"}


def test_bad_settings():
    for bad in ({"ot_mode": "x"}, {"polarity": "both"}, {"top1_policy": "x"}, {"tight_anchor_strategy": "x"}):
        with pytest.raises(ValueError):
            MatchConfig(**bad)
    assert MatchConfig(retention_mode="mz-only", tight_anchor_strategy="mutual-nn").tight_anchor_strategy == "mnn"


def test_manifest_and_ids(tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"studies": [{"study_id": "A", "feature_format": "separate_tables", "matrix_path": "x.csv", "features_path": "f.csv"}]}))
    assert readers.load_manifest(str(p))[0].analysis_id == "A"
    p.write_text(json.dumps([{"study_id": "A", "feature_format": "separate_tables", "matrix_path": ""}]))
    with pytest.raises(ValueError):
        readers.load_manifest(str(p))
    assert readers.analysis_ids(["AN12", "an000012", "7"]) == ["AN000012", "AN000007"]
    assert readers.feature_count("Samples\t100.1_2.5\tfoo\t3.5_200.2\t1_2") == 2


def test_matrix_layouts(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Samples\tf1\tf2\nm/z\t100.5\t200.5\nrt\t1.5\t2.5\ns1\t10\t\ns2\t30\tx\n")
    f, x = readers.read_matrix(spark, str(tmp_path / "a.tsv"))
    assert {(r.feature_id, r.MZ, r.RT, r.Intensity) for r in f.collect()} == {("f1", 100.5, 1.5, 20.0), ("f2", 200.5, 2.5, 0.0)}
    (tmp_path / "b.tsv").write_text("Samples\t1.5_300.25\t2.5_400.5\tname\ns1\t1\t2\t3\n")
    f, x = readers.read_matrix(spark, str(tmp_path / "b.tsv"))
    assert {(r.MZ, r.RT) for r in f.collect()} == {(300.25, 1.5), (400.5, 2.5)} and x.count() == 2


def test_metadata_fields(spark):
    doc = {"METABOLOMICS WORKBENCH": {"ANALYSIS_ID": "AN000123", "STUDY_ID": "ST000999"}, "CHROMATOGRAPHY": {"CHROMATOGRAPHY_TYPE": "Reversed phase LC"}, "MS": {"ION_MODE": "NEGATIVE", "MS_COMMENTS": "LOESS normalized; missing values imputed.", "MS_RESULTS_FILE": "R.txt UNITS:Normalized peak area Has m/z:Yes Has RT:Yes RT units:Minutes"}, "MS_METABOLITE_DATA": {"Units": "Normalized peak area", "Metabolites": [{"Metabolite": " citric  acid ", "KEGG ID": "C1"}], "Data": [{"x": 1}]}}
    df = spark.createDataFrame([(json.dumps(doc),)], "json string")
    r = metadata.metadata(df).first()
    assert (r.analysis_id, r.ion_mode_norm, r.chromatography_norm, r.ms_results_has_mz_semantics, r.ms_results_rt_units, r.value_scale, r.value_scale_hints, r.n_mwtab_metabolites) == ("AN000123", "negative", "reversed_phase", "yes", "minutes", "normalized", "normalized|imputed", 1)
    m = metadata.labelled_metabolites(df).first()
    assert (m.name, m.kegg_id) == ("CITRIC ACID", "C1")


def test_cli_match(spark, tmp_path):
    from specmatch.cli import main

    for n, d in (("a", 0.0), ("b", 0.0001)):
        pd.DataFrame({"MZ": np.array([100.0, 200.0, 300.0]) + d, "RT": [1.0, 2.0, 3.0], "Intensity": 1e6}).to_csv(tmp_path / f"{n}.csv", index=False)
    assert main(["match", str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), "--out-candidates", str(tmp_path / "c"), "--out-top1", str(tmp_path / "t"), "--out-manifest", str(tmp_path / "m.json")], spark) == 0
    x = json.loads((tmp_path / "m.json").read_text())["extras"]
    assert (x["n_features_study_a"], x["n_features_study_b"], x["n_top1_rows"]) == (3, 3, 3) and x["n_candidates"] >= 1
