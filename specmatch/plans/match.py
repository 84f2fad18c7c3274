"""Matching two studies: from two feature tables to scored candidates and one decision for each feature of the first."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specmatch.functions import columns as C
from specmatch.operators import align, bandjoin, decide, drift, stats, structure, transport, windows
from specmatch.plans.config import MatchConfig
from specmatch.session import cut


@dataclass(frozen=True)
class MatchResult:
    candidates: DataFrame
    top1: DataFrame
    ot_summary: dict[str, Any]
    drift_params: dict[str, Any]


def with_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Row numbers from 0 in file order. Partition sizes are counted first, so no task sees the whole table."""
    if id_col in df.columns:
        return df
    p = cut(df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = p.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_f"))
    starts = sizes.withColumn("_s", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_s", "_f")  # a row for each partition
    return p.join(F.broadcast(starts), "_p").withColumn(id_col, F.col("_s") + F.col("_i") - F.col("_f")).drop("_p", "_i", "_s", "_f")


def normalise(df: DataFrame, cfg: MatchConfig, side: str) -> DataFrame:
    """(id, mz, rt, int, cv, ro): NaN becomes NULL, which is what unknown means from here on."""
    names = {k: getattr(cfg, f"{k}_col_study_{side}", None) or getattr(cfg, f"{k}_col") for k in ("mz", "rt")}
    if names["mz"] not in df.columns:
        raise ValueError(f"study {side} has no column {names['mz']!r}")
    if names["rt"] not in df.columns and cfg.retention_mode == "use":
        raise ValueError(f"study {side} has no column {names['rt']!r}")
    unknown = F.lit(None).cast("double")
    rt = C.known(F.col(names["rt"])) if names["rt"] in df.columns else unknown
    level = C.intensity_log10(C.known(F.col(cfg.intensity_col))) if cfg.intensity_col in df.columns else F.lit(0.0)
    cv = C.cv_log10(C.known(F.col("CV"))) if "CV" in df.columns else F.lit(0.0)
    out = with_ids(df).select(F.col("id").cast("long").alias("id"), C.known(F.col(names["mz"])).alias("mz"), rt.alias("rt"), level.alias("int"), cv.alias("cv"), *([C.known(F.col("ro")).alias("ro")] if "ro" in df.columns else []))
    if "ro" not in out.columns:
        out = stats.retention_order(out)
    if cfg.use_intensity and cfg.intensity_standardize != "none":
        out = (stats.zscore if cfg.intensity_standardize == "zscore" else stats.robust_zscore)(out, "int")
    return out.select("id", "mz", "rt", "int", "cv", "ro")


def prepare(a: DataFrame, b: DataFrame, cfg: MatchConfig) -> tuple[DataFrame, DataFrame, MatchConfig, dict[str, Any]]:
    """Both studies in one frame: mass shift, retention units, retention transfer, and the settings that follow from them."""
    a, b = cut(normalise(a, cfg, "a")), cut(normalise(b, cfg, "b"))
    note: dict[str, Any] = {}
    shift = align.infer_shift(a, b, cfg)
    note |= {"mz_shift_da_study_a": shift.a, "mz_shift_da_study_b": shift.b, "mz_shift_mnn_best": shift.best, "mz_shift_mnn_zero": shift.zero, "mz_shift_applied": shift.applied, "mz_shift_note": shift.note}
    if shift.a:
        a = a.withColumn("mz", F.col("mz") + shift.a)
    if shift.b:
        b = b.withColumn("mz", F.col("mz") + shift.b)
    units = {"a": 1.0, "b": 1.0}
    seen = stats.rt_profile({"a": a, "b": b}, cfg.retention_round_decimals or 3)
    if cfg.normalize_rt_units:
        units = {s: seen[s]["scale"] for s in "ab"}
        a, b = (d if units[s] == 1.0 else d.withColumn("rt", F.col("rt") * units[s]) for s, d in (("a", a), ("b", b)))
    note |= {"rt_unit_scale_study_a": units["a"], "rt_unit_scale_study_b": units["b"]}
    ok = tuple(align.enough_retention(seen[s]["n"], seen[s]["n_finite"], seen[s]["unique_scaled" if cfg.normalize_rt_units else "unique"], cfg) for s in "ab")
    use, mode, reason = cfg, cfg.retention_mode, None
    if cfg.retention_mode == "mz_only":
        use, mode, reason = align.without_retention(cfg), "mz_only", "forced_mz_only"
    elif cfg.retention_mode == "auto" and not all(ok):
        reason = "rt_bad_both" if not any(ok) else "rt_bad_study_b" if ok[0] else "rt_bad_study_a"
        use, mode = align.without_retention(cfg), "mz_only"
    note |= {"rt_ok_study_a": ok[0], "rt_ok_study_b": ok[1], "rt_policy": "off" if cfg.rt_transferability == "off" else "unknown", "rt_scale": 1.0, "rt_offset": 0.0}
    if cfg.rt_transferability == "auto" and mode != "mz_only" and (use.w_rt or use.w_roi):
        t = align.infer_transfer(a, b, use)
        note |= {"rt_policy": t.policy, "rt_scale": t.scale, "rt_offset": t.offset, "rt_n_anchors": t.n_anchors, "rt_n_inliers": t.n_inliers, "rt_spearman": t.spearman, "rt_p95_abs_resid": t.p95, "rt_note": t.note}
        soft = t.policy != "linear" and cfg.retention_mode == "auto"
        if t.policy == "linear" or (soft and cfg.retention_nontransferable_policy == "soft"):
            b = b.withColumn("rt", F.col("rt") * t.scale + t.offset)
        if soft and cfg.retention_nontransferable_policy == "soft":
            w = align.soft_weight(t, use)
            use, mode, reason = replace(use, w_rt=use.w_rt * w, w_roi=use.w_roi * w), "soft", "rt_nontransferable_pair_soft"
            note["retention_soft_weight"] = w
        elif soft:
            use, mode, reason = align.without_retention(use), "mz_only", "rt_nontransferable_pair"
    if use.rt_gate_mode == "adaptive_disable" and use.rt > 0:
        p95 = align.drift_p95(a, b, use.rt_gate_anchor_ppm or use.tight_ppm, use.rt_gate_min_count)
        note["rt_gate_p95_est"] = p95
        if math.isfinite(p95) and p95 > use.rt_gate_disable_p95:
            use = replace(use, rt=0.0)
    note |= {"retention_mode_effective": mode, "retention_disable_reason": reason, "rt_gate_rt_final": use.rt}
    return a, b, use, note


def candidates(a: DataFrame, b: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Pairs within the tolerances of mass, retention and, where it is used, intensity."""
    pairs = bandjoin.band_join(a, b, cfg.ppm, cfg.rt)
    if cfg.use_intensity:
        pairs = pairs.where(F.coalesce(F.abs(F.col("int2") - F.col("int1")) <= cfg.intensity_log_diff_max, F.lit(False)))
    return pairs


def _gates(pairs: DataFrame, cfg: MatchConfig) -> DataFrame:
    out = pairs
    if cfg.tight_rt > 0:
        out = out.where(~F.coalesce(F.abs(F.col("rt2") - F.col("rt1")) > cfg.tight_rt, F.lit(False)))
    if cfg.tight_roi > 0:
        out = out.where(~F.coalesce(F.abs(F.col("ro2") - F.col("ro1")) > cfg.tight_roi, F.lit(False)))
    if cfg.use_intensity and cfg.tight_intensity_log_diff > 0:
        out = out.where(~F.coalesce(F.abs(F.col("int2") - F.col("int1")) > cfg.tight_intensity_log_diff, F.lit(False)))
    return out


def anchors(a: DataFrame, b: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Pairs that are tight in mass and pass the gates: all of them, each row's nearest, or mutual nearest ones."""

    def near(x: DataFrame, y: DataFrame) -> DataFrame:
        pairs = _gates(bandjoin.band_join(x, y, cfg.tight_ppm), cfg)
        if cfg.tight_anchor_strategy == "all":
            return pairs
        w = Window.partitionBy("id1").orderBy(F.abs(C.ppm_over_mean(F.col("mz1"), F.col("mz2"))), F.abs(F.col("rt2") - F.col("rt1")).asc_nulls_last(), "mz2", "id2")
        return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    out = near(a, b)
    if cfg.tight_anchor_strategy == "mnn":
        out = out.join(near(b, a).select(F.col("id1").alias("id2"), F.col("id2").alias("id1")), ["id1", "id2"])
    return differences(out)


def differences(pairs: DataFrame) -> DataFrame:
    d = lambda c: F.col(f"{c}2") - F.col(f"{c}1")
    return pairs.select("*", C.ppm_over_mean(F.col("mz1"), F.col("mz2")).alias("delta_ppm_raw"), d("rt").alias("delta_rt"), d("int").alias("intensity_log_diff"), d("cv").alias("cv_log_diff"), d("ro").alias("delta_roi"))


#: Evidence: difference, what its drift depends on, setting of its drift model.
_TERMS = {"ppm": ("delta_ppm_raw", "mz1", "ppm"), "rt": ("delta_rt", "rt1", "rt"), "roi": ("delta_roi", "ro1", "roi"), "int": ("intensity_log_diff", "int1", None), "cv": ("cv_log_diff", "cv1", None)}


#: Right and left column of a term's difference; ppm has its own.
_SIDES = {"ppm": ("", ""), "rt": ("rt2", "rt1"), "roi": ("ro2", "ro1"), "int": ("int2", "int1"), "cv": ("cv2", "cv1")}


def score(cand: DataFrame, tight: DataFrame, cfg: MatchConfig, sides: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """Candidates with drift, residuals and their log likelihood. ``sides``: both studies, where candidates and anchors are all their pairs
    within the tolerances of mass; scales are then counted along mass slices."""
    if cfg.drift_fit_bootstrap and (n := tight.count()) >= drift.LEAST:
        tight = cut(tight.sample(True, 1.0, cfg.drift_bootstrap_seed))
    models: dict[str, drift.Drift] = {}
    wanted = {}
    for name, (diff, x, setting) in _TERMS.items():
        kind = "linear" if name == "int" else "none" if setting is None else getattr(cfg, f"{setting}_drift_model")
        wanted[name] = (kind, "ro1" if name == "rt" and cfg.rt_drift_x != "rt" else x, diff, getattr(cfg, f"{setting}_spline_df", 10) if setting else 10)
    # all lines and the number of anchors are one job
    fits = stats.lines(tight, {f"{k}_": w[1:3] for k, w in wanted.items() if w[0] == "linear"}).first()
    n = n if cfg.drift_fit_bootstrap else fits["rows"]
    for name, (kind, x, diff, df) in wanted.items():
        if n < drift.LEAST:
            models[name] = drift.Drift()
        elif kind == "linear":
            models[name] = drift.Drift("linear", float(fits[f"{name}_intercept"] or 0), float(fits[f"{name}_slope"] or 0)) if fits[f"{name}_n"] else drift.Drift()
        else:
            models[name] = drift.fit(tight, kind, x, diff, df)

    def residuals(df: DataFrame) -> DataFrame:
        for name, (diff, x, _) in _TERMS.items():
            x = "ro1" if name == "rt" and cfg.rt_drift_x != "rt" else x
            df = df.withColumn(f"{name}_fit", models[name].at(F.col(x))).withColumn(f"{name}_resid", F.col(diff) - F.col(f"{name}_fit"))
        return df

    cand, tight = residuals(cand), residuals(tight)
    terms = [("ppm", cfg.w_ppm), ("rt", cfg.w_rt), ("roi", cfg.w_roi), ("int", cfg.w_int if cfg.use_intensity else 0.0), ("cv", cfg.w_cv if cfg.use_cv else 0.0)]
    own = cfg.use_anchor_scales and n >= cfg.anchor_scale_min_count
    got = None
    if sides is not None:
        left, right, of = windows.side(sides[0], 1), windows.side(sides[1], 2), {}
        for name, weight in terms:
            if weight:
                of[name] = _SIDES[name]
                left = left.withColumn(f"fit_{name}", models[name].at(F.col(wanted[name][1])))
        got = windows.mad_scales(left, right, cfg.tight_ppm if own else cfg.ppm, of, cfg.scale_floor)
    if got is None:
        got = stats.mad_scales(tight if own else cand, {name: F.col(f"{name}_resid") for name, weight in terms if weight}, cfg.scale_floor)
    ll, scales = F.lit(0.0), {}
    for name, weight in terms:
        if weight:
            scales[name] = float(got[name] or cfg.scale_floor)
            ll = ll + F.lit(float(weight)) * C.student_t(F.col(f"{name}_resid"), scales[name], cfg.t_df)
    out = cand.withColumn("mz1_eff", F.col("mz1")).withColumn("loglik", ll)
    return out, {"n_anchors": n, "scales": scales, "drift": {k: {"kind": m.kind, "intercept": m.intercept, "slope": m.slope} for k, m in models.items()}}


def transport_edges(edges: DataFrame, cfg: MatchConfig, ll: str, epsilon: float | None = None) -> tuple[DataFrame, float | None]:
    """``edges`` with ot_weight, p_row_ot and p0_ot by the chosen mode, and the null option's log likelihood."""
    eps = cfg.ot_epsilon if epsilon is None else epsilon
    null = (transport.null_loglik(edges, cfg.null_loglik_quantile, ll) if cfg.null_loglik is None else cfg.null_loglik) if cfg.allow_unmatched else None
    if cfg.ot_mode == "semi_relaxed":
        n = edges.agg(F.countDistinct("id1")).first()[0]
        out = transport.row_softmax(edges, null, eps, ll).withColumnRenamed("p_row", "p_row_ot").withColumnRenamed("p0", "p0_ot")
        return out.withColumn("ot_weight", F.col("p_row_ot") / max(n, 1)), null
    tau = (1.0, 1.0)
    if cfg.ot_mode == "unbalanced":
        row, col = cfg.ot_unbalanced_lambda_row or 10.0, cfg.ot_unbalanced_lambda_col or 1.0
        tau = (row / (row + eps), col / (col + eps))
    s = transport.Sinkhorn(eps, cfg.ot_max_iter, cfg.ot_tol, cfg.ot_min_mass, *tau, cfg.null_mass if cfg.allow_unmatched else None)
    return transport.sinkhorn_auto(edges, s, null, ll), null


def match_features(a: DataFrame, b: DataFrame, cfg: MatchConfig = MatchConfig(), expr_a: DataFrame | None = None, expr_b: DataFrame | None = None) -> MatchResult:
    """Match study ``a`` to ``b`` (columns MZ, RT, optional Intensity, CV; optional ``id``). ``expr_a``/``expr_b``: long tables
    (sample_id, feature_id, v) over the same ids, for structure."""
    if cfg.use_structure and (expr_a is None or expr_b is None):
        raise ValueError("use_structure needs both expression tables")
    if cfg.structure_graph == "stable" and (not cfg.structure_abs or cfg.structure_corr_estimator != "sample"):
        raise ValueError("the stable graph is built of absolute sample correlations")
    a, b, use, note = prepare(a, b, cfg)
    cand, fitted = score(differences(candidates(a, b, use)), anchors(a, b, use), use)
    note |= fitted
    cand = cut(cand.withColumn("loglik_local", F.col("loglik")))
    alpha, graph = cfg.structure_alpha, cfg.structure_graph
    bonus = cfg.use_structure and alpha != 0
    if note["rt_policy"] == "ignore" and expr_a is not None and expr_b is not None and not bonus:
        alpha, graph, bonus = cfg.structure_alpha_on_nontransferable_rt, cfg.structure_graph_on_nontransferable_rt, True
    graphs = _graphs(a, b, expr_a, expr_b, cfg, graph) if bonus else None
    edges = cand.withColumn("struct_bonus", F.lit(0.0)).withColumn("loglik_total", F.col("loglik_local"))
    null = None
    passes = max(cfg.structure_iters, 1) if graphs else 1
    for i in range(passes):
        annealed = bool(graphs) and cfg.structure_anneal and passes > 1
        t = i / max(passes - 1, 1)
        eps = cfg.ot_epsilon * (max(cfg.structure_ot_epsilon_mult_start, 1.0) * (1.0 - t) + t) if annealed else None
        kept = cut(transport.top_k(edges, cfg.candidate_top_k_per_id1, "loglik_total"))
        solved, null = transport_edges(kept, cfg, "loglik_total", eps)
        solved = cut(solved)
        if graphs and i < passes - 1:
            ramp = (i + 1) / (passes - 1) if annealed and cfg.structure_alpha_ramp else 1.0
            mass = structure.structure_bonus(solved, *graphs, mode=cfg.structure_bonus_mode, eps=cfg.structure_eps, ids1=a.select("id"), ids2=b.select("id"))
            adaptive = cfg.structure_adaptive_alpha and cfg.structure_margin_tau > 0
            mass = structure.adaptive_weight(mass, cfg.structure_margin_tau, cfg.structure_margin_gamma) if adaptive else mass.withColumn("_trust", F.lit(1.0))
            edges = mass.withColumn("loglik_total", F.col("loglik_local") + F.lit(alpha * ramp) * F.col("_trust") * F.col("struct_bonus")).select(*kept.columns)
    local = transport.row_softmax(solved, null, 1.0, "loglik_total").withColumnRenamed("p_row", "p_row_local").withColumnRenamed("p0", "p0_local")
    for name, p, p0 in (("local", "p_row_local", "p0_local"), ("ot", "p_row_ot", "p0_ot")):
        h = transport.row_entropy(local, p, p0).select("id1", F.col("entropy").alias(f"row_entropy_{name}"), F.col("neff").alias(f"row_neff_{name}"))
        local = local.join(h, "id1")
    edges = cut(local)
    rows = a.select(F.col("id").alias("id1"))
    with_null = cfg.allow_unmatched
    ot = decide.top1(rows, edges, "p_row_ot", "p0_ot" if with_null else None, "null_ot", 0.0)
    loc = decide.top1(rows, edges, "p_row_local", "p0_local" if with_null else None, "null_local", 1.0 if with_null else 0.0)
    extra = edges.groupBy("id1").agg(F.count("*").alias("n_candidates"), F.max("row_neff_ot").alias("row_neff_ot"))
    ot = ot.join(extra, "id1", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("long")))
    if cfg.top1_policy == "hybrid":
        top = decide.hybrid(ot, loc, cfg.top1_hybrid_local_p_min, cfg.top1_hybrid_local_margin_min, cfg.top1_hybrid_ot_margin_max, cfg.top1_hybrid_ot_null_override_max_p0, cfg.top1_hybrid_ot_null_override_max_row_neff)
    elif cfg.top1_policy == "local":
        top = loc.join(ot.select("id1", "n_candidates", "row_neff_ot"), "id1").withColumn("top1_source", F.lit("local"))
    else:
        top = ot.withColumn("top1_source", F.lit("ot"))
    top = decide.abstain_confidence(top, cfg.decision_min_prob_match, cfg.decision_min_margin, cfg.decision_min_prob_match_minus_null)
    top = decide.abstain_ambiguous(top, cfg.decision_ambig_min_n_candidates, cfg.decision_ambig_min_row_neff_ot, cfg.decision_ambig_min_prob_match, cfg.decision_ambig_min_margin, cfg.decision_ambig_min_prob_match_minus_null)
    top = decide.finish(top, cfg.max_p0)
    return MatchResult(edges, cut(top), {"ot_mode": cfg.ot_mode, "null_loglik": null, "ot_epsilon": cfg.ot_epsilon, "null_mass": cfg.null_mass if with_null else None}, note)


def _graphs(a: DataFrame, b: DataFrame, expr_a: DataFrame, expr_b: DataFrame, cfg: MatchConfig, kind: str) -> tuple[DataFrame, DataFrame] | None:
    out = []
    for f, x in ((a, expr_a), (b, expr_b)):
        if cfg.structure_corr == "spearman":
            x = cut(structure.ranked(x))
        n = x.agg(F.countDistinct("sample_id")).first()[0]
        if n < cfg.structure_min_samples:
            return None
        signed = not cfg.structure_abs
        if kind == "local_rt":
            g = structure.local_rt(f.select("id", "rt"), x, cfg.structure_rt_window, cfg.structure_k, n, cfg.structure_max_candidates // 2, signed)
        elif kind == "stable":
            g = structure.stable_knn(x, cfg.structure_k, cfg.structure_n_boot, cfg.structure_subsample_frac, cfg.structure_min_freq)
        else:
            g = structure.corr_knn(x, cfg.structure_k, n, cfg.structure_corr_estimator, signed)
        out.append(cut(g.select("i", "j", "w")))
    return out[0], out[1]
