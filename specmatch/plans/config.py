"""Settings of a match. Names and defaults are fixed values: a user's settings carry over."""

from __future__ import annotations

from dataclasses import dataclass

#: Settings that take one of a few words (fixed values); ``-`` and ``_`` are the same.
CHOICES = {
    "retention_mode": ("auto", "use", "mz_only"),
    "mz_global_shift_model": ("auto", "none", "proton_only", "common_adducts"),
    "tight_anchor_strategy": ("all", "nn", "mnn"),
    "rt_drift_model": ("none", "lowess", "linear", "robust_linear"),
    "ppm_drift_model": ("none", "lowess", "linear", "robust_linear"),
    "roi_drift_model": ("none", "lowess", "linear", "robust_linear"),
    "rt_drift_x": ("rt", "ro", "roi", "rank"),
    "ot_mode": ("balanced", "unbalanced", "semi_relaxed"),
    "structure_bonus_mode": ("mass", "logmass", "gw"),
    "rt_gate_mode": ("none", "adaptive_disable"),
    "rt_transferability": ("off", "auto"),
    "retention_nontransferable_policy": ("soft", "disable"),
    "structure_graph": ("knn", "stable", "local_rt"),
    "structure_corr": ("pearson", "spearman"),
    "structure_corr_estimator": ("sample", "ledoit_wolf"),
    "top1_policy": ("ot", "local", "hybrid"),
    "polarity": ("positive", "negative"),
    "mz_semantics_study_a": ("auto", "ion_mz", "neutral_mass"),
    "mz_semantics_study_b": ("auto", "ion_mz", "neutral_mass"),
    "intensity_standardize": ("none", "zscore", "robust_zscore"),
}

#: Other spellings (fixed values).
ALIASES = {
    "retention_mode": {"mz": "mz_only"},
    "tight_anchor_strategy": {"nearest": "nn", "nearest_neighbor": "nn", "mutual": "mnn", "mutual_nearest": "mnn", "mutual_nn": "mnn", "mutual_nearest_neighbor": "mnn"},
    "mz_semantics_study_a": {"": "auto", "unknown": "auto", "ion": "ion_mz", "mz": "ion_mz", "yes": "ion_mz", "measured": "ion_mz", "neutral": "neutral_mass", "neutral_masses": "neutral_mass"},
    "mz_semantics_study_b": {"": "auto", "unknown": "auto", "ion": "ion_mz", "mz": "ion_mz", "yes": "ion_mz", "measured": "ion_mz", "neutral": "neutral_mass", "neutral_masses": "neutral_mass"},
    "intensity_standardize": {"off": "none", "": "none"},
    "structure_corr_estimator": {"empirical": "sample", "none": "sample", "ledoitwolf": "ledoit_wolf", "lw": "ledoit_wolf"},
}


@dataclass(frozen=True)
class MatchConfig:
    ppm: float = 20.0
    rt: float = 0.0
    intensity_log_diff_max: float = 5.0
    intensity_standardize: str = "none"
    candidate_top_k_per_id1: int = 20
    top1_policy: str = "hybrid"
    top1_hybrid_local_p_min: float = 0.6
    top1_hybrid_local_margin_min: float = 0.2
    top1_hybrid_ot_margin_max: float = 0.1
    top1_hybrid_ot_null_override_max_p0: float = 1.0
    top1_hybrid_ot_null_override_max_row_neff: float = 0.0
    decision_min_prob_match: float = 0.0
    decision_min_margin: float = 0.0
    decision_min_prob_match_minus_null: float = 0.0
    decision_ambig_min_n_candidates: int = 0
    decision_ambig_min_row_neff_ot: float = 0.0
    decision_ambig_min_prob_match: float = 0.0
    decision_ambig_min_margin: float = 0.0
    decision_ambig_min_prob_match_minus_null: float = 0.0
    rt_gate_mode: str = "none"
    rt_gate_disable_p95: float = 1.0
    rt_gate_anchor_ppm: float | None = None
    rt_gate_min_count: int = 25
    mz_semantics_study_a: str = "auto"
    mz_semantics_study_b: str = "auto"
    mz_global_shift_model: str = "auto"
    mz_global_shift_anchor_ppm: float = 5.0
    mz_global_shift_min_anchors: int = 25
    mz_global_shift_min_gain: int = 5
    mz_global_shift_max_eval: int = 5000
    retention_mode: str = "auto"
    retention_min_finite_frac: float = 0.5
    retention_min_unique: int = 20
    retention_min_unique_frac: float = 0.01
    retention_round_decimals: int = 3
    normalize_rt_units: bool = True
    rt_transferability: str = "auto"
    rt_transfer_anchor_ppm: float = 5.0
    rt_transfer_min_anchors: int = 25
    rt_transfer_spearman_min: float = 0.8
    rt_transfer_p95_abs_resid_max: float = 2.0
    rt_transfer_max_anchors: int = 5000
    rt_transfer_ransac_iters: int = 2000
    rt_transfer_min_inlier_frac: float = 0.02
    rt_transfer_use_unique_mz_mnn: bool = False
    retention_nontransferable_policy: str = "soft"
    retention_nontransferable_weight: float = 0.25
    tight_ppm: float = 7.0
    tight_rt: float = 0.0
    tight_roi: float = 0.0
    tight_anchor_strategy: str = "mnn"
    tight_intensity_log_diff: float = 5.0
    rt_spline_df: int = 10
    ppm_spline_df: int = 10
    roi_spline_df: int = 10
    rt_drift_x: str = "rt"
    rt_drift_model: str = "none"
    ppm_drift_model: str = "linear"
    roi_drift_model: str = "none"
    drift_fit_bootstrap: bool = False
    drift_bootstrap_seed: int = 0
    use_intensity: bool = False
    w_ppm: float = 1.0
    w_rt: float = 1.0
    w_roi: float = 1.0
    w_int: float = 0.0
    use_cv: bool = False
    w_cv: float = 0.0
    t_df: float = 3.0
    scale_floor: float = 0.001
    use_anchor_scales: bool = True
    anchor_scale_min_count: int = 30
    ot_mode: str = "unbalanced"
    ot_epsilon: float = 0.5
    ot_max_iter: int = 200
    ot_tol: float = 0.0001
    ot_min_mass: float = 1e-12
    ot_unbalanced_lambda_row: float = 10.0
    ot_unbalanced_lambda_col: float = 0.5
    allow_unmatched: bool = True
    null_mass: float = 0.1
    null_loglik_quantile: float = 0.2
    null_loglik: float | None = None
    max_p0: float | None = None
    use_structure: bool = False
    structure_alpha: float = 0.0
    structure_k: int = 20
    structure_corr: str = "pearson"
    structure_corr_estimator: str = "sample"
    structure_abs: bool = True
    structure_min_samples: int = 25
    structure_graph: str = "knn"
    structure_graph_on_nontransferable_rt: str = "local_rt"
    structure_rt_window: float = 0.1
    structure_max_candidates: int = 200
    structure_n_boot: int = 10
    structure_subsample_frac: float = 0.8
    structure_min_freq: float = 0.6
    structure_adaptive_alpha: bool = False
    structure_margin_tau: float = 0.2
    structure_margin_gamma: float = 1.0
    structure_anneal: bool = False
    structure_alpha_ramp: bool = True
    structure_ot_epsilon_mult_start: float = 1.0
    structure_iters: int = 2
    structure_eps: float = 1e-08
    structure_bonus_mode: str = "mass"
    structure_alpha_on_nontransferable_rt: float = 10.0
    mz_col: str = "MZ"
    rt_col: str = "RT"
    annotation_col: str = "Annotation_ID"
    compound_id_col: str = "Compound_ID"
    intensity_col: str = "Intensity"
    mz_col_study_a: str | None = None
    mz_col_study_b: str | None = None
    rt_col_study_a: str | None = None
    rt_col_study_b: str | None = None
    annotation_col_study_a: str | None = None
    annotation_col_study_b: str | None = None
    compound_id_col_study_a: str | None = None
    compound_id_col_study_b: str | None = None
    polarity: str = "positive"

    def __post_init__(self) -> None:
        for name, words in CHOICES.items():
            value = str(getattr(self, name)).strip().lower().replace("-", "_")
            value = ALIASES.get(name, {}).get(value, value)
            if value not in words:
                raise ValueError(f"unsupported {name}: {getattr(self, name)!r} (one of {', '.join(words)})")
            object.__setattr__(self, name, value)
