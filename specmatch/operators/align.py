"""Global alignment of two studies: constant mass shifts, retention transfer, retention quality and gates."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specmatch.functions.columns import ADDUCTS_NEGATIVE, ADDUCTS_POSITIVE, PROTON
from specmatch.operators import bandjoin, stats
from specmatch.plans.config import MatchConfig


def shift_candidates(model: str, polarity: str) -> list[float]:
    """Shifts in Da, none first, then by size."""
    if model == "none":
        return [0.0]
    if model == "proton_only":
        return [0.0, PROTON if polarity == "positive" else -PROTON]
    masses = [PROTON, *(v for k, v in (ADDUCTS_POSITIVE if polarity == "positive" else ADDUCTS_NEGATIVE).items() if k != "H")]
    return [0.0, *sorted({s * x for x in masses for s in (1, -1)}, key=lambda v: (abs(v), v))]


def shift_counts(a: DataFrame, b: DataFrame, shifts: list[tuple[float, float]], ppm: float) -> DataFrame:
    """(k, sa, sb, n): how many features are each other's nearest in mass, within ``ppm`` of the one that asks, after
    shift k of either study. All shifts in one job: the shift's number is a join key beside the mass bin."""
    table = a.sparkSession.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(shifts)], "k int, sa double, sb double")
    left = a.select("id", "mz").crossJoin(F.broadcast(table)).select("k", "id", (F.col("mz") + F.col("sa")).alias("mz")).where("mz > 0")
    right = b.select("id", "mz").crossJoin(F.broadcast(table)).select("k", "id", (F.col("mz") + F.col("sb")).alias("mz")).where("mz > 0")

    def best(q: DataFrame, t: DataFrame) -> DataFrame:
        q = q.select("k", F.col("id").alias("q"), F.col("mz").alias("mq")).withColumn("_bin", F.explode(F.array(*[bandjoin.bin_of(F.col("mq"), ppm) + i for i in (-1, 0, 1)])))
        t = t.select("k", F.col("id").alias("t"), F.col("mz").alias("mt")).withColumn("_bin", bandjoin.bin_of(F.col("mt"), ppm))
        near = q.join(t, ["k", "_bin"]).where((F.col("mt") >= F.col("mq") - F.col("mq") * ppm / 1e6) & (F.col("mt") <= F.col("mq") + F.col("mq") * ppm / 1e6))
        w = Window.partitionBy("k", "q").orderBy(F.abs(F.col("mt") - F.col("mq")), F.desc("mt"), "t")
        return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("k", "q", "t")

    both = best(left, right).join(best(right, left).select("k", F.col("q").alias("t"), F.col("t").alias("q")), ["k", "q", "t"])
    return F.broadcast(table).join(both.groupBy("k").agg(F.count("*").alias("n")), "k", "left").select("k", "sa", "sb", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@dataclass(frozen=True)
class Shift:
    a: float = 0.0
    b: float = 0.0
    best: int = 0
    zero: int = 0
    model: str = "none"
    applied: bool = False
    note: str = "not_applied"


def infer_shift(a: DataFrame, b: DataFrame, cfg: MatchConfig) -> Shift:
    """The one-sided constant shift that gives the most anchors, if they are enough and enough more than without.

    Every feature is counted: the join is a hash join over shifts and bins, so there is no need to sample ``mz_global_shift_max_eval`` of them.
    """
    if cfg.mz_global_shift_model == "none":
        return Shift(note="disabled")
    auto, sem = cfg.mz_global_shift_model == "auto", (cfg.mz_semantics_study_a, cfg.mz_semantics_study_b)
    if auto and sem == ("ion_mz", "ion_mz"):
        return Shift(note="auto_skip_both_ion_mz")
    model = "proton_only" if auto else cfg.mz_global_shift_model
    ppm = cfg.mz_global_shift_anchor_ppm or 5.0
    side = None
    if auto and sem[0] == "ion_mz":
        side = "b"
    elif auto and sem[1] == "ion_mz":
        side = "a"
    pairs = [(0.0, 0.0)]
    for s in shift_candidates(model, cfg.polarity)[1:]:
        pairs += [(s, 0.0)] * (side != "b") + [(0.0, s)] * (side != "a")
    rows = shift_counts(a, b, pairs, ppm).collect()  # one row for each shift
    zero = next(r.n for r in rows if not r.sa and not r.sb)
    top = min(rows, key=lambda r: (-r.n, bool(r.sa) + bool(r.sb), abs(r.sa) + abs(r.sb), r.sa, r.sb))
    gain = cfg.mz_global_shift_min_gain or 5
    if auto and "neutral_mass" not in sem:
        gain = max(gain, 25)
    moved = bool(top.sa or top.sb)
    apply = moved and top.n >= (cfg.mz_global_shift_min_anchors or 25) and top.n >= zero + gain
    note = ""
    if not apply and model == "proton_only" and zero <= 1 and top.n >= 5:
        apply, note = moved, "low_anchor_apply|"
    return Shift(top.sa if apply else 0.0, top.sb if apply else 0.0, top.n, zero, model, apply, note + ("applied" if apply else "not_applied"))


@dataclass(frozen=True)
class Transfer:
    policy: str = "unknown"
    scale: float = 1.0
    offset: float = 0.0
    n_anchors: int = 0
    n_inliers: int = 0
    spearman: float = math.nan
    p95: float = math.nan
    note: str = ""

    @property
    def inlier_frac(self) -> float:
        return self.n_inliers / self.n_anchors if self.n_anchors and self.note != "too_few_anchors" else math.nan


def _rank(x: np.ndarray) -> np.ndarray:
    _, back, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[back]


def fit_transfer(rt1: np.ndarray, rt2: np.ndarray, cfg: MatchConfig) -> Transfer:
    """A line from study B's retention to A's that most anchors agree on, and whether it may be trusted."""
    n, least = len(rt1), cfg.rt_transfer_min_anchors or 25
    if n < least:
        return Transfer(n_anchors=n, note="too_few_anchors")
    rng = np.random.default_rng(0)
    tol = float(np.clip(0.05 * min(np.ptp(rt1), np.ptp(rt2)), 0.2, 1.0))
    best = (0, 1.0, 0.0)
    for _ in range(min(cfg.rt_transfer_ransac_iters or 2000, max(200, 2 * n))):
        i, j = rng.choice(n, 2, replace=False)
        dx = rt2[j] - rt2[i]
        if abs(dx) <= 1e-6:
            continue
        slope = (rt1[j] - rt1[i]) / dx
        if slope <= 0:
            continue
        offset = rt1[i] - slope * rt2[i]
        hits = int((np.abs(rt1 - (slope * rt2 + offset)) <= tol).sum())
        if hits > best[0]:
            best = (hits, slope, offset)
    hits, slope, offset = best
    if not hits:
        return Transfer(n_anchors=n, note="ransac_failed")
    inside = np.abs(rt1 - (slope * rt2 + offset)) <= tol
    x, y = rt2[inside], rt1[inside]
    sxx = ((x - x.mean()) ** 2).sum()
    refit = float(((x - x.mean()) * (y - y.mean())).sum() / sxx) if sxx > 1e-12 else 0.0
    if refit > 0:
        slope, offset = refit, float(y.mean() - refit * x.mean())
    # else the line that the most anchors agree on stays
    slope, offset = float(np.clip(slope, 1 / 120, 120)), float(offset)
    p95 = float(np.quantile(np.abs(y - (slope * x + offset)), 0.95))
    rho = float(np.corrcoef(_rank(x), _rank(y))[0, 1]) if len(x) > 2 else math.nan
    good = hits >= least and rho >= (cfg.rt_transfer_spearman_min or 0.8) and p95 <= (cfg.rt_transfer_p95_abs_resid_max or 2.0) and hits / n >= (cfg.rt_transfer_min_inlier_frac or 0.1)
    return Transfer("linear" if good else "ignore", slope, offset, n, hits, rho, p95)


def infer_transfer(a: DataFrame, b: DataFrame, cfg: MatchConfig) -> Transfer:
    """The transfer fitted on mutual nearest masses. At most ``rt_transfer_max_anchors`` pairs of numbers reach the
    driver, drawn by a hash of their ids."""
    ppm = cfg.rt_transfer_anchor_ppm or 5.0
    there, back = bandjoin.asof(a, b, ppm), bandjoin.asof(b, a, ppm)
    anchors = there.join(back.select(F.col("id1").alias("id2"), F.col("id2").alias("id1")), ["id1", "id2"])
    if cfg.rt_transfer_use_unique_mz_mnn:
        alone = bandjoin.band_join(a, b, ppm)
        one = alone.withColumn("_a", F.count("*").over(Window.partitionBy("id1"))).withColumn("_b", F.count("*").over(Window.partitionBy("id2"))).where("_a = 1 AND _b = 1").select("id1", "id2")
        unique = anchors.join(one, ["id1", "id2"])
        if unique.count() >= (cfg.rt_transfer_min_anchors or 25):
            anchors = unique
    got = anchors.where("rt1 IS NOT NULL AND rt2 IS NOT NULL").select("id1", "rt1", "rt2").orderBy(F.xxhash64("id1", "id2")).limit(cfg.rt_transfer_max_anchors or 5000).toPandas().sort_values("id1")
    return fit_transfer(got["rt1"].to_numpy(float), got["rt2"].to_numpy(float), cfg)


def soft_weight(t: Transfer, cfg: MatchConfig) -> float:
    """The weight of retention where it does not transfer; what is not known does not count."""
    w = cfg.retention_nontransferable_weight or 0.25
    if math.isfinite(t.spearman):
        w *= min(max(t.spearman / (cfg.rt_transfer_spearman_min or 0.8), 0.0), 1.0)
    if math.isfinite(t.p95):
        w *= min(max((cfg.rt_transfer_p95_abs_resid_max or 2.0) / max(t.p95, 1e-12), 0.0), 1.0)
    if math.isfinite(t.inlier_frac) and t.inlier_frac > 0:
        w *= min(max(math.sqrt(t.inlier_frac / 0.1), 0.0), 1.0)
    return w


def without_retention(cfg: MatchConfig) -> MatchConfig:
    return replace(cfg, w_rt=0.0, w_roi=0.0, rt=0.0, tight_rt=0.0, tight_roi=0.0, rt_drift_model="none", roi_drift_model="none")


def retention_ok(df: DataFrame, cfg: MatchConfig) -> bool:
    """Whether enough retentions are known and differ."""
    return enough_retention(*stats.rt_quality(df, "rt", cfg.retention_round_decimals or 3).first(), cfg)


def enough_retention(n: int, finite: int, unique: int, cfg: MatchConfig) -> bool:
    return bool(n) and finite / n >= (cfg.retention_min_finite_frac or 0.5) and (unique >= (cfg.retention_min_unique or 20) or unique / max(finite, 1) >= (cfg.retention_min_unique_frac or 0.01))


def drift_p95(a: DataFrame, b: DataFrame, ppm: float, least: int) -> float:
    """The 95 % quantile of retention differences of nearest masses; not a number below ``least`` of them."""
    n, p95 = bandjoin.nearest(a, b, ppm).where("rt1 IS NOT NULL AND rt2 IS NOT NULL").agg(F.count("*"), F.percentile(F.abs(F.col("rt2") - F.col("rt1")), 0.95)).first()
    return math.nan if n < least or p95 is None else float(p95)
