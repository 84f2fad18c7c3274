"""Clusters of features over many studies: hub, symmetric graph, and template strategies.

A study is a row set of one stacked table (study_id, feature_id, MZ, RT, Intensity); expression is long
(study_id, sample_id, feature_id, v). Wide matrices exist at the sink only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specmatch.operators import decide, stats
from specmatch.operators.components import connected_components
from specmatch.plans.config import MatchConfig
from specmatch.session import cut


@dataclass(frozen=True)
class ClusterResult:
    strategy: str
    metadata: DataFrame
    cluster_map: DataFrame
    expression: DataFrame | None
    diagnostics: dict[str, Any]


def hub_scores(expr: DataFrame, detect_min: float = 0.05) -> DataFrame:
    """(study_id, score): features detected in enough samples, times log1p of the samples."""
    rate = expr.groupBy("study_id", "feature_id").agg(F.avg(F.coalesce(F.col("v") > 0, F.lit(False)).cast("double")).alias("r"))
    n = expr.groupBy("study_id").agg(F.countDistinct("sample_id").alias("n"))
    return rate.groupBy("study_id").agg(F.sum((F.col("r") >= detect_min).cast("long")).alias("d")).join(n, "study_id").select("study_id", (F.col("d") * F.log1p(F.col("n").cast("double"))).alias("score"))


def full_map(hub: DataFrame, others: DataFrame, matches: DataFrame) -> DataFrame:
    """(cluster_id, study_id, feature_id) of a full join: the hub's own rows, matched features, and a cluster of its own for each feature left."""
    own = hub.select(F.col("feature_id").alias("cluster_id"), "study_id", "feature_id")
    alone = others.select("study_id", "feature_id").join(matches.select("study_id", "feature_id"), ["study_id", "feature_id"], "left_anti")
    return own.unionByName(matches.select("cluster_id", "study_id", "feature_id")).unionByName(alone.select(F.concat_ws("__", "study_id", "feature_id").alias("cluster_id"), "study_id", "feature_id"))


def pick(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, study, node): of each study's members of a component the one with the largest sum of edge weights; ties to the smallest node."""
    both = edges.select(F.col("a").alias("node"), "w").unionByName(edges.select(F.col("b").alias("node"), "w"))
    w = nodes.join(both.groupBy("node").agg(F.sum("w").alias("_w")), "node", "left")
    return w.withColumn("_n", F.row_number().over(Window.partitionBy("component", "study").orderBy(F.coalesce("_w", F.lit(0.0)).desc(), "node"))).where("_n = 1").select("component", "study", "node")


def expression_of(cluster_map: DataFrame, expr: DataFrame) -> DataFrame:
    """(study_id, sample_id, cluster_id, v): a cluster a study lacks has no row, a measured zero has one."""
    return expr.join(cluster_map, ["study_id", "feature_id"]).select("study_id", "sample_id", "cluster_id", "v")


def cluster_metadata(members: DataFrame, by: str = "cluster_id") -> DataFrame:
    """Medians and number of studies of each cluster, from its members (cluster_id, study_id, MZ, RT, Intensity)."""
    return members.groupBy(by).agg(F.percentile("MZ", 0.5).alias("mz_med"), F.percentile("RT", 0.5).alias("rt_med"), F.percentile("Intensity", 0.5).alias("intensity_med"), F.countDistinct("study_id").alias("n_studies"))


def _study(features: DataFrame, study: str) -> DataFrame:
    from specmatch.plans.match import with_ids

    own = features.where(F.col("study_id") == study).select("feature_id", "MZ", "RT", "Intensity")
    # ids settle ties between equal masses: names that are numbers go by their value, so 9 is before 10
    return cut(with_ids(own.orderBy(F.col("feature_id").try_cast("long").asc_nulls_last(), "feature_id")))


def _ids(features: DataFrame) -> list[str]:
    return [r[0] for r in features.select("study_id").distinct().orderBy("study_id").collect()]


def _semantics(cfg: MatchConfig, sem: dict[str, str], a: str, b: str) -> MatchConfig:
    pick_ = lambda own, s: own if own != "auto" else {"neutral_masses": "neutral_mass", "yes": "ion_mz"}.get(sem.get(s, ""), "auto")
    return replace(cfg, mz_semantics_study_a=pick_(cfg.mz_semantics_study_a, a), mz_semantics_study_b=pick_(cfg.mz_semantics_study_b, b))


def mutual_pairs(features: DataFrame, a: str, b: str, cfg: MatchConfig, sem: dict[str, str] | None = None) -> DataFrame:
    """(feature_a, feature_b, w) chosen from both sides; w is the larger probability."""
    from specmatch.plans.match import match_features

    fa, fb = _study(features, a), _study(features, b)
    ab = match_features(fa, fb, _semantics(cfg, sem or {}, a, b)).top1
    ba = match_features(fb, fa, _semantics(cfg, sem or {}, b, a)).top1
    got = decide.mutual_top1(ab, ba).join(ab.select("id1", F.col("prob_raw").alias("w")), "id1")
    return got.join(fa.select(F.col("id").alias("id1"), F.col("feature_id").alias("feature_a")), "id1").join(fb.select(F.col("id").alias("id2"), F.col("feature_id").alias("feature_b")), "id2").select("feature_a", "feature_b", "w")


def choose_hub(features: DataFrame, expr: DataFrame | None) -> str:
    size = features.groupBy("study_id").agg(F.count("*").cast("double").alias("score"))
    if expr is not None:
        known = hub_scores(expr).withColumnRenamed("score", "s")
        size = size.join(known, "study_id", "left").select("study_id", F.coalesce("s", "score").alias("score"))
    best = size.orderBy(F.desc("score"), "study_id").first()
    if best is None:
        raise ValueError("no studies")
    return best["study_id"]


def hub_mutual(features: DataFrame, cfg: MatchConfig, hub: str | None = None, expr: DataFrame | None = None, full: bool = False, sem: dict[str, str] | None = None) -> ClusterResult:
    """Each study's features that choose, and are chosen by, a feature of the hub."""
    ids = _ids(features)
    hub = hub or choose_hub(features, expr)
    if hub not in ids:
        raise ValueError(f"hub {hub!r} is not among the studies")
    found = None
    for s in ids:
        if s != hub:
            m = mutual_pairs(features, s, hub, cfg, sem).select(F.col("feature_b").alias("cluster_id"), F.lit(s).alias("study_id"), F.col("feature_a").alias("feature_id"))
            found = m if found is None else found.unionByName(m)
    own = features.where(F.col("study_id") == hub)
    if found is None:
        found = own.limit(0).select(F.col("feature_id").alias("cluster_id"), "study_id", "feature_id")
    found = cut(found)
    cmap = full_map(own, features.where(F.col("study_id") != hub), found) if full else found
    base = own.select(F.col("feature_id").alias("cluster_id"), "MZ", "RT", "Intensity")
    if full:
        alone = cmap.where(F.col("cluster_id") == F.concat_ws("__", "study_id", "feature_id")).join(features, ["study_id", "feature_id"])
        base = base.unionByName(alone.select("cluster_id", "MZ", "RT", "Intensity"))
    whole = cmap if full else own.select(F.col("feature_id").alias("cluster_id"), "study_id", "feature_id").unionByName(cmap)
    return ClusterResult("hub_mutual_top1_full" if full else "hub_mutual_top1", base, cmap, None if expr is None else expression_of(whole, expr), {"hub_id": hub, "n_studies": len(ids), "include_unmatched": full, "n_clusters": base.count()})


def symmetric(features: DataFrame, cfg: MatchConfig, expr: DataFrame | None = None, sem: dict[str, str] | None = None) -> ClusterResult:
    """Components of the graph of mutual choices over all pairs of studies; each keeps one feature of a study."""
    ids = _ids(features)
    if len(ids) < 2:
        raise ValueError("symmetric clustering needs two studies or more")
    from specmatch.plans.match import with_ids

    nodes = cut(with_ids(features.orderBy("study_id", "feature_id"), "node"))
    edges = None
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            m = mutual_pairs(features, a, b, cfg, sem).select(F.lit(a).alias("sa"), "feature_a", F.lit(b).alias("sb"), "feature_b", "w")
            edges = m if edges is None else edges.unionByName(m)
    left = nodes.select(F.col("study_id").alias("sa"), F.col("feature_id").alias("feature_a"), F.col("node").alias("a"))
    right = nodes.select(F.col("study_id").alias("sb"), F.col("feature_id").alias("feature_b"), F.col("node").alias("b"))
    edges = cut(edges.join(left, ["sa", "feature_a"]).join(right, ["sb", "feature_b"]).select("a", "b", "w"))
    comp = nodes.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("study", F.col("study_id"))
    kept = pick(comp.select("node", "component", "study"), edges).join(nodes, "node")
    number = kept.select("component").distinct().withColumn("cluster_id", F.format_string("C%05d", F.row_number().over(Window.orderBy("component"))))
    cmap = cut(kept.join(number, "component").select("cluster_id", "study_id", "feature_id", "MZ", "RT", "Intensity"))
    meta = cluster_metadata(cmap)
    cmap = cmap.select("cluster_id", "study_id", "feature_id")
    return ClusterResult("symmetric_mutual_graph", meta, cmap, None if expr is None else expression_of(cmap, expr), {"n_studies": len(ids)})


def _template(features: DataFrame, hub: str) -> DataFrame:
    return _study(features, hub).withColumnRenamed("feature_id", "cluster_id")


def _to_template(features: DataFrame, study: str, template: DataFrame, cfg: MatchConfig, top_k: int) -> tuple[DataFrame, DataFrame]:
    """(soft edges with the study's values, choices that are also their column's largest share) against a template."""
    from specmatch.plans.match import match_features

    own = _study(features, study)
    res = match_features(own, template.select("id", "MZ", "RT", "Intensity"), cfg)
    named = lambda e: e.join(own.select(F.col("id").alias("id1"), "feature_id", "MZ", "RT", "Intensity"), "id1").join(template.select(F.col("id").alias("id2"), "cluster_id"), "id2")
    w = Window.partitionBy("id1").orderBy(F.desc("p_row_ot"), "mz2", "id2")
    soft = res.candidates.where("p_row_ot > 0").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_k).select("id1", "id2", F.col("p_row_ot").alias("w"))
    hard = decide.one_direction_mutual(res.top1, res.candidates)
    return named(soft).withColumn("study_id", F.lit(study)), named(hard).select("cluster_id", F.lit(study).alias("study_id"), "feature_id", "MZ", "RT", "Intensity")


def template_clusters(features: DataFrame, cfg: MatchConfig, hub: str | None = None, expr: DataFrame | None = None, rounds: int = 2, soft: bool = True, top_k: int = 3, full: bool = False) -> ClusterResult:
    """A template that starts as the hub and moves to where the studies' features lie: to the weighted median of soft
    matches (``soft``) or to the median of mutual ones; the last template is matched once more for the result."""
    ids = _ids(features)
    hub = hub or choose_hub(features, expr)
    if hub not in ids:
        raise ValueError(f"hub {hub!r} is not among the studies")
    template = _template(features, hub)
    size = template.count()
    prior = (1.0 - cfg.null_mass) / max(size, 1) if soft else 1.0
    for _ in range(rounds):
        rows = template.select("cluster_id", "MZ", "RT", "Intensity", F.lit(prior).alias("w"))
        for s in ids:
            if s != hub:
                e, hard = _to_template(features, s, template, cfg, top_k)
                rows = rows.unionByName(e.select("cluster_id", "MZ", "RT", "Intensity", "w") if soft else hard.select("cluster_id", "MZ", "RT", "Intensity", F.lit(1.0).alias("w")))
        rows = cut(rows)
        new = template.select("id", "cluster_id")
        for c in ("MZ", "RT", "Intensity"):
            mid = stats.weighted_median(rows, ["cluster_id"], c, "w").withColumnRenamed(f"{c}_wmed", c) if soft else rows.groupBy("cluster_id").agg(F.percentile(c, 0.5).alias(c))
            new = new.join(mid, "cluster_id", "left")
        template = cut(new)
    found = None
    for s in ids:
        if s != hub:
            hard = _to_template(features, s, template, cfg, top_k)[1].select("cluster_id", "study_id", "feature_id")
            found = hard if found is None else found.unionByName(hard)
    own = features.where(F.col("study_id") == hub)
    self_map = own.select(F.col("feature_id").alias("cluster_id"), "study_id", "feature_id")
    found = cut(found) if found is not None else self_map.limit(0)
    cmap = full_map(own, features.where(F.col("study_id") != hub), found) if full else found
    counts = (cmap if full else self_map.unionByName(found)).groupBy("cluster_id").agg(F.countDistinct("study_id").alias("n_studies"))
    meta = template.select("cluster_id", "MZ", "RT", "Intensity")
    if full:
        alone = cmap.join(self_map.select("cluster_id"), "cluster_id", "left_anti").join(features, ["study_id", "feature_id"])
        meta = meta.unionByName(alone.select("cluster_id", "MZ", "RT", "Intensity"))
    name = ("hub_barycenter_ot" if soft else "hub_consensus_template_ot") + ("_full" if full else "")
    return ClusterResult(name, meta.join(counts, "cluster_id", "left"), cmap, None if expr is None else expression_of(cmap if full else self_map.unionByName(found), expr), {"hub_id": hub, "n_studies": len(ids), "n_iters": rounds})
