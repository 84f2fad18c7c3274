"""Command line: ``match`` two studies, ``cluster`` many, ``reuse`` cached analyses, ``find`` among them."""

from __future__ import annotations

import argparse
import json
import platform
import sys
import time
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmatch.operators import cluster
from specmatch.plans import finder, reuse
from specmatch.plans.config import MatchConfig
from specmatch.plans.match import match_features, with_ids
from specmatch.session import cut
from specmatch.sources import metadata, readers


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _json(path: Path, data: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, indent=2, sort_keys=True, default=str))


def _manifest(spark: SparkSession, args: argparse.Namespace, began: str, seconds: float, path: Path, outputs: list[str], extras: dict) -> None:
    _json(path, {"schema_version": "run_manifest.v1", "command": args.cmd, "started_utc": began, "ended_utc": _now(), "runtime_seconds": seconds, "python": sys.version, "platform": platform.platform(), "spark": spark.version, "application": spark.sparkContext.applicationId, "parameters": {k: v for k, v in vars(args).items() if k != "cmd"}, "outputs": outputs, "extras": extras})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="specmatch", description=__doc__)
    sub = p.add_subparsers(dest="cmd", required=True)
    shift = argparse.ArgumentParser(add_help=False)
    shift.add_argument("--ppm", type=float, default=20.0)
    shift.add_argument("--rt", type=float, default=0.0)
    shift.add_argument("--tight-ppm", type=float, default=7.0)
    shift.add_argument("--tight-rt", type=float, default=0.0)
    shift.add_argument("--mz-global-shift-model", default="auto", choices=["auto", "none", "proton_only", "common_adducts"])
    shift.add_argument("--mz-global-shift-anchor-ppm", type=float, default=5.0)
    shift.add_argument("--mz-global-shift-min-anchors", type=int, default=25)
    shift.add_argument("--mz-global-shift-min-gain", type=int, default=5)
    shift.add_argument("--mz-global-shift-max-eval", type=int, default=5000)
    shift.add_argument("--capture-manifest", action=argparse.BooleanOptionalAction, default=True)
    shift.add_argument("--out-manifest")
    m = sub.add_parser("match", parents=[shift])
    m.add_argument("study_a")
    m.add_argument("study_b")
    m.add_argument("--out-candidates", required=True)
    m.add_argument("--out-top1")
    m.add_argument("--use-intensity", action="store_true")
    m.add_argument("--no-intensity", dest="use_intensity", action="store_false")
    m.add_argument("--allow-unmatched", action=argparse.BooleanOptionalAction, default=True)
    m.add_argument("--null-mass", type=float, default=0.1)
    m.add_argument("--mz-col", default="MZ")
    m.add_argument("--rt-col", default="RT")
    m.add_argument("--intensity-col", default="Intensity")
    m.add_argument("--polarity", default="positive", choices=["positive", "negative"])
    m.add_argument("--mz-semantics-a", default="auto", choices=["auto", "ion_mz", "neutral_mass"])
    m.add_argument("--mz-semantics-b", default="auto", choices=["auto", "ion_mz", "neutral_mass"])
    m.add_argument("--rt-transfer-min-inlier-frac", type=float, default=0.02)
    m.add_argument("--retention-nontransferable-policy", default="soft", choices=["disable", "soft"])
    m.add_argument("--retention-nontransferable-weight", type=float, default=0.25)
    many = argparse.ArgumentParser(add_help=False)
    many.add_argument("--out-dir", required=True)
    many.add_argument("--strategy", default="both", choices=["hub", "symmetric", "both"])
    many.add_argument("--hub-alignment", default="auto", choices=["auto", "mutual_top1", "barycenter"])
    many.add_argument("--full-join", action="store_true")
    many.add_argument("--no-export-expr", action="store_true")
    many.add_argument("--polarity", choices=["positive", "negative"])
    many.add_argument("--drift-fit-bootstrap", action=argparse.BooleanOptionalAction, default=False)
    many.add_argument("--drift-bootstrap-seed", type=int, default=0)
    c = sub.add_parser("cluster", parents=[shift, many])
    c.add_argument("--manifest", required=True)
    c.add_argument("--hub-id")
    r = sub.add_parser("reuse", parents=[shift, many])
    r.add_argument("--analysis-id", action="append", default=[])
    r.add_argument("--analysis-file")
    r.add_argument("--cache-dir", required=True)
    r.add_argument("--min-group-size", type=int, default=2)
    r.add_argument("--allow-unknown-strata", action="store_true")
    r.add_argument("--use-intensity", default="off", choices=["off", "auto", "on"])
    f = sub.add_parser("find")
    f.add_argument("--cache-dir", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--text", default="")
    f.add_argument("--facet", action="append", default=[], help="name=value, several times")
    return p


def _config(args: argparse.Namespace) -> MatchConfig:
    names = ("ppm", "rt", "tight_ppm", "tight_rt", "mz_global_shift_model", "mz_global_shift_anchor_ppm", "mz_global_shift_min_anchors", "mz_global_shift_min_gain", "mz_global_shift_max_eval")
    return MatchConfig(**{n: getattr(args, n) for n in names})


def run_strategies(features: DataFrame, expr: DataFrame, cfg: MatchConfig, args: argparse.Namespace, out: Path, sem: dict[str, str]) -> list[str]:
    n = features.select("study_id").distinct().count()
    expr_ = None if args.no_export_expr else expr
    results = []
    if args.strategy in ("hub", "both"):
        soft = args.hub_alignment == "barycenter" or (args.hub_alignment == "auto" and n >= 3)
        hub = getattr(args, "hub_id", None)
        results.append(cluster.template_clusters(features, cfg, hub, expr_, full=args.full_join) if soft else cluster.hub_mutual(features, cfg, hub, expr_, args.full_join, sem))
    if args.strategy in ("symmetric", "both"):
        results.append(cluster.symmetric(features, cfg, expr_, sem))
    outputs = []
    for r in results:
        at = out / r.strategy if len(results) > 1 else out
        readers.write_table(r.metadata, str(at / "cluster_metadata.tsv"), "\t")
        readers.write_table(r.cluster_map, str(at / "cluster_map.tsv"), "\t")
        outputs += [str(at / "cluster_metadata.tsv"), str(at / "cluster_map.tsv")]
        if r.expression is not None:
            clusters = [x[0] for x in r.metadata.select("cluster_id").orderBy("cluster_id").collect()]
            for (s,) in features.select("study_id").distinct().collect():
                readers.write_wide(r.expression.where(F.col("study_id") == s), str(at / f"cluster_expr_{s}.tsv.gz"), clusters)
                outputs.append(str(at / f"cluster_expr_{s}.tsv.gz"))
        _json(at / "diagnostics.json", r.diagnostics | {"strategy": r.strategy})
    return outputs


def _load(spark: SparkSession, specs: list[readers.StudySpec]) -> tuple[DataFrame, DataFrame]:
    features = expr = None
    for s in specs:
        f, x = readers.load_study(spark, s)
        features, expr = (f, x) if features is None else (features.unionByName(f), expr.unionByName(x))
    return features, expr


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("specmatch").getOrCreate()
    began, t0 = _now(), time.perf_counter()
    if args.cmd == "match":
        cfg = replace(_config(args), use_intensity=args.use_intensity, allow_unmatched=args.allow_unmatched, null_mass=args.null_mass, mz_col=args.mz_col, rt_col=args.rt_col, intensity_col=args.intensity_col, polarity=args.polarity, mz_semantics_study_a=args.mz_semantics_a, mz_semantics_study_b=args.mz_semantics_b, rt_transfer_min_inlier_frac=args.rt_transfer_min_inlier_frac, retention_nontransferable_policy=args.retention_nontransferable_policy, retention_nontransferable_weight=args.retention_nontransferable_weight)
        a, b = with_ids(readers.read_features(spark, args.study_a)), with_ids(readers.read_features(spark, args.study_b))
        res = match_features(a, b, cfg)
        readers.write_table(res.candidates, args.out_candidates)
        outputs = [args.out_candidates]
        if args.out_top1:
            readers.write_table(res.top1, args.out_top1)
            outputs.append(args.out_top1)
        extras = {"n_features_study_a": a.count(), "n_features_study_b": b.count(), "n_candidates": res.candidates.count(), "n_top1_rows": res.top1.count()}
        where = Path(args.out_manifest or f"{args.out_candidates}.manifest.json")
    elif args.cmd == "cluster":
        specs = readers.load_manifest(args.manifest)
        polarity = args.polarity or next(iter({s.polarity for s in specs})) if len({s.polarity for s in specs}) == 1 or args.polarity else None
        if polarity is None:
            raise ValueError("the manifest mixes polarities; give --polarity")
        features, expr = _load(spark, specs)
        cfg = replace(_config(args), polarity=polarity, drift_fit_bootstrap=args.drift_fit_bootstrap, drift_bootstrap_seed=args.drift_bootstrap_seed)
        outputs = run_strategies(features, expr, cfg, args, Path(args.out_dir), {s.analysis_id: str(s.metadata.get("ms_results_has_mz_semantics", "")) for s in specs})
        extras, where = {"n_studies": len(specs)}, Path(args.out_manifest or Path(args.out_dir) / "run_manifest.json")
    elif args.cmd == "reuse":
        outputs, extras = _reuse(spark, args)
        where = Path(args.out_manifest or Path(args.out_dir) / "run_manifest.json")
    else:
        meta = metadata.metadata(metadata.read_cache(spark, args.cache_dir))
        chosen: dict[str, set[str]] = {}
        for x in args.facet:
            name, _, value = x.partition("=")
            chosen.setdefault(name, set()).add(value)
        left = finder.facet_filter(finder.text_filter(meta, ["analysis_id", "study_id", "study_title", "institute", "subject_species", "sample_type"], args.text), chosen)
        finder.write_selection(args.out, [r[0] for r in left.select("analysis_id").collect()], began)
        return 0
    if args.capture_manifest:
        _manifest(spark, args, began, time.perf_counter() - t0, where, outputs, extras)
    return 0


def _reuse(spark: SparkSession, args: argparse.Namespace) -> tuple[list[str], dict]:
    """Groups of compatible cached analyses, each clustered; a group that fails is recorded and the others go on."""
    out, ids = Path(args.out_dir), readers.analysis_ids(args.analysis_id, args.analysis_file)
    if not ids:
        raise ValueError("no analysis ids")
    docs = metadata.read_cache(spark, args.cache_dir)
    meta = metadata.metadata(docs).where(F.col("analysis_id").isin(ids))
    meta = cut(meta.withColumn("ion_mode", F.col("ion_mode_norm")).withColumn("chromatography", F.col("chromatography_norm")))
    if meta.isEmpty():
        raise ValueError("none of the analyses is in the cache")
    readers.write_table(meta.orderBy("analysis_id"), str(out / "analysis_metadata.tsv"), "\t")
    kept, dropped = reuse.group_analyses(meta, args.min_group_size, args.allow_unknown_strata)
    readers.write_table(dropped.orderBy("analysis_id", "reason"), str(out / "dropped_analyses.tsv"), "\t")
    names = metadata.labelled_metabolites(docs.withColumn("analysis_id", F.col("analysis_id_hint")).drop("path", "analysis_id_hint")).where(F.col("analysis_id").isin(ids))
    names = cut(names)
    readers.write_table(names.orderBy("analysis_id", "name", "seq"), str(out / "analysis_labeled_metabolites.tsv"), "\t")
    outputs = [str(out / n) for n in ("analysis_metadata.tsv", "dropped_analyses.tsv", "analysis_labeled_metabolites.tsv")]
    groups, failed = {}, {}
    for r in kept.orderBy("analysis_id").collect():  # the analyses asked for on the command line
        groups.setdefault(r["group_id"], []).append(r)
    for g, rows in sorted(groups.items()):
        at = out / "groups" / g
        try:
            own = names.where(F.col("analysis_id").isin([r["analysis_id"] for r in rows]))
            readers.write_table(reuse.shared_all(own, len(rows)), str(at / "shared_all.tsv"), "\t")
            readers.write_table(reuse.shared_pairs(own), str(at / "shared_pairs.tsv"), "\t")
            specs = [readers.StudySpec(r["analysis_id"], "mw_special_rows", f"{args.cache_dir}/{r['analysis_id']}.untarg.tsv", polarity=r["ion_mode"] if r["ion_mode"] in ("positive", "negative") else "positive") for r in rows]
            features, expr = _load(spark, specs)
            use, standardise, reason = reuse.resolve_intensity(kept.where(F.col("group_id") == g), args.use_intensity)
            cfg = replace(_config(args), polarity=args.polarity or specs[0].polarity, use_intensity=use, w_int=1.0 if use else 0.0, intensity_standardize=standardise)
            outputs += run_strategies(features, expr, cfg, args, at, {r["analysis_id"]: r["ms_results_has_mz_semantics"] for r in rows})
            _json(at / "group_manifest.json", {"group_id": g, "analysis_ids": [r["analysis_id"] for r in rows], "use_intensity": use, "use_intensity_reason": reason})
        except Exception as e:  # one group's failure is recorded, the others go on
            failed[g] = f"{type(e).__name__}: {e}"
    extras = {"n_requested": len(ids), "n_groups": len(groups), "n_groups_failed": len(failed), "failed": failed}
    _json(out / "reuse_summary.json", extras)
    return outputs, extras


if __name__ == "__main__":
    sys.exit(main())
