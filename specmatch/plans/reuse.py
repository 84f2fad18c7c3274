"""Reuse of public analyses: compatible groups, shared metabolites, and whether intensities may be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_analyses(analyses: DataFrame, least: int = 2, allow_unknown: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept with group_id, dropped with reason): analyses of one ion mode and chromatography, ``least`` to a group or more."""
    unknown = ~F.col("ion_mode").isin("positive", "negative") | F.col("chromatography").isin("unknown", "other")
    marked = analyses.withColumn("_u", F.lit(False) if allow_unknown else unknown).withColumn("group_id", F.concat_ws("__", "ion_mode", "chromatography"))
    sized = marked.where("NOT _u").withColumn("_n", F.count("*").over(Window.partitionBy("group_id")))
    small = sized.where(F.col("_n") < least).select("analysis_id", F.lit("group_below_min_size").alias("reason"))
    return sized.where(F.col("_n") >= least).drop("_u", "_n"), marked.where("_u").select("analysis_id", F.lit("unknown_strata").alias("reason")).unionByName(small)


def best_names(labelled: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One row for each (analysis_id, name): the best source, then the first seen (``seq``)."""
    rank = F.lit(len(priority))
    for source, k in priority.items():
        rank = F.when(F.col("source") == source, k).otherwise(rank)
    w = Window.partitionBy("analysis_id", "name").orderBy(rank, "seq")
    return labelled.where("name IS NOT NULL AND name != ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def shared_all(names: DataFrame, n_analyses: int) -> DataFrame:
    """Names that every analysis has."""
    return names.groupBy("name").agg(F.countDistinct("analysis_id").alias("_n")).where(F.col("_n") == n_analyses).select("name")


def shared_pairs(names: DataFrame) -> DataFrame:
    """(analysis_1, analysis_2, name) of names that two analyses share. Grows with the square of the analyses that share a name, as the table asked for does."""
    one = names.select("analysis_id", "name").distinct()
    a, b = one.select(F.col("analysis_id").alias("analysis_1"), "name"), one.select(F.col("analysis_id").alias("analysis_2"), "name")
    return a.join(b, "name").where("analysis_1 < analysis_2").select("analysis_1", "analysis_2", "name")


def resolve_intensity(analyses: DataFrame, mode: str = "off") -> tuple[bool, str, str]:
    """(use, standardisation, reason): whether a group's intensities compare. ``auto`` asks for raw-like values of one
    family of instruments; any other word than on and auto is off."""
    mode = (mode or "off").strip().lower()
    if mode not in ("on", "auto"):
        return False, "none", "use_intensity_off"
    if mode == "on":
        return True, "robust_zscore", "use_intensity_on"
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    scales, instruments = analyses.agg(F.collect_set(low("value_scale")), F.countDistinct(F.when(low("instrument_type") != "", low("instrument_type")))).first()
    for bad, reason in ((("log_transformed", "scaled"), "scaled_or_log_values"), (("normalized",), "normalized_values"), (("unknown",), "unknown_value_scale")):
        if set(bad) & set(scales):
            return False, "none", f"auto_disabled_{reason}"
    if instruments > 1:
        return False, "none", "auto_disabled_mixed_instrument_families"
    return True, "robust_zscore", "auto_enabled_raw_like_single_instrument_family"
