"""Finding analyses: text and facet filters, facet counts, and the selection file."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "<missing>"


def text_filter(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows whose columns, joined by blanks, contain the needle in any case."""
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(needle.strip().lower()))


def _values(df: DataFrame, facet: str) -> Column:
    """A facet's values of a row as an array: several, one, or the missing one."""
    c = F.col(facet)
    if dict(df.dtypes)[facet].startswith("array"):
        return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, c).otherwise(F.array(F.lit(MISSING)))
    s = F.trim(c.cast("string"))
    return F.array(F.when(s.isNull() | (s == ""), F.lit(MISSING)).otherwise(s))


def facet_filter(df: DataFrame, chosen: dict[str, set[str]], but: str | None = None) -> DataFrame:
    """Rows with one of the chosen values in every facet; ``but`` leaves a facet out."""
    for facet, values in chosen.items():
        if facet != but and values:
            df = df.where(F.arrays_overlap(_values(df, facet), F.array(*[F.lit(v) for v in sorted(values)])))
    return df


def facet_counts(df: DataFrame, facet: str, chosen: dict[str, set[str]] | None = None) -> DataFrame:
    """(value, n) of a facet among the rows that the other facets' choices leave."""
    left = facet_filter(df, chosen or {}, facet)
    return left.select(F.explode(_values(left, facet)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def disease_counts(df: DataFrame) -> DataFrame:
    """(disease, n) distinct studies of each disease, the most first."""
    return df.groupBy("disease").agg(F.countDistinct("study_id").alias("n")).orderBy(F.desc("n"), F.lower("disease"))


def drill_down(diseases: DataFrame, summaries: DataFrame, disease: str) -> DataFrame:
    """A disease's studies with their summaries, if any."""
    return diseases.where(F.col("disease") == disease).select("study_id").distinct().join(summaries, "study_id", "left")


def write_selection(path: str, analysis_ids: list[str], created: str) -> None:
    with open(path, "w") as f:
        json.dump({"schema_version": "workbench_selection.v1", "created_utc": created, "analysis_ids": sorted(set(analysis_ids))}, f, indent=2, sort_keys=True)
