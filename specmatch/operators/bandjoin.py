"""Band joins on relative mass tolerance, as equi-joins on logarithmic bins.

A partner of m lies in [m - m*t, m + m*t]; with bins of width -ln(1 - t) on ln(mass) it lies in m's bin or one beside
it. The left side is listed under three bins, the join is an equality of bins with the exact test behind it, so Spark
plans a hash or sort-merge join, splits a hot bin as it does any skewed key, and broadcasts only below its own threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specmatch.functions.columns import ppm_over_mean
from specmatch.operators.windows import nearest


def _left(a: DataFrame) -> DataFrame:
    return a.select(*[F.col(c).alias(f"{c}1") for c in a.columns])


def _right(b: DataFrame) -> DataFrame:
    return b.select(*[F.col(c).alias(f"{c}2") for c in b.columns])


def bin_of(mz: Column, ppm: float) -> Column:
    return F.floor(F.ln(mz) / F.lit(-math.log(1 - ppm * 1e-6)))


def band_join(a: DataFrame, b: DataFrame, ppm: float, rt: float = 0.0, center: Column | None = None) -> DataFrame:
    """Pairs whose mz2 lies within ``ppm`` of mz1 (both ends included; relative to mz1). With ``rt`` > 0 pairs known to be
    further apart in retention go; an unknown difference stays. ``center``: another left mass to search around."""
    left = _left(a).where("mz1 > 0").withColumn("_at", F.col("mz1") if center is None else center).where("_at > 0")
    left = left.withColumn("_bin", F.explode(F.array(*[bin_of(F.col("_at"), ppm) + k for k in (-1, 0, 1)])))
    right = _right(b).where("mz2 > 0").withColumn("_bin", bin_of(F.col("mz2"), ppm))
    tol = F.col("_at") * ppm / 1e6
    out = left.join(right, "_bin").where((F.col("mz2") >= F.col("_at") - tol) & (F.col("mz2") <= F.col("_at") + tol)).drop("_bin", "_at")
    if rt > 0:
        out = out.where(~F.coalesce(F.abs(F.col("rt2") - F.col("rt1")) > rt, F.lit(False)))
    return out


def swap(pairs: DataFrame) -> DataFrame:
    return pairs.select(*[F.col(c).alias(c[:-1] + ("2" if c[-1] == "1" else "1")) for c in pairs.columns])


def mutual(a: DataFrame, b: DataFrame, ppm: float, rt: float = 0.0) -> DataFrame:
    """Pairs that are each other's nearest; each side searches its own window."""
    back = nearest(b, a, ppm, rt).select(F.col("id1").alias("id2"), F.col("id2").alias("id1"))
    return nearest(a, b, ppm, rt).join(back, ["id1", "id2"])


def asof(a: DataFrame, b: DataFrame, ppm: float) -> DataFrame:
    """For each left row the right row least apart in Da (the higher mass on a tie), if it is within ``ppm`` of the mean."""
    wide = band_join(a, b, ppm * 1.001)
    w = Window.partitionBy("id1").orderBy(F.abs(F.col("mz2") - F.col("mz1")), F.col("mz2").desc(), "id2")
    best = wide.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return best.where(F.abs(ppm_over_mean(F.col("mz1"), F.col("mz2"))) <= ppm)
