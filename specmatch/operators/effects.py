"""Effect sizes of clusters between two outcomes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of numbers of 0 or more: its series up to 3, its continued fraction above."""
    low, high = np.minimum(x, 3.0), np.maximum(x, 3.0)
    term = total = low
    for k in range(1, 80):
        term = term * 2 * low * low / (2 * k + 1)
        total = total + term
    tail = np.ones_like(high)
    for k in range(80, 0, -1):
        tail = 1 + k / (2 * high * high) / tail
    return np.where(x < 3, 1 - 2 / np.sqrt(np.pi) * np.exp(-low * low) * total, np.exp(-high * high) / (high * np.sqrt(np.pi) * tail))


def _two_sided(z: Column) -> Column:
    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:  # Spark has no erfc
        return pd.Series(erfc(np.abs(x.to_numpy(float)) / np.sqrt(2)))

    return F.when(z.isNotNull(), p(F.coalesce(z, F.lit(0.0))))


def hedges_g(values: DataFrame) -> DataFrame:
    """(cluster_id, hedges_g, se, z, p) from (cluster_id, outcome 0/1, v): values as log1p; unknown below two per side or without spread."""
    x = F.log1p(F.col("v"))
    one, two = F.when(F.col("outcome") == 1, x), F.when(F.col("outcome") == 0, x)
    s = values.where(F.col("v").isNotNull()).groupBy("cluster_id").agg(F.count(one).alias("n1"), F.count(two).alias("n0"), F.avg(one).alias("m1"), F.avg(two).alias("m0"), F.var_samp(one).alias("s1"), F.var_samp(two).alias("s0"))
    n1, n0 = F.col("n1"), F.col("n0")
    sp = F.sqrt(((n1 - 1) * F.col("s1") + (n0 - 1) * F.col("s0")) / F.greatest(n1 + n0 - 2, F.lit(1)))
    good = (n1 >= 2) & (n0 >= 2) & (sp > 0)
    g = F.when(good, (1.0 - 3.0 / (4.0 * (n1 + n0) - 9.0)) * (F.col("m1") - F.col("m0")) / sp)
    s = s.withColumn("hedges_g", g).withColumn("se", F.when(good, F.sqrt((n1 + n0) / (n1 * n0) + F.col("hedges_g") * F.col("hedges_g") / (2.0 * (n1 + n0 - 2)))))
    s = s.withColumn("z", F.when(F.col("se") > 0, F.col("hedges_g") / F.col("se")))
    return s.select("cluster_id", "hedges_g", "se", "z", _two_sided(F.col("z")).alias("p"))
