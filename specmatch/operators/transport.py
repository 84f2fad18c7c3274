"""Row softmax with a null option, and entropic optimal transport on sparse edges (id1, id2, ll)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specmatch.operators import stats
from specmatch.session import cut

def _row() -> Window:
    return Window.partitionBy("id1")


def top_k(edges: DataFrame, k: int, score: str = "ll") -> DataFrame:
    """The k best edges of each left row; ties by mz2 and id2."""
    w = _row().orderBy(F.col(score).desc_nulls_last(), "mz2", "id2")
    return edges.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def null_loglik(edges: DataFrame, quantile: float = 0.2, score: str = "ll") -> float:
    got = stats.quantiles(edges, {score: F.col(score)}, quantile)[score]
    return -10.0 if got is None else got


def row_softmax(edges: DataFrame, null: float | None, temperature: float = 1.0, score: str = "ll") -> DataFrame:
    """``p_row`` and ``p0`` of each edge: the null option counts in the denominator, not in the row's maximum. Rows with the same
    scores get the same doubles: a row is summed from its best score down."""
    whole = _row().orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = edges.withColumn("_top", F.max(score).over(_row())).withColumn("_e", F.exp((F.col(score) - F.col("_top")) / temperature))
    none = F.lit(0.0) if null is None else F.exp((F.lit(null) - F.col("_top")) / temperature)
    e = e.withColumn("_z", F.sum("_e").over(whole) + none)
    return e.withColumn("p_row", F.col("_e") / F.col("_z")).withColumn("p0", none / F.col("_z")).drop("_top", "_e", "_z")


def ranked_softmax(rows: DataFrame, null: float | None, temperature: float = 1.0) -> DataFrame:
    """``row_softmax`` of rows whose scores ``ll`` are a list, the best first: ``p_row`` is a list that never rises, ``p0`` a
    number. The same doubles, without an exchange or a sort."""
    top = F.col("ll")[0]
    none = F.lit(0.0) if null is None else F.exp((F.lit(null) - top) / temperature)
    e = rows.withColumn("_none", none).withColumn("_e", F.transform(F.col("ll"), lambda x: F.exp((x - top) / temperature)))
    e = e.withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda s, x: s + x) + F.col("_none"))
    return e.withColumn("p_row", F.transform("_e", lambda x: x / F.col("_z"))).withColumn("p0", F.col("_none") / F.col("_z")).drop("_none", "_e", "_z")


def _term(c: Column) -> Column:
    return F.when(c > 0, -c * F.ln(c)).otherwise(0.0)


def ranked_entropy(rows: DataFrame) -> DataFrame:
    """``row_entropy`` of ``ranked_softmax`` rows."""
    return rows.select("id1", (F.aggregate("p_row", F.lit(0.0), lambda s, x: s + _term(x)) + _term(F.col("p0"))).alias("entropy")).withColumn("neff", F.exp("entropy"))


def row_entropy(edges: DataFrame, p: str = "p_row", p0: str = "p0") -> DataFrame:
    """(id1, entropy, neff): of a row's probabilities, null included."""
    rows = edges.groupBy("id1").agg(F.sum(_term(F.col(p))).alias("_h"), F.max(p0).alias("_p0"))
    return rows.select("id1", (F.col("_h") + _term(F.coalesce("_p0", F.lit(0.0)))).alias("entropy")).withColumn("neff", F.exp("entropy"))


@dataclass(frozen=True)
class Sinkhorn:
    epsilon: float = 0.5
    max_iter: int = 200
    tol: float = 1e-4
    min_mass: float = 1e-12
    tau_row: float = 1.0
    tau_col: float = 1.0
    null_mass: float | None = 0.1  # None: every row must be matched


def _kernel(edges: DataFrame, s: Sinkhorn, null: float | None, score: str) -> DataFrame:
    """(id1, id2, k): id2 = -1 is the null column; the row's maximum includes it."""
    real = edges.select("id1", "id2", F.col(score).alias("ll"))
    if s.null_mass is not None:
        real = real.unionByName(edges.select("id1").distinct().select("id1", F.lit(-1).cast("long").alias("id2"), F.lit(null).alias("ll")))
    return real.withColumn("k", F.exp((F.col("ll") - F.max("ll").over(_row())) / s.epsilon)).drop("ll")


def sinkhorn(edges: DataFrame, s: Sinkhorn, null: float | None = None, score: str = "ll") -> DataFrame:
    """``edges`` with ot_weight, p_row_ot and p0_ot, scaled over the cluster.

    An iteration is one aggregation by row and one by column, and passes over the edges twice: its scalings, joined by key, are
    materialised in the shared folder, so none is computed again for the next or for the stopping rule, which is looked at every
    tenth iteration. Nothing is collected.
    """
    k = cut(_kernel(edges, s, null, score))
    v = cut(k.select("id2").distinct().withColumn("v", F.lit(1.0)))
    n_rows, n_cols = k.select("id1").distinct().count(), v.where("id2 >= 0").count()
    mass = min(max(s.null_mass, 0.0), 0.9) if s.null_mass is not None else 0.0
    a = 1.0 / max(n_rows, 1)
    b = F.when(F.col("id2") < 0, mass).otherwise((1.0 - mass) / max(n_cols, 1))
    u = k.select("id1").distinct().withColumn("u", F.lit(1.0))
    for i in range(s.max_iter):
        was = (u, v)
        u = cut(k.join(v, "id2").groupBy("id1").agg(F.sum(F.col("k") * F.col("v")).alias("_s")).select("id1", F.pow(F.lit(a) / F.greatest("_s", F.lit(s.min_mass)), s.tau_row).alias("u")))
        v = cut(k.join(u, "id1").groupBy("id2").agg(F.sum(F.col("k") * F.col("u")).alias("_s")).select("id2", F.pow(b / F.greatest("_s", F.lit(s.min_mass)), s.tau_col).alias("v")))
        if i % 10 == 0 and i < s.max_iter - 1 and s.tol > 0:
            if s.tau_row == s.tau_col == 1.0:
                w = k.join(u, "id1").join(v, "id2").select("id1", "id2", (F.col("k") * F.col("u") * F.col("v")).alias("w"))
                worst = max(w.groupBy("id1").agg(F.sum("w").alias("s")).agg(F.max(F.abs(F.col("s") - a))).first()[0] or 0, w.groupBy("id2").agg(F.sum("w").alias("s")).agg(F.max(F.abs(F.col("s") - b))).first()[0] or 0)
            elif i:
                worst = max(u.join(was[0].withColumnRenamed("u", "_u"), "id1").agg(F.max(F.abs(F.col("u") - F.col("_u")))).first()[0] or 0, v.join(was[1].withColumnRenamed("v", "_v"), "id2").agg(F.max(F.abs(F.col("v") - F.col("_v")))).first()[0] or 0)
            else:
                worst = float("inf")
            if worst < s.tol:
                break
    # by row last: the sums of rows need no exchange of their own then
    w = k.join(v, "id2").join(u, "id1").select("id1", "id2", (F.col("k") * F.col("u") * F.col("v")).alias("ot_weight"))
    return _normalise(edges, w)


def _normalise(edges: DataFrame, w: DataFrame) -> DataFrame:
    total = F.sum("ot_weight").over(_row())
    w = w.withColumn("p_row_ot", F.when(total > 0, F.col("ot_weight") / total).otherwise(0.0)).withColumn("p0_ot", F.coalesce(F.max(F.when(F.col("id2") < 0, F.col("p_row_ot"))).over(_row()), F.lit(0.0)))
    return edges.join(w.where("id2 >= 0"), ["id1", "id2"])


def sinkhorn_by_pair(edges: DataFrame, s: Sinkhorn, score: str = "ll", quantile: float = 0.2) -> DataFrame:
    """The same for many study pairs at once: each pair's edges (at most a few per feature) are scaled in one task, pairs in parallel. Needs ``pair_id``; returns (pair_id, id1, id2, ot_weight, p_row_ot, p0_ot)."""

    def scale(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id1", "id2"], kind="stable")
        got = scale_arrays(pdf["id1"].to_numpy(), pdf["id2"].to_numpy(), pdf[score].to_numpy(float), s, quantile)
        return pd.DataFrame({"pair_id": pdf["pair_id"].to_numpy(), "id1": pdf["id1"].to_numpy(), "id2": pdf["id2"].to_numpy(), "ot_weight": got[0], "p_row_ot": got[1], "p0_ot": got[2]})

    kind = dict(edges.dtypes)["pair_id"]
    return edges.select("pair_id", "id1", "id2", score).groupBy("pair_id").applyInPandas(scale, f"pair_id {kind}, id1 long, id2 long, ot_weight double, p_row_ot double, p0_ot double")


def scale_arrays(id1: np.ndarray, id2: np.ndarray, ll: np.ndarray, s: Sinkhorn, quantile: float = 0.2, null: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sinkhorn over one pair's edges in numpy: weights, row probabilities, and the row's null probability."""
    rows, r = np.unique(id1, return_inverse=True)
    cols, c = np.unique(id2, return_inverse=True)
    n, m, real = len(rows), len(cols), len(ll)
    a = np.full(n, 1.0 / max(n, 1))
    if s.null_mass is not None:
        mass = min(max(s.null_mass, 0.0), 0.9)
        b = np.append(np.full(m, (1 - mass) / max(m, 1)), mass)
        null = float(np.quantile(ll, quantile)) if null is None else null
        r, c, ll = np.append(r, np.arange(n)), np.append(c, np.full(n, m)), np.append(ll, np.full(n, null))
        m += 1
    else:
        b = np.full(m, 1.0 / max(m, 1))
    top = np.full(n, -np.inf)
    np.maximum.at(top, r, ll)
    k = np.exp((ll - top[r]) / s.epsilon)
    u, v = np.ones(n), np.ones(m)
    for i in range(s.max_iter):
        pu, pv = u, v
        u = (a / np.maximum(np.bincount(r, k * v[c], n), s.min_mass)) ** s.tau_row
        v = (b / np.maximum(np.bincount(c, k * u[r], m), s.min_mass)) ** s.tau_col
        if i % 10 == 0 or i == s.max_iter - 1:
            if s.tau_row == s.tau_col == 1.0:
                w = k * u[r] * v[c]
                worst = max(np.abs(np.bincount(r, w, n) - a).max(initial=0), np.abs(np.bincount(c, w, m) - b).max(initial=0))
            else:
                worst = max(np.abs(u - pu).max(initial=0), np.abs(v - pv).max(initial=0)) if i else np.inf
            if worst < s.tol:
                break
    w = k * u[r] * v[c]
    total = np.bincount(r, w, n)
    total[total <= 0] = 1
    p = w / total[r]
    p0 = np.zeros(n)
    if s.null_mass is not None:
        p0 = p[real:]
    return w[:real], p[:real], p0[r[:real]]




def sinkhorn_auto(edges: DataFrame, s: Sinkhorn, null: float | None, score: str = "ll", most: int = 2_000_000) -> DataFrame:
    """One task scales a pair of up to ``most`` edges (some 50 MB) with the exact stopping rule; above it, the cluster does."""
    if edges.count() > most:
        return sinkhorn(edges, s, null, score)

    def scale(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id1", "id2"], kind="stable")
        w, p, p0 = scale_arrays(pdf["id1"].to_numpy(), pdf["id2"].to_numpy(), pdf["ll"].to_numpy(float), s, 0.0, null)
        return pd.DataFrame({"id1": pdf["id1"].to_numpy(), "id2": pdf["id2"].to_numpy(), "ot_weight": w, "p_row_ot": p, "p0_ot": p0})

    slim = edges.select(F.lit(0).alias("g"), "id1", "id2", F.col(score).alias("ll"))
    return edges.join(slim.groupBy("g").applyInPandas(scale, "id1 long, id2 long, ot_weight double, p_row_ot double, p0_ot double"), ["id1", "id2"])
