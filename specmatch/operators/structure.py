"""Correlation graphs over long expression tables (sample_id, feature_id, v), and the structure bonus."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specmatch.operators import products
from specmatch.session import cut

#: Features and values of a block, at most; samples of a dense chunk and sums held at once, some 30 MB each.
_BLOCK, _VALUES, _CHUNK, _CELLS = 32_768, 1_000_000, 1024, 4_000_000


def standardise(expr: DataFrame) -> DataFrame:
    """``z``: values of a feature about its mean over its samples, in sample deviations (1 where they do not vary)."""
    stat = expr.groupBy("feature_id").agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    return expr.join(stat, "feature_id").select("sample_id", "feature_id", ((F.col("v") - F.col("_m")) / F.when(F.col("_s") > 1e-8, F.col("_s")).otherwise(1.0)).alias("z"))


def ranked(expr: DataFrame) -> DataFrame:
    """Values of a feature as their average ranks over its samples, for correlation by rank."""
    w = Window.partitionBy("feature_id")
    place = F.rank().over(w.orderBy("v")) + (F.count("*").over(Window.partitionBy("feature_id", "v")) - 1) / 2
    return expr.where("v IS NOT NULL").select("sample_id", "feature_id", place.cast("double").alias("v"))


def correlate(z: DataFrame, pairs: DataFrame, n_samples: int) -> DataFrame:
    """``r`` of the given feature pairs (i, j): sums of products over shared samples."""
    zi, zj = z.select(F.col("feature_id").alias("i"), "sample_id", F.col("z").alias("zi")), z.select(F.col("feature_id").alias("j"), "sample_id", F.col("z").alias("zj"))
    return pairs.join(zi, "i").join(zj, ["j", "sample_id"]).groupBy("i", "j").agg((F.sum(F.col("zi") * F.col("zj")) / (n_samples - 1)).alias("r"))


def _products(left: pa.Table, right: pa.Table, k: int | None, least: float = 0.0) -> pa.Table:
    """(i, j, s) of two blocks of features: sums of products over shared samples, of ``least`` in size; with ``k`` the k largest of each i. Some left
    features go at a time, some ``_CELLS`` sums. Where few values are known only the products of known ones are made; else samples go by in chunks
    of dense slices."""
    fi, ri, si, zi = _sorted_block(left, ("feature_id", "sample_id", "z"), 0)
    fj, rj, sj, zj = _sorted_block(right, ("f2", "s2", "z2"), 1)
    samples, first, many = np.unique(sj, return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(samples, si), max(len(samples) - 1, 0))
    there = samples[at] == si if len(samples) else np.zeros(len(si), bool)
    ri, zi, at = ri[there], zi[there], at[there]
    rows, out = max(1, _CELLS // max(len(fj), 1)), []
    for low in range(0, len(fi), rows):
        n = min(rows, len(fi) - low)
        a = slice(*np.searchsorted(ri, (low, low + n)))
        r, z, p = ri[a] - low, zi[a], at[a]
        made = many[p]
        total, shared = np.zeros(n * len(fj)), np.zeros(n * len(fj), bool)
        if made.sum() * 50 < n * len(fj) * len(samples):
            ends, done = np.cumsum(made), 0
            while done < len(p):
                before = ends[done - 1] if done else 0
                to = max(done + 1, int(np.searchsorted(ends, before + _CELLS, "right")))
                own = made[done:to]
                y = np.arange(int(own.sum())) - np.repeat(ends[done:to] - own - before, own) + np.repeat(first[p[done:to]], own)
                cell = np.repeat(r[done:to] * len(fj), own) + rj[y]
                total += np.bincount(cell, np.repeat(z[done:to], own) * zj[y], len(total))
                shared[cell] = True
                done = to
            total, shared = total.reshape(n, -1), shared.reshape(n, -1)
        else:
            total, shared = total.reshape(n, -1), shared.reshape(n, -1)
            chunk = max(1, min(_CHUNK, _CELLS // max(len(fj), 1)))
            for c in range(0, len(samples), chunk):
                width = min(chunk, len(samples) - c)
                x, y = (np.zeros((m, width)) for m in (n, len(fj)))
                xs, ys = np.zeros((n, width), np.float32), np.zeros((len(fj), width), np.float32)
                here = (p >= c) & (p < c + width)
                x[r[here], p[here] - c], xs[r[here], p[here] - c] = z[here], 1
                b = slice(first[c], first[c + width - 1] + many[c + width - 1])
                cols = np.repeat(np.arange(width), many[c : c + width])
                y[rj[b], cols], ys[rj[b], cols] = zj[b], 1
                total += x @ y.T
                shared |= xs @ ys.T > 0
        good = shared & (fi[low : low + n, None] != fj[None, :]) & (np.abs(total) >= least)
        if k is not None and k < len(fj):
            score = np.where(good, np.abs(total), -1.0)
            i, j = np.nonzero(good & (score >= np.partition(score, len(fj) - k, axis=1)[:, len(fj) - k, None]))
            order = np.lexsort((j, -score[i, j], i))  # fj is in order: ties to the smaller j
            i, j = i[order], j[order]
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            kept = np.arange(len(i)) - np.repeat(starts, np.diff(starts, append=len(i))) < k
            i, j = i[kept], j[kept]
        else:
            i, j = np.nonzero(good)
        out.append((fi[low + i], fj[j], total[i, j]))
    i, j, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (fi, fi, np.empty(0))
    return pa.table({"i": i, "j": j, "s": s})


def _sorted_block(t: pa.Table, names: tuple[str, str, str], by: int) -> tuple[np.ndarray, ...]:
    """Distinct features and, in order of feature (0) or sample (1), each value's feature place, sample and value."""
    f, s, z = (np.asarray(t.column(c)) for c in names)
    f, r = np.unique(f, return_inverse=True)
    order = np.argsort((r, s)[by], kind="stable")
    return f, r[order], s[order], z[order]


def correlations(expr: DataFrame, n_samples: int, k: int | None = None, least: float = 0.0) -> DataFrame:
    """``r`` of every two features (i, j) that share a sample, in both orders; with ``k`` at least the k largest of each i, with ``least``
    those of that size. Where few values are known only their products are made (``products``); else dense blocks are multiplied."""
    stored = products.store(expr)
    try:
        met = products.pairs(stored, k, _bound(least, n_samples))
    finally:
        stored.drop()
    return _dense(expr, n_samples, k, least) if met is None else met.select("i", "j", (F.col("s") / (n_samples - 1)).alias("r"))


def _bound(least: float, n_samples: int) -> float:
    """Of sums of products, a little below: the exact test is the caller's."""
    return least * (n_samples - 1) * (1 - 1e-9)


def _dense(expr: DataFrame, n_samples: int, k: int | None = None, least: float = 0.0) -> DataFrame:
    """``correlations`` by dense products. Features are dealt to few large blocks, and each two blocks meet in one task: a value is sent once for each
    block, not once for each partner, and with ``k`` a task gives back k rows for a feature."""
    z = standardise(expr)
    features, known = expr.agg(F.countDistinct("feature_id"), F.count("*")).first()
    blocks = max(1, -(-features // _BLOCK), -(-known // _VALUES), min(4, features // 1024))
    own, every = F.pmod(F.xxhash64("feature_id"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = z.withColumn("p", own.cast("int")).withColumn("q", every)
    b = z.select(F.col("feature_id").alias("f2"), F.col("sample_id").alias("s2"), F.col("z").alias("z2"), own.cast("int").alias("q"), every.alias("p"))
    kind, bound = dict(expr.dtypes)["feature_id"], _bound(least, n_samples)
    met = a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInArrow(lambda x, y: _products(x, y, k, bound).cast(_pairs_schema(kind)), f"i {kind}, j {kind}, s double")
    return met.select("i", "j", (F.col("s") / (n_samples - 1)).alias("r"))


def _pairs_schema(kind: str) -> pa.Schema:
    name = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return pa.schema([("i", name), ("j", name), ("s", pa.float64())])


def shrunk(expr: DataFrame, n_samples: int) -> DataFrame:
    """``r`` of every two features that share a sample, from the covariance shrunk to its mean variance by as much as Ledoit and
    Wolf's formula says. Features without a value in a sample count as their mean there."""
    stat = expr.groupBy("feature_id").agg(F.avg("v").alias("_m"))
    x = expr.join(stat, "feature_id").select("sample_id", "feature_id", (F.col("v") - F.col("_m")).alias("z"))
    a, b = x.select("sample_id", F.col("feature_id").alias("i"), F.col("z").alias("zi")), x.select("sample_id", F.col("feature_id").alias("j"), F.col("z").alias("zj"))
    cross = a.join(b, "sample_id").groupBy("i", "j").agg(F.sum(F.col("zi") * F.col("zj")).alias("s"))
    n = float(n_samples)
    own = cross.where("i = j").agg(F.count("*").alias("p"), F.sum("s").alias("t")).first()
    delta = cross.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    beta = x.groupBy("sample_id").agg(F.sum(F.col("z") * F.col("z")).alias("q")).agg(F.sum(F.col("q") * F.col("q"))).first()[0] or 0.0
    p, trace = max(own["p"], 1), (own["t"] or 0.0) / n
    mean = trace / p
    spread = (delta / n**2 - 2 * mean * trace + p * mean * mean) / p
    noise = min((beta / n - delta / n**2) / (p * n), spread)
    weight = 0.0 if noise <= 0 or spread <= 0 else noise / spread
    d = cross.where("i = j").select("i", F.sqrt(F.greatest((1 - weight) * F.col("s") / n + weight * mean, F.lit(1e-8))).alias("d"))
    both = cross.where("i != j").join(d.withColumnRenamed("d", "di"), "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    return both.select("i", "j", ((1 - weight) * F.col("s") / n / (F.col("di") * F.col("dj"))).alias("r"))


def corr_knn(expr: DataFrame, k: int, n_samples: int, estimator: str = "sample", signed: bool = False) -> DataFrame:
    """(i, j, rank, w): each feature's k most correlated others among those that share a sample; weights sum to 1 in absolute value
    and, if ``signed``, keep the sign of the correlation.

    The work is that of the full matrix, in blocks; for wide studies use ``local_rt``, which bounds the partners of a feature.
    """
    return _nearest(shrunk(expr, n_samples) if estimator == "ledoit_wolf" else correlations(expr, n_samples, k), k, signed)


def _nearest(r: DataFrame, k: int, signed: bool = False) -> DataFrame:
    top = r.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.abs("r").desc(), "j"))).where(F.col("rank") <= k)
    return top.withColumn("w", (F.col("r") if signed else F.abs("r")) / F.greatest(F.sum(F.abs("r")).over(Window.partitionBy("i")), F.lit(1e-8)))


def rt_neighbours(features: DataFrame, window: float, half: int = 100) -> DataFrame:
    """(i, j, d_rt): features within ``window`` in retention and ``half`` places in its order. ``features``: (id, rt)."""
    cell = F.floor(F.col("rt") / window)
    f = features.where("rt IS NOT NULL").withColumn("_c", cell)
    n = f.groupBy("_c").agg(F.count("*").alias("_n"))
    n = n.withColumn("_before", F.sum("_n").over(Window.orderBy("_c")) - F.col("_n"))  # one row for each cell of the retention axis
    f = f.join(n, "_c").withColumn("_pos", F.col("_before") + F.row_number().over(Window.partitionBy("_c").orderBy("rt", "id")))
    a = f.select(F.col("id").alias("i"), F.col("rt").alias("rt1"), F.col("_pos").alias("p1"), F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1)).alias("_c"))
    b = f.select(F.col("id").alias("j"), F.col("rt").alias("rt2"), F.col("_pos").alias("p2"), "_c")
    out = a.join(b, "_c").where((F.col("i") != F.col("j")) & (F.abs(F.col("rt1") - F.col("rt2")) <= window) & (F.abs(F.col("p1") - F.col("p2")) <= half))
    return out.select("i", "j", (F.col("rt2") - F.col("rt1")).alias("d_rt"))


def local_rt(features: DataFrame, expr: DataFrame, window: float, k: int, n_samples: int, half: int = 100, signed: bool = False) -> DataFrame:
    return _nearest(correlate(standardise(expr), rt_neighbours(features, window, half).select("i", "j"), n_samples), k, signed)


def draws(expr: DataFrame, n_boot: int, share: float, seed: int = 0) -> DataFrame:
    """(boot_id, sample_id): ``n_boot`` draws of a share of the samples without replacement, in order of a seeded hash."""
    samples = expr.select("sample_id").distinct().withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    w = Window.partitionBy("boot_id")
    ranked = samples.withColumn("_n", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "boot_id", "sample_id"), "sample_id"))).withColumn("_all", F.count("*").over(w))
    return ranked.where(F.col("_n") <= F.greatest(F.lit(2), F.rint(F.lit(share) * F.col("_all")))).select("boot_id", "sample_id")


def stable_knn(expr: DataFrame, k: int, n_boot: int = 10, share: float = 0.8, freq: float = 0.6, seed: int = 0) -> DataFrame:
    """(i, j, n, w): at most k neighbours found in a share ``freq`` (above 1: a number) of the draws, the most often found first;
    weights are means over the draws that found them, and sum to 1."""
    least = max(math.ceil(freq * n_boot) if freq <= 1 else int(freq), 1)
    samples = cut(expr.select("sample_id").distinct())
    n = max(2, round(share * samples.count()))
    drawn = cut(draws(samples, n_boot, share, seed))
    found, stored = None, None
    try:
        for b in range(n_boot):
            if b % 62 == 0:  # a sample's draws are bits of one number
                if stored is not None:
                    stored.drop()
                bits = drawn.where(f"boot_id >= {b} AND boot_id < {b + 62}").groupBy("sample_id").agg(F.sum(F.expr(f"shiftleft(1L, boot_id - {b})")).alias("draws"))
                stored = products.store(expr.join(F.broadcast(bits), "sample_id"))
            met = products.pairs(stored, k, draw=b % 62)
            r = _dense(expr.join(drawn.where(F.col("boot_id") == b), "sample_id", "left_semi"), n, k) if met is None else met.select("i", "j", (F.col("s") / (n - 1)).alias("r"))
            own = _nearest(r, k).select("i", "j", "w")
            found = own if found is None else found.unionByName(own)
    finally:
        if stored is not None:
            stored.drop()
    kept = found.groupBy("i", "j").agg(F.count("*").alias("n"), F.sum("w").alias("_s")).where(F.col("n") >= least)
    top = kept.withColumn("_k", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), F.desc("_s"), "j"))).where(F.col("_k") <= k).withColumn("w", F.col("_s") / F.col("n"))
    return top.select("i", "j", "n", (F.col("w") / F.greatest(F.sum("w").over(Window.partitionBy("i")), F.lit(1e-8))).alias("w"))


def structure_bonus(edges: DataFrame, g1: DataFrame, g2: DataFrame, p: str = "p_row_ot", mode: str = "mass", eps: float = 1e-8, ids1: DataFrame | None = None, ids2: DataFrame | None = None) -> DataFrame:
    """``struct_bonus`` of each edge (i, j): the mass that neighbours of i send to neighbours of j, a sparse triple product.

    ``logmass`` is its logarithm. ``gw`` is minus the squared difference of both neighbourhoods, in units of a typical feature's sum of
    squared weights; ``ids1``, ``ids2`` (id) name the features that it is typical of (else: those with neighbours).
    """
    if mode not in ("mass", "logmass", "gw"):
        raise ValueError(f"unsupported structure_bonus_mode: {mode!r}")
    e = edges.select("id1", "id2")
    sent = edges.where(F.col(p) > 0).select(F.col("id1").alias("k"), F.col("id2").alias("l"), F.col(p).alias("_p"))
    got = e.join(g1.select(F.col("i").alias("id1"), F.col("j").alias("k"), F.col("w").alias("w1")), "id1").join(sent, "k").join(g2.select(F.col("i").alias("id2"), F.col("j").alias("l"), F.col("w").alias("w2")), ["id2", "l"])
    mass = got.groupBy("id1", "id2").agg(F.sum(F.col("w1") * F.col("_p") * F.col("w2")).alias("_m"))
    out = edges.join(mass, ["id1", "id2"], "left").withColumn("struct_bonus", F.coalesce("_m", F.lit(0.0))).drop("_m")
    if mode == "gw":
        typical = 0.0
        for side, g, ids in (("1", g1, ids1), ("2", g2, ids2)):
            square = g.groupBy(F.col("i").alias(f"id{side}")).agg(F.sum(F.col("w") * F.col("w")).alias(f"_q{side}"))
            every = square if ids is None else ids.select(F.col("id").alias(f"id{side}")).join(square, f"id{side}", "left")
            typical += 0.5 * (every.agg(F.percentile(F.coalesce(f"_q{side}", F.lit(0.0)), 0.5)).first()[0] or 0.0)
            out = out.join(square, f"id{side}", "left")
        cost = F.coalesce("_q1", F.lit(0.0)) + F.coalesce("_q2", F.lit(0.0)) - 2.0 * F.col("struct_bonus")
        return out.withColumn("struct_bonus", -cost / max(typical, eps)).drop("_q1", "_q2")
    return out if mode == "mass" else out.withColumn("struct_bonus", F.ln(F.col("struct_bonus") + eps))


def adaptive_weight(edges: DataFrame, tau: float, gamma: float, p: str = "p_row_ot") -> DataFrame:
    """``_trust`` of each edge: how much structure may say in its row, less the further the row's best option leads its second."""
    two = F.slice(F.sort_array(F.collect_list(F.col(p)).over(Window.partitionBy("id1")), False), 1, 2)
    lead = F.element_at(two, 1) - F.when(F.size(two) > 1, F.element_at(two, -1)).otherwise(0.0)
    return edges.withColumn("_trust", trust(lead, tau, gamma))


def trust(lead: Column, tau: float, gamma: float) -> Column:
    return F.pow(1.0 / (1.0 + F.greatest(lead, F.lit(0.0)) / tau), gamma)
