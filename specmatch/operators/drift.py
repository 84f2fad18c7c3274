"""Drift models: what an anchor's difference depends on. A model is data, a line or knots, and compiles into a column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmatch.operators import stats

LEAST = 10


@dataclass(frozen=True)
class Drift:
    kind: str = "none"
    intercept: float = 0.0
    slope: float = 0.0
    knots: tuple[tuple[float, float], ...] = ()

    def at(self, x: Column) -> Column:
        """The fitted value; lines over unknown x are unknown, no model is 0."""
        if self.kind == "none":
            return F.lit(0.0)
        if not self.knots:
            return F.lit(self.intercept) + F.lit(self.slope) * x
        xs, ys = F.array(*[F.lit(k[0]) for k in self.knots]), F.array(*[F.lit(k[1]) for k in self.knots])
        n = len(self.knots)
        i = F.least(F.greatest(F.size(F.filter(xs, lambda k: k <= x)), F.lit(1)), F.lit(n - 1))
        x0, x1, y0, y1 = F.element_at(xs, i), F.element_at(xs, i + 1), F.element_at(ys, i), F.element_at(ys, i + 1)
        inner = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
        return F.when(x <= self.knots[0][0], self.knots[0][1]).when(x >= self.knots[-1][0], self.knots[-1][1]).otherwise(inner)


def linear(anchors: DataFrame, x: str, y: str) -> Drift:
    n, slope, intercept = stats.ols(anchors, x, y).first()
    return Drift("linear", float(intercept or 0), float(slope or 0)) if n else Drift()


def robust_linear(anchors: DataFrame, x: str, y: str, eps: float = 1.35, rounds: int = 25, tol: float = 1e-8) -> Drift:
    """Huber's line by reweighted least squares; each round is one aggregation over the anchors."""
    now = linear(anchors, x, y)
    p = anchors.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    for _ in range(rounds):
        r = F.col("y") - (F.lit(now.intercept) + F.lit(now.slope) * F.col("x"))
        scale = float(stats.mad_scale(p, r, 1e-12).first()[0])
        w = F.when(F.abs(r) <= eps * scale, 1.0).otherwise(eps * scale / F.abs(r))
        s = p.withColumn("w", w).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("y")).alias("y")).first()
        if not s.w:
            return now
        mx, my = s.x / s.w, s.y / s.w
        sxy, sxx = p.withColumn("w", w).agg(F.sum(F.col("w") * (F.col("x") - mx) * (F.col("y") - my)), F.sum(F.col("w") * (F.col("x") - mx) * (F.col("x") - mx))).first()
        slope = sxy / sxx if sxx and sxx > 1e-12 else 0.0
        new = Drift("robust_linear", my - slope * mx, slope)
        done = abs(new.slope - now.slope) + abs(new.intercept - now.intercept) <= tol
        now = new
        if done:
            break
    return now


def _widths(x: np.ndarray, frac: float) -> np.ndarray:
    """The quantile ``frac`` of the distances from each of the sorted ``x`` to all of them: the nearest are a run of neighbours."""
    n = len(x)
    place = frac * (n - 1)
    m = min(int(place) + 2, n)
    here = np.arange(n)
    low, high = np.maximum(here - m + 1, 0), np.minimum(here, n - m)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        right = open_ & (x[np.minimum(mid + m, n - 1)] - x < x - x[mid])
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    left, top = x - x[low], x[low + m - 1] - x
    last = np.maximum(left, top)
    if m == 1:
        return last
    before = np.where(left >= top, np.maximum(x - x[np.minimum(low + 1, n - 1)], top), np.maximum(left, x[low + m - 2] - x))
    return before + (last - before) * (place - int(place)) if int(place) + 1 < n else last


def _smooth(x: np.ndarray, y: np.ndarray, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The local line at each of ``rows`` of the sorted points, weighted by the tricube of distance; where the width is 0 or the
    points do not fix a line, the mean of the points at that place."""
    out = np.empty(len(rows))
    begin, end = np.searchsorted(x, x[rows], "left"), np.searchsorted(x, x[rows], "right")
    first, last = np.searchsorted(x, x[rows] - h[rows], "left"), np.searchsorted(x, x[rows] + h[rows], "right")
    for k, (row, a, b) in enumerate(zip(rows.tolist(), first.tolist(), last.tolist(), strict=True)):
        at, xs, ys = x[row], x[a:b], y[a:b]
        own = y[begin[k] : end[k]].mean()
        if h[row] <= 0:
            out[k] = own
            continue
        w = np.clip(1 - (np.abs(xs - at) / h[row]) ** 3, 0, None) ** 3
        sw = w.sum()
        if sw <= 0:
            out[k] = own
            continue
        mx, my = (w * xs).sum() / sw, (w * ys).sum() / sw
        sxx = (w * (xs - mx) ** 2).sum()
        out[k] = my + (w * (xs - mx) * (ys - my)).sum() / sxx * (at - mx) if sw * sxx >= 1e-12 else own
    return out


def _sorted(x: np.ndarray, y: np.ndarray, df: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points in order of x, their widths, and the first row of each distinct x."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    return x, y, _widths(x, min(max(df / len(x), 0.1), 1.0)), np.flatnonzero(np.r_[True, x[1:] != x[:-1]])


def lowess_knots(x: np.ndarray, y: np.ndarray, df: int) -> tuple[tuple[float, float], ...]:
    """A local line at each distinct x over the nearest share ``df / n`` of the points, weighted by the tricube of distance."""
    x, y, h, rows = _sorted(x, y, df)
    return tuple(zip(x[rows].tolist(), _smooth(x, y, h, rows).tolist()))


def lowess_curve(anchors: DataFrame, x: str, y: str, df: int, local: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The distinct x and their fitted values, each over every anchor. The driver and each task hold the anchors as two
    numbers; with more than ``local`` of them the cluster fits the distinct x in blocks."""
    spark = anchors.sparkSession
    got = anchors.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).orderBy("x", "y").toPandas()
    if len(got) < LEAST:
        return np.zeros(0), np.zeros(0)
    xs, ys, h, rows = _sorted(got["x"].to_numpy(float), got["y"].to_numpy(float), df)
    if len(xs) <= local:
        return xs[rows], _smooth(xs, ys, h, rows)
    held = spark.sparkContext.broadcast((xs, ys, h))

    def block(batches):
        for b in batches:
            at = b["row"].to_numpy()
            yield b.assign(v=_smooth(*held.value, at))

    blocks = spark.createDataFrame([(int(r),) for r in rows], "row long").repartition(max(8, len(rows) // 2_000), "row")
    done = blocks.mapInPandas(block, "row long, v double").toPandas().sort_values("row")
    held.unpersist()
    return xs[done["row"].to_numpy()], done["v"].to_numpy(float)


def thin(xs: np.ndarray, ys: np.ndarray, off: float) -> np.ndarray:
    """Places of the knots between which straight lines stay within ``off`` of every point of the curve."""
    keep, todo = {0, len(xs) - 1}, [(0, len(xs) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        miss = np.abs(ys[a] + (ys[b] - ys[a]) * (xs[a + 1 : b] - xs[a]) / (xs[b] - xs[a]) - ys[a + 1 : b])
        if miss.max() > off:
            mid = a + 1 + int(miss.argmax())
            keep.add(mid)
            todo += [(a, mid), (mid, b)]
    return np.array(sorted(keep))


def lowess(anchors: DataFrame, x: str, y: str, df: int, most: int = 2000) -> Drift:
    """LOWESS on all anchors. Its knots become part of every task's expression: up to ``most`` are kept as they are; of more, those
    that keep the lines between them within a millionth of the curve's range at every anchor, however many that takes."""
    xs, ys = lowess_curve(anchors, x, y, df)
    if not len(xs):
        return Drift()
    if len(xs) > most:
        at = thin(xs, ys, 1e-6 * float(np.ptp(ys)))
        xs, ys = xs[at], ys[at]
    knots = tuple(zip(xs.tolist(), ys.tolist()))
    return Drift("lowess", knots=knots) if len(knots) > 1 else Drift("linear", knots[0][1], 0.0)


def fit(anchors: DataFrame, kind: str, x: str, y: str, df: int = 10) -> Drift:
    if kind == "none":
        return Drift()
    return {"linear": linear, "robust_linear": robust_linear}[kind](anchors, x, y) if kind != "lowess" else lowess(anchors, x, y, df)
