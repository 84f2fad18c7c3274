"""Quality classifier: a sparse rule ensemble.

Boosted shallow trees are grown on text statistics of a bounded labelled sample; every path from a root becomes a
conjunctive rule; a lasso logistic regression weighs rules and standardised statistics; the surviving rules compile
into one Spark column expression. Scoring is JVM-side only, and the model is a few hundred numbers whatever the input.

Edge cases: null or empty texts score through the same expression (all statistics are 0); repeated labels of a
document count once, the lower one; labels without a document, null labels and an empty label table are harmless
(without both classes the score is the smoothed share of label 1); labelled rows beyond ``FIT_ROWS`` are left out in order of a hash
of doc_id, ties by doc_id; equal scores mean equal decisions. ``classify`` replaces columns named like a measure, ``score`` or
``predicted``; ``stage`` carries columns of any names unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmatch.llm.frames import plain
from specmatch.llm.quality_rules import measure

STATISTICS = ("n_words", "mean_word", "symbol_ratio", "stop_ratio", "shout_ratio", "dup_line_ratio", "repeat_ratio", "n_lines", "n_dup_lines", "n_repeat_words")
#: Labelled rows a model is fitted on at most, taken in order of a hash of doc_id.
FIT_ROWS = 20_000


@dataclass(frozen=True)
class Model:
    intercept: float
    linear: tuple[tuple[str, float, float, float], ...]  # statistic, low, high (winsorised), weight
    rules: tuple[tuple[tuple[tuple[str, str, float], ...], float], ...]  # conditions, weight

    def score(self) -> Column:
        """P(label 1) as a native expression over the statistics."""
        total = F.lit(self.intercept)
        for name, low, high, weight in self.linear:
            total = total + F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high)) * F.lit(weight)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, side, at in conditions:
                holds = holds & ((F.col(name) <= F.lit(at)) if side == "<=" else (F.col(name) > F.lit(at)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(x: np.ndarray, edges: list[np.ndarray], codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[list, np.ndarray]:
    """One second-order regression tree; its paths, and its output per row."""
    paths, out = [], np.zeros(len(grad))

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        if left and len(rows) >= 2 * least:
            for f, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                c = codes[rows, f]
                gl = np.cumsum(np.bincount(c, grad[rows], len(cuts) + 1))[:-1]
                hl = np.cumsum(np.bincount(c, hess[rows], len(cuts) + 1))[:-1]
                n = np.cumsum(np.bincount(c, minlength=len(cuts) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(n < least) | (len(rows) - n < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            out[rows] = -g / (h + 1)
            return
        _, f, k = best
        low = codes[rows, f] <= k
        for side, part in (("<=", rows[low]), (">", rows[~low])):
            longer = (*path, (f, side, float(edges[f][k])))
            paths.append(longer)
            grow(part, longer, left - 1)

    grow(np.arange(len(grad)), (), depth)
    return paths, out


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient."""
    n, k = x.shape
    step = 4.0 / (float(np.linalg.eigvalsh((x.T @ x).astype(float))[-1]) / n + 1)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(x @ v.astype(np.float32) + c, -30, 30))) - y
        nw = v - step * (r.astype(np.float32) @ x) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = c - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS, trees: int = 40, depth: int = 3, penalty: float = 1e-3, rate: float = 0.2) -> Model:
    """A sparse rule ensemble of statistics ``x`` (rows by names) for labels ``y``."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(p / (1 - p))), (), ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 64)))[:-1] for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    margin, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        found, out = _tree(x, edges, codes, p - y, p * (1 - p), depth, max(5, len(y) // 500))
        margin += rate * out
        for path in found:
            ends: dict = {}
            for f, side, at in path:  # the tightest bound of each side
                ends[f, side] = min(at, ends.get((f, side), at)) if side == "<=" else max(at, ends.get((f, side), at))
            paths[tuple(sorted((f, s, at) for (f, s), at in ends.items()))] = None
    rules = list(paths)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    line = np.clip(x, low, high)
    spread = line.std(0) / 0.4
    spread[spread < 1e-9] = np.inf
    k = x.shape[1]
    table = np.empty((len(y), k + len(rules)), np.float32)  # the one large array of a fit: rows by rules
    table[:, :k] = line / spread
    for i, r in enumerate(rules):
        table[:, k + i] = np.logical_and.reduce([x[:, f] <= at if s == "<=" else x[:, f] > at for f, s, at in r])
    b, w = _lasso(table, y, penalty)
    return Model(
        float(b),
        tuple((names[f], float(low[f]), float(high[f]), float(w[f] / spread[f])) for f in range(k) if abs(w[f]) > 1e-6 and np.isfinite(spread[f])),
        tuple((tuple((names[f], s, at) for f, s, at in r), float(w[k + i])) for i, r in enumerate(rules) if abs(w[k + i]) > 1e-6),
    )


def held_out(doc_id: Column) -> Column:
    """Rows a model never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out; only those texts are measured."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("_label"))
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = chosen.toPandas()  # at most ``rows`` pairs of numbers
    if not len(ids):
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    few = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, _label long"))
    sample = measure(docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_label").alias("_label")))
    got = sample.select("doc_id", "_label", *[F.col(c).cast("double") for c in STATISTICS]).toPandas().sort_values("doc_id")
    return fit(got[list(STATISTICS)].to_numpy(), got["_label"].to_numpy(float))


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with its statistics, ``score`` and ``predicted``."""
    base = measure(docs.drop("score", "predicted"), text_col)
    return base.withColumn("score", model.score()).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.col("predicted").cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject, with their own columns."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    base, name = plain(docs)
    model = learn(base.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["text"]).alias("text")), labels)
    judged = classify(base, model, text_col=name["text"]).withColumn("row", F.monotonically_increasing_id())
    # a filter is not pushed below a column that is not deterministic: else the optimizer would write the whole expression out in it again
    return judged.where("predicted = 1 AND row >= 0").select(*base.columns).toDF(*docs.columns)
