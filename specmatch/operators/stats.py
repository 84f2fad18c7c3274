"""Robust statistics and simple fits. Each is one aggregation; results are a row, small enough for the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retention_order(df: DataFrame, rt: str = "rt", by: tuple[str, ...] = ()) -> DataFrame:
    """``ro``: average rank of a known retention over the number of known ones. Ties share a rank; unknown stays unknown.

    Without ``by`` the order is global: ranks come from counts per distinct retention, and their running sum is taken in two
    levels (a range of retentions, then within it), so no task sorts the whole table.
    """
    keys = list(by)
    counts = df.where(F.col(rt).isNotNull()).groupBy(*keys, rt).agg(F.count("*").alias("_c"))
    cell = F.floor(F.col(rt) * 64)
    cells = counts.groupBy(*keys, cell.alias("_cell")).agg(F.sum("_c").alias("_n"))
    cells = cells.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    inner = Window.partitionBy(*keys, "_cell").orderBy(rt)
    ranked = counts.withColumn("_cell", cell).join(cells, [*keys, "_cell"]).withColumn("ro", (F.col("_before") + F.sum("_c").over(inner) - F.col("_c") + (F.col("_c") + 1) / 2) / F.col("_all"))
    return df.join(ranked.select(*keys, rt, "ro"), [*keys, rt], "left")


def quantiles(df: DataFrame, values: dict[str, Column], q: float, most: int = 1_000_000) -> dict[str, float | None]:
    """Exact quantiles of the known values, between two neighbours where they fall there; None without any.

    Values are counted in cells that grow with their size, by the cluster; of the cell that holds the wanted place finer ones are
    counted, until at most ``most`` values are left there, of which the distinct ones come to the driver. So no task holds a column's values.
    """
    names = list(values)
    x = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), v.cast("double").alias("x")) for i, v in enumerate(values.values())])).alias("v")).select("v.*") if len(names) > 1 else df.select(F.lit(0).alias("k"), *[v.cast("double").alias("x") for v in values.values()])
    x = x.where("x IS NOT NULL")
    cell = F.signum("x") * F.floor(F.log1p(F.abs(F.col("x")) * 1e6) * 1024)
    cells: dict[tuple, list] = {}
    for r in _cells(x, cell):  # a few 10,000 for values of some orders of magnitude
        cells.setdefault(r.k, []).append(r)
    found, open_, place = {}, {}, {}
    for k, own in cells.items():
        place[k] = q * (sum(r.n for r in own) - 1)
        for rank in {math.floor(place[k]), math.ceil(place[k])}:
            open_[k, rank] = (own, 0)
    while open_:
        narrow = {}
        for (k, rank), (own, below) in open_.items():
            for r in sorted(own, key=lambda r: r.low):
                if rank < below + r.n:
                    break
                below += r.n
            if rank in (below, below + r.n - 1) or r.low == r.high:
                found[k, rank] = r.low if rank == below else r.high
            else:
                narrow[k, rank] = (r, below)
        open_ = {}
        for key, (r, below) in narrow.items():
            part = x.where((F.col("k") == key[0]) & (F.col("x") >= r.low) & (F.col("x") <= r.high))
            twin = next((o for o, (z, _) in narrow.items() if o in open_ and o[0] == key[0] and z.low == r.low), None)
            own = open_[twin][0] if twin else _cells(part, F.col("x") if r.n <= most else F.floor((F.col("x") - r.low) / ((r.high - r.low) or 1.0) * 65536))
            open_[key] = (own, below)
    return {name: _between(found, i, place[i]) if i in place else None for i, name in enumerate(names)}


def _cells(x: DataFrame, cell: Column) -> list:
    return x.groupBy("k", cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()


def _between(found: dict, i: int, place: float) -> float:
    low, high = found[i, math.floor(place)], found[i, math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


def mad_scale(df: DataFrame, value: Column, floor: float = 1e-3) -> DataFrame:
    """1.4826 times the median distance from the median; the population deviation where that is 0; never below ``floor``. One
    job, for a row a feature at most: a task holds the distinct values."""
    x = df.select(value.alias("x"))
    middle = x.agg(F.percentile("x", 0.5).alias("m"))
    spread = x.crossJoin(F.broadcast(middle)).agg(F.percentile(F.abs(F.col("x") - F.col("m")), 0.5).alias("mad"), F.stddev_pop("x").alias("sd"))
    one = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(floor)
    return spread.select(F.greatest(one, F.lit(floor)).alias("scale"))


def mad_scales(df: DataFrame, values: dict[str, Column], floor: float = 1e-3) -> dict[str, float]:
    """``mad_scale`` of several values of any number of pairs at once, by counting."""
    if not values:
        return {}
    middle = {k: m for k, m in quantiles(df, values, 0.5).items() if m is not None}
    mad = quantiles(df, {k: F.abs(values[k] - F.lit(m)) for k, m in middle.items()}, 0.5) if middle else {}
    flat = [k for k, v in mad.items() if not v]
    sd = df.agg(*[F.stddev_pop(values[k]).alias(k) for k in flat]).first() if flat else {}
    return {k: max(1.4826 * mad[k] if mad.get(k) else (sd[k] if k in flat else None) or floor, floor) for k in values}


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, intercept) of y on x, from sums about the means; a flat line where x does not vary, 0 below two points."""
    return lines(df, {"": (x, y)}).select("n", "slope", "intercept")


def lines(df: DataFrame, terms: dict[str, tuple[str, str]]) -> DataFrame:
    """``ols`` of several terms (x, y) at once: one row with {term}n, {term}slope and {term}intercept of each, and rows, their number.

    Differences from about the means, over a power of two that bounds them, and their products are summed as whole numbers, so the
    line does not depend on the order of rows, and of many pairs it is as exact as of few.
    """
    both = lambda c, x, y: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c))
    p = df.select(*[c.cast("double") for k, (x, y) in terms.items() for c in (both(x, x, y).alias(f"x_{k}"), both(y, x, y).alias(f"y_{k}"))])
    ends = p.agg(*[f(f"{c}_{k}").alias(f"{n}{c}_{k}") for k in terms for c in "xy" for n, f in (("m", F.avg), ("low", F.min), ("top", F.max))])
    reach = lambda c: F.greatest(F.col(f"top{c}") - F.col(f"m{c}"), F.col(f"m{c}") - F.col(f"low{c}"))
    about = ends.select("*", *[F.when(reach(c) > 0, F.pow(F.lit(2.0), F.ceil(F.log2(reach(c))))).otherwise(1.0).alias(f"b{c}") for k in terms for c in (f"x_{k}", f"y_{k}")])
    sums = [F.count("*").alias("rows")]
    for k in terms:
        dx, dy = ((F.col(f"{c}_{k}") - F.col(f"m{c}_{k}")) / F.col(f"b{c}_{k}") for c in "xy")
        sums += [F.count(f"x_{k}").alias(f"n_{k}"), *[F.first(f"{v}{c}_{k}").alias(f"{v}{c}_{k}") for v in "mb" for c in "xy"]]
        sums += [_sum(v).alias(f"s{n}_{k}") for n, v in (("x", dx), ("y", dy), ("xy", dx * dy), ("xx", dx * dx))]
    s = p.crossJoin(F.broadcast(about)).agg(*sums)
    out = [F.col("rows")]
    for k in terms:
        n, bx, by, sx, sy = (F.col(f"{c}_{k}") for c in ("n", "bx", "by", "sx", "sy"))
        sxx, sxy = F.col(f"sxx_{k}") - sx * sx / n, F.col(f"sxy_{k}") - sx * sy / n
        slope = F.when((n >= 2) & (sxx * bx * bx > 1e-12), sxy / sxx * (by / bx)).otherwise(0.0)
        mx, my = F.col(f"mx_{k}") + bx * (sx / n), F.col(f"my_{k}") + by * (sy / n)
        out += [n.alias(f"{k}n"), slope.alias(f"{k}slope"), F.when(n >= 2, my - slope * mx).otherwise(0.0).alias(f"{k}intercept")]
    return s.select(*out)


def _sum(v: Column, one: float = 2.0**29) -> Column:
    """The sum of numbers from -2 to 2, each as two whole numbers, to 2**-59; of up to 2**33 of them."""
    high = F.rint(v * one)
    return F.sum(high.cast("long")) / one + F.sum(F.rint((v * one - high) * one).cast("long")) / one / one


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho) of average ranks."""
    p = df.select(F.monotonically_increasing_id().alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    rx = retention_order(p, "_x").withColumnRenamed("ro", "_rx")
    return retention_order(rx, "_y").agg(F.count("*").alias("n"), F.corr("_rx", "ro").alias("rho"))


def robust_zscore(df: DataFrame, column: str, least: int = 50, clip: float = 8.0) -> DataFrame:
    """``column`` centred on its median in units of 1.4826 MAD, clipped; unchanged below ``least`` known values."""
    x = df.where(F.col(column).isNotNull())
    middle = x.agg(F.percentile(column, 0.5).alias("_m"), F.count("*").alias("_n"))
    spread = x.crossJoin(F.broadcast(middle)).agg((1.4826 * F.percentile(F.abs(F.col(column) - F.col("_m")), 0.5)).alias("_s"))
    z = F.when(F.col("_s") <= 1e-12, 0.0).otherwise(F.least(F.greatest((F.col(column) - F.col("_m")) / F.col("_s"), F.lit(-clip)), F.lit(clip)))
    out = df.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(spread))
    return out.withColumn(column, F.when(F.col("_n") < least, F.col(column)).otherwise(F.coalesce(z, F.lit(0.0)))).drop("_m", "_n", "_s")


def zscore(df: DataFrame, column: str, least: int = 50, clip: float = 8.0) -> DataFrame:
    stat = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"), F.count(column).alias("_n"))
    z = F.when(F.col("_s") <= 1e-12, 0.0).otherwise(F.least(F.greatest((F.col(column) - F.col("_m")) / F.col("_s"), F.lit(-clip)), F.lit(clip)))
    out = df.crossJoin(F.broadcast(stat))
    return out.withColumn(column, F.when(F.col("_n") < least, F.col(column)).otherwise(F.coalesce(z, F.lit(0.0)))).drop("_m", "_s", "_n")


def rt_unit(df: DataFrame, rt: str = "rt") -> DataFrame:
    """(n, med, p95, top, scale): seconds are told from minutes by their size; scale turns them into minutes."""
    s = df.where(F.col(rt) > 0).agg(F.count(rt).alias("n"), F.percentile(rt, 0.5).alias("med"), F.percentile(rt, 0.95).alias("p95"), F.max(rt).alias("top"))
    return s.withColumn("scale", F.when((F.col("n") >= 20) & (F.col("med") >= 100) & (F.col("p95") >= 300) & (F.col("top") >= 500), 1.0 / 60.0).otherwise(1.0))


def rt_profile(sides: dict[str, DataFrame], decimals: int = 3) -> dict[str, dict]:
    """``rt_unit`` and ``rt_quality`` of several studies (rt) in one job; distinct values are counted after scaling."""
    both = None
    for name, df in sides.items():
        own = df.select(F.lit(name).alias("side"), F.col("rt").cast("double").alias("rt"))
        both = own if both is None else both.unionByName(own)
    pos = F.when(F.col("rt") > 0, F.col("rt"))
    stat = both.groupBy("side").agg(F.count("*").alias("n"), F.count("rt").alias("n_finite"), F.count(pos).alias("n_pos"), F.percentile(pos, 0.5).alias("med"), F.percentile(pos, 0.95).alias("p95"), F.max(pos).alias("top"), *[F.countDistinct(F.rint(F.col("rt") * k * float(10**decimals))).alias(f"u{i}") for i, k in enumerate((1.0, 1.0 / 60.0))])
    out = {}
    for r in stat.collect():  # a row for each study
        seconds = r.n_pos >= 20 and r.med >= 100 and r.p95 >= 300 and r.top >= 500
        out[r.side] = {"n": r.n, "n_finite": r.n_finite, "scale": 1.0 / 60.0 if seconds else 1.0, "unique": r.u0, "unique_scaled": r.u1 if seconds else r.u0}
    return {name: out.get(name, {"n": 0, "n_finite": 0, "scale": 1.0, "unique": 0, "unique_scaled": 0}) for name in sides}


def rt_quality(df: DataFrame, rt: str = "rt", decimals: int = 3) -> DataFrame:
    """(n, n_finite, n_unique): known retentions, and distinct ones after rounding."""
    k = float(10**decimals)
    return df.agg(F.count("*").alias("n"), F.count(rt).alias("n_finite"), F.countDistinct(F.rint(F.col(rt) * k)).alias("n_unique"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Per key the least value at which the running weight reaches half of the total."""
    w = Window.partitionBy(*keys).orderBy(value)
    run = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    run = run.withColumn("_cum", F.sum("_w").over(w)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    return run.where(F.col("_cum") >= F.col("_all") / 2).groupBy(*keys).agg(F.min(value).alias(f"{value}_wmed"))
