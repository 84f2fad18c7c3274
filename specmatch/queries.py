"""Registered queries: each applies an operator to the driver tables; ``ORACLES`` holds the same in plain SQL.

Doubles that depend on the order of a sum or on a logarithm leave as whole millionths, so two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmatch.functions import columns as C
from specmatch.functions.columns import micro
from specmatch.operators import adducts, bandjoin, decide, stats, structure, transport, windows
from specmatch.operators.components import connected_components
from specmatch.sources.views import X, ctes, expression, pair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def m(x: str) -> str:
    """SQL of ``micro``."""
    return f"CAST(floor(({x})*1e6+0.5e0) AS BIGINT)"


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


INTENSITY = "SELECT l_partkey AS id, avg(l_quantity) AS intensity FROM lineitem GROUP BY l_partkey"


def intensity(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.avg("l_quantity").alias("intensity"))


# --- normalisation -------------------------------------------------------------------------------------------------


@register("schema_normalize", f"WITH {ctes()}, i AS ({INTENSITY}) SELECT a.id, {m('a.mz')} AS mz, {m('a.rt')} AS rt, {m('log10(greatest(i.intensity,0e0)+1e-9)')} AS intensity_log10, {m('(rank() OVER (ORDER BY a.rt) + (count(*) OVER (PARTITION BY a.rt)-1)/2e0)/count(a.rt) OVER ()')} AS ro FROM a LEFT JOIN i ON a.id=i.id")
def _(spark, d):
    a = stats.retention_order(pair(spark, d)[0]).join(intensity(spark, d), "id", "left")
    return a.select("id", micro(F.col("mz")).alias("mz"), micro(F.col("rt")).alias("rt"), micro(C.intensity_log10(F.col("intensity"))).alias("intensity_log10"), micro(F.col("ro")).alias("ro"))


@register("retention_order", f"SELECT c_custkey AS id, {m('CASE WHEN c_acctbal>0 THEN (rank() OVER (PARTITION BY c_acctbal>0 ORDER BY floor(c_acctbal)) + (count(*) OVER (PARTITION BY c_acctbal>0, floor(c_acctbal))-1)/2e0)/count(*) OVER (PARTITION BY c_acctbal>0) END')} AS ro FROM customer")
def _(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("double")).alias("rt"))
    return stats.retention_order(c).select("id", micro(F.col("ro")).alias("ro"))


@register("intensity_log10", f"SELECT c_custkey AS id, {m('log10(greatest(c_acctbal,0e0)+1e-9)')} AS value, {m('log10(CASE WHEN c_acctbal>0 THEN c_acctbal ELSE 0e0 END+1e-9)')} AS cv FROM customer")
def _(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), micro(C.intensity_log10(F.col("c_acctbal"))).alias("value"), micro(C.cv_log10(F.col("c_acctbal"))).alias("cv"))


_UNIT = "SELECT count(rt) AS n, quantile_cont(rt,0.5) AS med, quantile_cont(rt,0.95) AS p95, max(rt) AS top FROM {t} WHERE rt>0"


@register("rt_unit_scale", f"WITH {ctes()}, s AS (SELECT id, rt*60e0 AS rt FROM a), u AS (SELECT 'minutes' AS study, * FROM ({_UNIT.format(t='a')}) UNION ALL SELECT 'seconds' AS study, * FROM ({_UNIT.format(t='s')})) SELECT study, n, {m('med')} AS med, {m('p95')} AS p95, {m('top')} AS top, {m('CASE WHEN n>=20 AND med>=100 AND p95>=300 AND top>=500 THEN 1e0/60e0 ELSE 1e0 END')} AS scale FROM u")
def _(spark, d):
    a = pair(spark, d)[0]
    both = stats.rt_unit(a).withColumn("study", F.lit("minutes")).unionByName(stats.rt_unit(a.withColumn("rt", F.col("rt") * 60.0)).withColumn("study", F.lit("seconds")))
    return both.select("study", "n", *[micro(F.col(c)).alias(c) for c in ("med", "p95", "top", "scale")])


@register("rt_quality", f"WITH {ctes()} SELECT count(*) AS n, count(CASE WHEN id%5<>0 THEN rt END) AS n_finite, count(DISTINCT CASE WHEN id%5<>0 THEN round_even(rt*1000e0,0) END) AS n_unique FROM b")
def _(spark, d):
    b = pair(spark, d)[1].withColumn("rt", F.when(F.col("id") % 5 != 0, F.col("rt")))
    return stats.rt_quality(b)


@register("intensity_robust_zscore", "WITH i AS (SELECT id, log10(intensity+1e-9) AS x FROM (" + INTENSITY + f") y), md AS (SELECT quantile_cont(x,0.5) AS md FROM i), sd AS (SELECT 1.4826e0*quantile_cont(abs(x-md),0.5) AS s FROM i, md) SELECT id, {m('CASE WHEN s<=1e-12 THEN 0e0 ELSE least(greatest((x-md)/s,-8e0),8e0) END')} AS z FROM i, md, sd")
def _(spark, d):
    i = intensity(spark, d).select("id", C.intensity_log10(F.col("intensity")).alias("x"))
    return stats.robust_zscore(i, "x").select("id", micro(F.col("x")).alias("z"))


@register("feature_intensity_mean", f"WITH x AS ({X}) SELECT feature_id, count(*) AS n_samples, {m('avg(v)')} AS mean_v, {m('CASE WHEN count(*)>1 THEN stddev_samp(v)/avg(v) END')} AS cv, {m('avg(CASE WHEN v>25 THEN 1e0 ELSE 0e0 END)')} AS detect_rate FROM x GROUP BY feature_id")
def _(spark, d):
    from specmatch.sources.readers import with_intensity

    x = expression(spark, d)
    means = with_intensity(x.select("feature_id").distinct(), x)
    more = x.groupBy("feature_id").agg(F.count("*").alias("n_samples"), F.stddev_samp("v").alias("sd"), F.avg((F.col("v") > 25).cast("double")).alias("dr"))
    return means.join(more, "feature_id").select("feature_id", "n_samples", micro(F.col("Intensity")).alias("mean_v"), micro(F.col("sd") / F.col("Intensity")).alias("cv"), micro(F.col("dr")).alias("detect_rate"))


# --- joins ---------------------------------------------------------------------------------------------------------

_BAND = "{b}.mz BETWEEN {a}.mz-{a}.mz*{p}/1e6 AND {a}.mz+{a}.mz*{p}/1e6"


def band(p: float, a: str = "a", b: str = "b") -> str:
    return _BAND.format(a=a, b=b, p=f"{p}e0")


@register("band_join_ppm", f"WITH {ctes(True)} SELECT a.id AS id1, b.id AS id2 FROM a JOIN b ON {band(20)}")
def _(spark, d):
    return bandjoin.band_join(*pair(spark, d, True), 20.0).select("id1", "id2")


@register("band_join_rt_gate", f"WITH {ctes(True)} SELECT a.id AS id1, b.id AS id2, {m('(b.mz-a.mz)/((a.mz+b.mz)/2e0)*1e6')} AS ppm FROM a JOIN b ON {band(20)} AND abs(b.rt-a.rt)<=10e0")
def _(spark, d):
    return bandjoin.band_join(*pair(spark, d, True), 20.0, rt=10.0).select("id1", "id2", micro(C.ppm_over_mean(F.col("mz1"), F.col("mz2"))).alias("ppm"))


@register("tight_all", f"WITH {ctes(True)} SELECT a.id AS id1, b.id AS id2 FROM a JOIN b ON {band(7)} AND abs(b.rt-a.rt)<=20e0")
def _(spark, d):
    return bandjoin.band_join(*pair(spark, d, True), 7.0, rt=20.0).select("id1", "id2")


def nn_sql(name: str, a: str, b: str, p: float) -> str:
    return f"{name} AS (SELECT id1, id2 FROM (SELECT {a}.id AS id1, {b}.id AS id2, row_number() OVER (PARTITION BY {a}.id ORDER BY abs(({b}.mz-{a}.mz)/(({a}.mz+{b}.mz)/2e0)*1e6), abs({b}.rt-{a}.rt), {b}.mz, {b}.id) AS n FROM {a} JOIN {b} ON {band(p, a, b)}) q WHERE n=1)"


MNN = f"{nn_sql('fw', 'a', 'b', 7)}, {nn_sql('bw', 'b', 'a', 7)}, anchors AS (SELECT fw.id1, fw.id2 FROM fw JOIN bw ON fw.id1=bw.id2 AND fw.id2=bw.id1)"


@register("tight_nn", f"WITH {ctes(True)}, {nn_sql('fw', 'a', 'b', 7)} SELECT id1, id2 FROM fw")
def _(spark, d):
    return bandjoin.nearest(*pair(spark, d, True), 7.0).select("id1", "id2")


@register("tight_mnn", f"WITH {ctes(True)}, {MNN} SELECT id1, id2 FROM anchors")
def _(spark, d):
    return bandjoin.mutual(*pair(spark, d, True), 7.0).select("id1", "id2")


@register("asof_nearest_mz", f"WITH {ctes(True)} SELECT id1, id2 FROM (SELECT a.id AS id1, b.id AS id2, (b.mz-a.mz)/((a.mz+b.mz)/2e0)*1e6 AS ppm, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.mz-a.mz), b.mz DESC, b.id) AS n FROM a JOIN b ON {band(6)}) q WHERE n=1 AND abs(ppm)<=5e0")
def _(spark, d):
    return bandjoin.asof(*pair(spark, d, True), 5.0).select("id1", "id2")


_SHIFTS = "shifts AS (SELECT * FROM (VALUES (0, 0e0), (1, 1.007276466812e0), (2, -1.007276466812e0), (3, 22.989218e0)) t(k, s))"


@register("mz_shift_anchor_counts", f"""WITH {ctes()}, {_SHIFTS}, sa AS (SELECT k, id, mz+s AS mz FROM a, shifts),
f AS (SELECT k, id1, id2 FROM (SELECT sa.k, sa.id AS id1, b.id AS id2, row_number() OVER (PARTITION BY sa.k, sa.id ORDER BY abs(b.mz-sa.mz), b.mz DESC, b.id) AS n FROM sa JOIN b ON b.mz BETWEEN sa.mz-sa.mz*5e0/1e6 AND sa.mz+sa.mz*5e0/1e6) q WHERE n=1),
g AS (SELECT k, id1, id2 FROM (SELECT sa.k, sa.id AS id1, b.id AS id2, row_number() OVER (PARTITION BY sa.k, b.id ORDER BY abs(b.mz-sa.mz), sa.mz DESC, sa.id) AS n FROM sa JOIN b ON sa.mz BETWEEN b.mz-b.mz*5e0/1e6 AND b.mz+b.mz*5e0/1e6) q WHERE n=1)
SELECT shifts.k, (SELECT count(*) FROM f JOIN g ON f.k=g.k AND f.id1=g.id1 AND f.id2=g.id2 WHERE f.k=shifts.k) AS n FROM shifts""")
def _(spark, d):
    from specmatch.operators.align import shift_counts

    a, b = pair(spark, d)
    shifts = [(0.0, 0.0), (C.PROTON, 0.0), (-C.PROTON, 0.0), (22.989218, 0.0)]
    return shift_counts(a, b, shifts, 5.0).select("k", "n")


@register("unique_mz_anchors", f"WITH {ctes(True)}, {MNN}, c AS (SELECT a.id, count(*) AS n FROM a JOIN b ON {band(7)} GROUP BY a.id) SELECT id1, id2 FROM anchors JOIN c ON c.id=anchors.id1 WHERE c.n=1")
def _(spark, d):
    a, b = pair(spark, d, True)
    alone = bandjoin.band_join(a, b, 7.0).groupBy("id1").count().where("count = 1").select("id1")
    return bandjoin.mutual(a, b, 7.0).join(alone, "id1").select("id1", "id2")


@register("rt_drift_p95", f"WITH {ctes()}, {nn_sql('fw', 'a', 'b', 7)} SELECT count(*) AS n, {m('quantile_cont(abs(b.rt-a.rt),0.95)')} AS p95 FROM fw JOIN a ON a.id=fw.id1 JOIN b ON b.id=fw.id2")
def _(spark, d):
    return bandjoin.nearest(*pair(spark, d), 7.0).agg(F.count("*").alias("n"), micro(F.percentile(F.abs(F.col("rt2") - F.col("rt1")), 0.95)).alias("p95"))


# --- fits ----------------------------------------------------------------------------------------------------------

_PAIRS = "p AS (SELECT a.mz AS mz1, a.rt AS rt1, b.mz AS mz2, b.rt AS rt2, (b.mz-a.mz)/((a.mz+b.mz)/2e0)*1e6 AS ppm FROM anchors JOIN a ON a.id=id1 JOIN b ON b.id=id2)"


@register("rt_transfer_ols", f"WITH {ctes()}, {MNN}, {_PAIRS} SELECT count(*) AS n, {m('regr_slope(rt1,rt2)')} AS slope, {m('regr_intercept(rt1,rt2)')} AS intercept FROM p")
def _(spark, d):
    return stats.ols(bandjoin.mutual(*pair(spark, d), 7.0), "rt2", "rt1").select("n", micro(F.col("slope")).alias("slope"), micro(F.col("intercept")).alias("intercept"))


@register("rt_spearman", f"WITH {ctes()}, {MNN}, {_PAIRS}, r AS (SELECT rank() OVER (ORDER BY rt1)+(count(*) OVER (PARTITION BY rt1)-1)/2e0 AS x, rank() OVER (ORDER BY rt2)+(count(*) OVER (PARTITION BY rt2)-1)/2e0 AS y FROM p) SELECT count(*) AS n, {m('corr(x,y)')} AS rho FROM r")
def _(spark, d):
    return stats.spearman(bandjoin.mutual(*pair(spark, d), 7.0), "rt1", "rt2").select("n", micro(F.col("rho")).alias("rho"))


@register("drift_ols_ppm", f"WITH {ctes()}, {MNN}, {_PAIRS} SELECT count(*) AS n, {m('regr_slope(ppm,mz1)*1e3')} AS slope_milli, {m('regr_intercept(ppm,mz1)')} AS intercept FROM p")
def _(spark, d):
    p = bandjoin.mutual(*pair(spark, d), 7.0).withColumn("ppm", C.ppm_over_mean(F.col("mz1"), F.col("mz2")))
    return stats.ols(p, "mz1", "ppm").select("n", micro(F.col("slope") * 1e3).alias("slope_milli"), micro(F.col("intercept")).alias("intercept"))


#: Candidates of the dense pair with a mass drift line fitted on the anchors, its residual, their robust scale, and the log likelihood.
SCORED = f"""{ctes(True)}, {MNN}, {_PAIRS},
fit AS (SELECT regr_slope(ppm,mz1) AS slope, regr_intercept(ppm,mz1) AS intercept FROM p),
r AS (SELECT a.id AS id1, b.id AS id2, a.mz AS mz1, b.mz AS mz2, a.rt AS rt1, b.rt AS rt2, (b.mz-a.mz)/((a.mz+b.mz)/2e0)*1e6 - (intercept+slope*a.mz) AS resid FROM a JOIN b ON {band(20)} CROSS JOIN fit),
md AS (SELECT quantile_cont(resid,0.5) AS md FROM r), sc AS (SELECT greatest(1.4826e0*quantile_cont(abs(resid-md),0.5),1e-3) AS s FROM r, md),
ll AS (SELECT r.*, lgamma(2e0)-lgamma(1.5e0)-0.5e0*ln(3e0*pi())-ln(s)-2e0*ln(1e0+(resid/s)*(resid/s)/3e0) AS ll FROM r, sc),
pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY ll DESC, mz2, id2) AS n FROM ll) q WHERE n<=20),
nl AS (SELECT quantile_cont(ll,0.2) AS nl FROM pr)"""


def drift_line(spark: SparkSession, d: str) -> tuple[float, float]:
    """(intercept, slope) of the mass drift of the dense pair."""
    p = bandjoin.mutual(*pair(spark, d, True), 7.0).withColumn("ppm", C.ppm_over_mean(F.col("mz1"), F.col("mz2")))
    fit = stats.ols(p, "mz1", "ppm").first()
    return fit["intercept"], fit["slope"]


def residuals(spark: SparkSession, d: str, line: tuple[float, float]) -> DataFrame:
    edges = bandjoin.band_join(*pair(spark, d, True), 20.0)
    return edges.withColumn("resid", C.ppm_over_mean(F.col("mz1"), F.col("mz2")) - (F.lit(line[0]) + F.lit(line[1]) * F.col("mz1")))


def residual_scale(spark: SparkSession, d: str, line: tuple[float, float]) -> float:
    scale = windows.mad_scale(*pair(spark, d, True), 20.0, line)
    return scale if scale is not None else stats.mad_scales(residuals(spark, d, line), {"resid": F.col("resid")})["resid"]


def scored(spark: SparkSession, d: str) -> DataFrame:
    line = drift_line(spark, d)
    return residuals(spark, d, line).withColumn("ll", C.student_t(F.col("resid"), residual_scale(spark, d, line), 3.0))


def best20(spark: SparkSession, d: str, of=windows.best) -> DataFrame:
    """The 20 best of ``scored`` for each left row."""
    line = drift_line(spark, d)
    return of(*pair(spark, d, True), 20.0, line, residual_scale(spark, d, line), 3.0, 20)


def pruned(spark: SparkSession, d: str) -> DataFrame:
    from specmatch.session import cut

    return cut(best20(spark, d))


def ranked(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    """``pruned`` as a row with lists for each left row, and the null option's log likelihood."""
    from specmatch.session import cut

    rows = cut(best20(spark, d, windows.ranked))
    return rows, transport.null_loglik(rows.select(F.explode("ll").alias("ll")))


@register("drift_residuals", f"WITH {SCORED} SELECT id1, id2, {m('resid')} AS resid FROM r")
def _(spark, d):
    return residuals(spark, d, drift_line(spark, d)).select("id1", "id2", micro(F.col("resid")).alias("resid"))


@register("mad_scale", f"WITH {SCORED} SELECT {m('s')} AS scale FROM sc")
def _(spark, d):
    scale = residual_scale(spark, d, drift_line(spark, d))
    return spark.createDataFrame([(scale,)], "scale double").select(micro(F.col("scale")).alias("scale"))


@register("student_t_loglik", f"WITH {SCORED} SELECT id1, id2, {m('ll')} AS ll FROM ll")
def _(spark, d):
    return scored(spark, d).select("id1", "id2", micro(F.col("ll")).alias("ll"))


@register("topk_prune", f"WITH {SCORED} SELECT id1, count(*) AS n, {m('min(ll)')} AS least FROM pr GROUP BY id1")
def _(spark, d):
    return best20(spark, d).groupBy("id1").agg(F.count("*").alias("n"), micro(F.min("ll")).alias("least"))


@register("null_quantile", f"WITH {SCORED} SELECT {m('nl')} AS null_ll FROM nl")
def _(spark, d):
    return spark.createDataFrame([(ranked(spark, d)[1],)], "x double").select(micro(F.col("x")).alias("null_ll"))


def softmax_sql(name: str, temperature: str) -> str:
    return f"""{name}_t AS (SELECT pr.*, max(ll) OVER (PARTITION BY id1) AS top, nl FROM pr, nl),
{name}_e AS (SELECT *, exp((ll-top)/{temperature}) AS e, exp((nl-top)/{temperature}) AS e0 FROM {name}_t),
{name} AS (SELECT *, e/(sum(e) OVER (PARTITION BY id1)+e0) AS p, e0/(sum(e) OVER (PARTITION BY id1)+e0) AS p0 FROM {name}_e)"""


LOCAL = f"{SCORED}, {softmax_sql('lo', '1e0')}, {softmax_sql('ot', '0.5e0')}"


def softmax_rows(spark: SparkSession, d: str, temperature: float) -> DataFrame:
    return transport.ranked_softmax(*ranked(spark, d), temperature)


def softmax(spark: SparkSession, d: str, temperature: float) -> DataFrame:
    """The edges of ``softmax_rows``."""
    return windows.each(softmax_rows(spark, d, temperature), "id2", "mz2", "p_row")


@register("row_softmax_null", f"WITH {LOCAL} SELECT id1, id2, {m('p')} AS p, {m('p0')} AS p0 FROM lo")
def _(spark, d):
    return softmax(spark, d, 1.0).select("id1", "id2", micro(F.col("p_row")).alias("p"), micro(F.col("p0")).alias("p0"))


@register("semi_relaxed_ot", f"WITH {LOCAL} SELECT id1, id2, {m('1e3*p/(SELECT count(DISTINCT id1) FROM pr)')} AS milli_weight, {m('p0')} AS p0 FROM ot")
def _(spark, d):
    rows = softmax_rows(spark, d, 0.5)
    n = rows.agg(F.countDistinct("id1").alias("_n"))
    return windows.each(rows, "id2", "p_row").crossJoin(F.broadcast(n)).select("id1", "id2", micro(1e3 * F.col("p_row") / F.col("_n")).alias("milli_weight"), micro(F.col("p0")).alias("p0"))


def sinkhorn_sql(n: int, tau_row: str, tau_col: str) -> str:
    parts = [f"""{SCORED}, ex AS (SELECT id1, id2, ll FROM pr UNION ALL SELECT DISTINCT id1, -1 AS id2, nl AS ll FROM pr, nl),
k AS MATERIALIZED (SELECT id1, id2, exp((ll-max(ll) OVER (PARTITION BY id1))/0.5e0) AS k FROM ex),
nn AS (SELECT count(DISTINCT id1) AS n1, count(DISTINCT CASE WHEN id2>=0 THEN id2 END) AS n2 FROM k), v0 AS (SELECT DISTINCT id2, 1e0 AS v FROM k)"""]
    for i in range(1, n + 1):
        parts.append(f"u{i} AS MATERIALIZED (SELECT id1, pow(1e0/max(n1)/greatest(sum(k*v),1e-12),{tau_row}) AS u FROM k JOIN v{i - 1} USING (id2), nn GROUP BY id1)")
        parts.append(f"v{i} AS MATERIALIZED (SELECT id2, pow(CASE WHEN id2<0 THEN 0.1e0 ELSE 0.9e0/max(n2) END/greatest(sum(k*u),1e-12),{tau_col}) AS v FROM k JOIN u{i} USING (id1), nn GROUP BY id2)")
    parts.append(f"w AS (SELECT id1, id2, k*u*v AS w FROM k JOIN u{n} USING (id1) JOIN v{n} USING (id2)), pw AS (SELECT *, w/sum(w) OVER (PARTITION BY id1) AS p FROM w)")
    return f"WITH {', '.join(parts)} SELECT id1, id2, {m('1e3*w')} AS milli_weight, {m('p')} AS p FROM pw WHERE id2>=0"


@register("sinkhorn_unbalanced_n", sinkhorn_sql(3, "10e0/10.5e0", "0.5e0"))
def _(spark, d):
    e = pruned(spark, d)
    out = transport.sinkhorn(e, transport.Sinkhorn(max_iter=3, tau_row=10 / 10.5, tau_col=0.5), transport.null_loglik(e))
    return out.select("id1", "id2", micro(1e3 * F.col("ot_weight")).alias("milli_weight"), micro(F.col("p_row_ot")).alias("p"))


@register("sinkhorn_balanced_n", sinkhorn_sql(3, "1e0", "1e0"))
def _(spark, d):
    e = pruned(spark, d)
    out = transport.sinkhorn(e, transport.Sinkhorn(max_iter=3, tol=0.0), transport.null_loglik(e))
    return out.select("id1", "id2", micro(1e3 * F.col("ot_weight")).alias("milli_weight"), micro(F.col("p_row_ot")).alias("p"))


@register("row_entropy", f"WITH {LOCAL} SELECT id1, {m('sum(CASE WHEN p>0 THEN -p*ln(p) ELSE 0e0 END)+max(CASE WHEN p0>0 THEN -p0*ln(p0) ELSE 0e0 END)')} AS entropy FROM lo GROUP BY id1")
def _(spark, d):
    return transport.ranked_entropy(softmax_rows(spark, d, 1.0)).select("id1", micro(F.col("entropy")).alias("entropy"))


# --- decisions -----------------------------------------------------------------------------------------------------


def top1_sql(name: str, src: str, null: str, absent: str) -> str:
    return f"""{name}_k AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY p DESC, mz2, id2) AS k FROM {src}),
{name}_b AS (SELECT id1, max(CASE WHEN k=1 THEN id2 END) AS id2, max(CASE WHEN k=1 THEN p END) AS p1, coalesce(max(CASE WHEN k=2 THEN p END),0e0) AS p2, max(p0) AS p0, count(*) AS n_candidates FROM {name}_k GROUP BY id1),
{name} AS (SELECT a.id AS id1, coalesce(id2,-1) AS id2_raw, coalesce(p1,0e0) AS prob, coalesce(p1-p2,0e0) AS margin, CASE WHEN id2 IS NULL THEN {absent} ELSE p0 END AS p_null,
  CASE WHEN id2 IS NULL OR p0>=p1 THEN -1 ELSE id2 END AS id2, CASE WHEN id2 IS NULL THEN 'no_candidate' WHEN p0>=p1 THEN '{null}' ELSE 'match' END AS decision, coalesce(n_candidates,0) AS n_candidates FROM a LEFT JOIN {name}_b x ON a.id=x.id1)"""


TOPS = f"{LOCAL}, {top1_sql('tot', 'ot', 'null_ot', '0e0')}, {top1_sql('tl', 'lo', 'null_local', '1e0')}"


def tops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = pair(spark, d, True)[0].select(F.col("id").alias("id1"))
    rows, null = ranked(spark, d)
    ot = decide.decided(a, decide.ranked_top2(transport.ranked_softmax(rows, null, 0.5)), "null_ot", 0.0, "n_candidates")
    local = decide.decided(a, decide.ranked_top2(transport.ranked_softmax(rows, null, 1.0)), "null_local", 1.0)
    return ot.withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("long"))), local


def shown(df: DataFrame) -> DataFrame:
    return df.select("id1", "id2", "decision", micro(F.col("prob_match_raw")).alias("prob"), micro(F.col("margin")).alias("margin"), micro(F.col("p_null")).alias("p_null"))


_SHOW = f"id1, id2, decision, {m('prob')} AS prob, {m('margin')} AS margin, {m('p_null')} AS p_null"


@register("top2_margin", f"WITH {TOPS} SELECT id1, id2, {m('p1')} AS p1, {m('p1-p2')} AS margin FROM tot_b")
def _(spark, d):
    return decide.ranked_top2(softmax_rows(spark, d, 0.5)).select("id1", "id2", micro(F.col("p1")).alias("p1"), micro(F.col("margin")).alias("margin"))


@register("top1_decision", f"WITH {TOPS} SELECT {_SHOW} FROM tot")
def _(spark, d):
    return shown(tops(spark, d)[0])


@register("left_outer_top1", f"WITH {TOPS} SELECT decision, count(*) AS n, count(DISTINCT id1) AS rows_kept FROM tl GROUP BY decision")
def _(spark, d):
    return tops(spark, d)[1].groupBy("decision").agg(F.count("*").alias("n"), F.countDistinct("id1").alias("rows_kept"))


_OVER = "tl.id2>=0 AND tl.prob>=0.4e0 AND tl.margin>=0.1e0 AND (tot.decision='null_ot' OR (tot.id2<>tl.id2 AND tot.margin<=0.1e0))"


@register("hybrid_policy", f"WITH {TOPS}, h AS (SELECT tot.id1, {_OVER} AS o, tot.id2 AS i, tl.id2 AS j, tot.decision AS c, tl.decision AS e, tot.prob AS p, tl.prob AS q FROM tot JOIN tl ON tot.id1=tl.id1) SELECT id1, CASE WHEN o THEN j ELSE i END AS id2, CASE WHEN o THEN e ELSE c END AS decision, {m('CASE WHEN o THEN q ELSE p END')} AS prob, CASE WHEN o THEN 'local_override' ELSE 'ot' END AS top1_source FROM h")
def _(spark, d):
    return decide.hybrid(*tops(spark, d), p_min=0.4, margin_min=0.1, ot_margin_max=0.1).select("id1", "id2", "decision", micro(F.col("prob_match_raw")).alias("prob"), "top1_source")


_FAIL = "id2>=0 AND (prob<0.5e0 OR margin<0.15e0 OR prob-p_null<0.3e0)"


@register("abstain_confidence", f"WITH {TOPS}, z AS (SELECT *, {_FAIL} AS f FROM tot) SELECT id1, CASE WHEN f THEN -1 ELSE id2 END AS id2, CASE WHEN f THEN 'abstain_confidence' ELSE decision END AS decision FROM z")
def _(spark, d):
    return decide.abstain_confidence(tops(spark, d)[0], 0.5, 0.15, 0.3).select("id1", "id2", "decision")


@register("abstain_ambiguous", f"WITH {TOPS}, z AS (SELECT *, n_candidates>=2 AND {_FAIL} AS f FROM tot) SELECT id1, CASE WHEN f THEN -1 ELSE id2 END AS id2, CASE WHEN f THEN 'abstain_ambiguous' ELSE decision END AS decision FROM z")
def _(spark, d):
    return decide.abstain_ambiguous(tops(spark, d)[0], min_candidates=2, min_p=0.5, min_margin=0.15, min_gap=0.3).select("id1", "id2", "decision")


# --- clustering ----------------------------------------------------------------------------------------------------


@register("mutual_top1", f"WITH {ctes(True)}, {MNN} SELECT id1, id2 FROM anchors")
def _(spark, d):
    a, b = pair(spark, d, True)
    return decide.mutual_top1(bandjoin.nearest(a, b, 7.0), bandjoin.nearest(b, a, 7.0))


@register("one_direction_mutual", f"WITH {TOPS}, cs AS (SELECT id1, id2, row_number() OVER (PARTITION BY id2 ORDER BY p DESC, id1) AS c FROM ot WHERE p>0) SELECT tot.id1, tot.id2 FROM tot JOIN cs ON tot.id1=cs.id1 AND tot.id2=cs.id2 WHERE tot.id2>=0 AND c=1")
def _(spark, d):
    e = softmax(spark, d, 0.5).withColumn("ot_weight", F.col("p_row"))
    return decide.one_direction_mutual(tops(spark, d)[0], e)


@register("unmatched_anti", f"WITH {ctes(True)}, {MNN} SELECT b.id FROM b WHERE b.id NOT IN (SELECT id2 FROM anchors)")
def _(spark, d):
    a, b = pair(spark, d, True)
    return b.select("id").join(bandjoin.mutual(a, b, 7.0).select(F.col("id2").alias("id")), "id", "left_anti")


@register("full_join_cluster_map", f"""WITH {ctes(True)}, {MNN} SELECT CAST(id AS VARCHAR) AS cluster_id, 'A' AS study_id, CAST(id AS VARCHAR) AS feature_id FROM a
UNION ALL SELECT CAST(id1 AS VARCHAR), 'B', CAST(id2 AS VARCHAR) FROM anchors UNION ALL SELECT 'B__' || CAST(id AS VARCHAR), 'B', CAST(id AS VARCHAR) FROM b WHERE id NOT IN (SELECT id2 FROM anchors)""")
def _(spark, d):
    from specmatch.operators.cluster import full_map

    a, b = pair(spark, d, True)
    hub = a.select(F.lit("A").alias("study_id"), F.col("id").cast("string").alias("feature_id"))
    other = b.select(F.lit("B").alias("study_id"), F.col("id").cast("string").alias("feature_id"))
    matches = bandjoin.mutual(a, b, 7.0).select(F.lit("B").alias("study_id"), F.col("id2").cast("string").alias("feature_id"), F.col("id1").cast("string").alias("cluster_id"))
    return full_map(hub, other, matches)


#: Four studies drawn from one, with four drifts and four different gaps.
STUDIES = "st AS (SELECT k, id, mz*(1e0+ppm*1e-6) AS mz, rt+k/1e1 AS rt FROM a, (VALUES (0,0e0),(1,5e0),(2,-3e0),(3,2e0)) t(k,ppm) WHERE id%7<>k)"


def studies(spark: SparkSession, d: str) -> DataFrame:
    drift = spark.createDataFrame([(0, 0.0), (1, 5.0), (2, -3.0), (3, 2.0)], "k int, ppm double")
    a = pair(spark, d)[0].crossJoin(F.broadcast(drift)).where(F.col("id") % 7 != F.col("k"))
    return a.select("k", "id", (F.col("mz") * (1 + F.col("ppm") * 1e-6)).alias("mz"), (F.col("rt") + F.col("k") / 10.0).alias("rt"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    from specmatch.operators.cluster import cluster_metadata

    return cluster_metadata(studies(spark, d).select(F.col("id").alias("cluster_id"), F.col("k").alias("study_id"), F.col("mz").alias("MZ"), F.col("rt").alias("RT"), F.lit(1.0).alias("Intensity")))


@register("cluster_study_counts", f"WITH {ctes()}, {STUDIES} SELECT id AS cluster_id, count(DISTINCT k) AS n_studies FROM st GROUP BY id")
def _(spark, d):
    return summary(spark, d).select("cluster_id", "n_studies")


@register("cluster_medians", f"WITH {ctes()}, {STUDIES} SELECT id AS cluster_id, {m('quantile_cont(mz,0.5)')} AS mz_med, {m('quantile_cont(rt,0.5)')} AS rt_med FROM st GROUP BY id")
def _(spark, d):
    return summary(spark, d).select("cluster_id", micro(F.col("mz_med")).alias("mz_med"), micro(F.col("rt_med")).alias("rt_med"))


@register("weighted_median", f"WITH {ctes()}, {STUDIES}, w AS (SELECT id, mz, sum(k+1e0) OVER (PARTITION BY id ORDER BY mz) AS c, sum(k+1e0) OVER (PARTITION BY id) AS t FROM st) SELECT id, {m('min(mz)')} AS mz_wmed FROM w WHERE c>=t/2 GROUP BY id")
def _(spark, d):
    return stats.weighted_median(studies(spark, d).withColumn("w", F.col("k") + 1.0), ["id"], "mz", "w").select("id", micro(F.col("mz_wmed")).alias("mz_wmed"))


_EDGES = "e AS MATERIALIZED (SELECT DISTINCT l_suppkey*2 AS a, l_partkey*2+1 AS b FROM lineitem)"


def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")).distinct()


@register("connected_components", f"WITH RECURSIVE {_EDGES}, u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, lab) AS (SELECT a, a FROM u UNION SELECT u.b, r.lab FROM r JOIN u ON u.a=r.node WHERE r.lab<u.b) SELECT node, min(lab) AS component FROM r GROUP BY node")
def _(spark, d):
    return connected_components(edge_rows(spark, d))


@register("component_pick", f"WITH RECURSIVE {_EDGES}, u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, lab) AS (SELECT a, a FROM u UNION SELECT u.b, r.lab FROM r JOIN u ON u.a=r.node WHERE r.lab<u.b), c AS (SELECT node, min(lab) AS component FROM r GROUP BY node), g AS (SELECT a, count(*) AS deg FROM u GROUP BY a) SELECT component, study, node FROM (SELECT component, node%2 AS study, node, row_number() OVER (PARTITION BY component, node%2 ORDER BY deg DESC, node) AS n FROM c JOIN g ON g.a=c.node) q WHERE n=1")
def _(spark, d):
    from specmatch.operators.cluster import pick

    e = edge_rows(spark, d)
    nodes = connected_components(e).withColumn("study", F.col("node") % 2)
    return pick(nodes, e.withColumn("w", F.lit(1.0)))


@register("hub_score", f"WITH x AS ({X}), f AS (SELECT sample_id%4 AS study, feature_id, avg(CASE WHEN v>30 THEN 1e0 ELSE 0e0 END) AS dr FROM x GROUP BY 1,2), s AS (SELECT sample_id%4 AS study, count(DISTINCT sample_id) AS n FROM x GROUP BY 1) SELECT f.study, {m('sum(CASE WHEN dr>=0.05e0 THEN 1 ELSE 0 END)*ln(1e0+max(n))')} AS score FROM f JOIN s ON f.study=s.study GROUP BY f.study")
def _(spark, d):
    from specmatch.operators.cluster import hub_scores

    x = expression(spark, d).withColumn("study_id", F.col("sample_id") % 4).withColumn("v", F.col("v") - 30)
    return hub_scores(x).select(F.col("study_id").alias("study"), micro(F.col("score")).alias("score"))


@register("cluster_expr_long", f"WITH x AS ({X}) SELECT sample_id, feature_id%100 AS cluster_id, {m('max(v)')} AS v FROM x GROUP BY 1,2")
def _(spark, d):
    from specmatch.operators.cluster import expression_of

    x = expression(spark, d).withColumn("study_id", F.lit("one"))
    mapping = x.select("study_id", "feature_id").distinct().withColumn("cluster_id", F.col("feature_id") % 100)
    return expression_of(mapping, x).groupBy("sample_id", "cluster_id").agg(micro(F.max("v")).alias("v"))


# --- graphs --------------------------------------------------------------------------------------------------------

_Z = f"x AS (SELECT sample_id, feature_id, v FROM ({X}) y), zs AS (SELECT feature_id, avg(v) AS mu, stddev_samp(v) AS sd FROM x GROUP BY 1), z AS (SELECT x.sample_id, x.feature_id, (v-mu)/CASE WHEN sd>1e-8 THEN sd ELSE 1e0 END AS z FROM x JOIN zs USING (feature_id)), ns AS (SELECT count(DISTINCT sample_id) AS ns FROM x)"
_COR = f"{_Z}, cr AS (SELECT p.feature_id AS i, q.feature_id AS j, sum(p.z*q.z)/max(ns-1) AS r FROM z p JOIN z q ON p.sample_id=q.sample_id AND p.feature_id<>q.feature_id, ns GROUP BY 1,2)"


def whole(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    x = expression(spark, d)
    return x, x.agg(F.countDistinct("sample_id")).first()[0]


@register("corr_knn", f"WITH {_COR}, k AS (SELECT i, j, r, row_number() OVER (PARTITION BY i ORDER BY floor(abs(r)*1e9+0.5e0) DESC, j) AS n FROM cr) SELECT i, n, {m('abs(r)')} AS r FROM k WHERE n<=5")
def _(spark, d):
    x, n = whole(spark, d)
    return structure.corr_knn(x, 5, n).select("i", F.col("rank").cast("long").alias("n"), micro(F.abs("r")).alias("r"))


@register("local_rt_graph", f"WITH {ctes()}, f AS (SELECT id, rt, row_number() OVER (ORDER BY rt, id) AS pos FROM a) SELECT p.id AS i, q.id AS j, {m('q.rt-p.rt')} AS d_rt FROM f p JOIN f q ON p.id<>q.id AND abs(p.rt-q.rt)<=0.05e0 AND abs(p.pos-q.pos)<=3")
def _(spark, d):
    return structure.rt_neighbours(pair(spark, d)[0].select("id", "rt"), 0.05, 3).select("i", "j", micro(F.col("d_rt")).alias("d_rt"))


@register("structure_bonus")  # the triple product over the whole table is too much for SQL: a test holds it to dense arithmetic
def _(spark, d):
    x, n = whole(spark, d)
    g = structure.correlations(x, n, least=0.05).where(F.abs("r") > 0.05).select("i", "j", F.abs("r").alias("w"))
    f = x.select("feature_id").distinct()
    steps = F.explode(F.array(*[F.lit(k) for k in (-2, -1, 0, 1, 2)]))
    e = f.select(F.col("feature_id").alias("id1"), steps.alias("_k")).withColumn("id2", F.col("id1") + F.col("_k")).join(f.select(F.col("feature_id").alias("id2")), "id2").select("id1", "id2", (1.0 / (1.0 + F.abs("_k"))).alias("p_row_ot"))
    return structure.structure_bonus(e, g, g).select("id1", "id2", micro(F.col("struct_bonus")).alias("bonus"))


# --- adducts -------------------------------------------------------------------------------------------------------

_DELTAS = ", ".join(f"({x!r}e0, '{a}', '{b}')" for x, a, b in adducts.AdductConfig().deltas())
#: One study with its proton, ammonium and sodium ions side by side.
_IONS = "io AS (SELECT id*4+k AS id, mz+s AS mz, rt FROM a, (VALUES (0,1.007276466812e0),(1,18.033823e0),(2,22.989218e0)) t(k,s) WHERE id%3=0 OR k=0)"
_AE = f"""{ctes()}, {_IONS}, dl AS (SELECT * FROM (VALUES {_DELTAS}) t(d, f, t)),
ad AS (SELECT p.id AS i, q.id AS j, d, f, t, (q.mz-(p.mz+d))/(p.mz+d)*1e6 AS e, q.rt-p.rt AS dr FROM io p CROSS JOIN dl JOIN io q ON q.mz BETWEEN (p.mz+d)-(p.mz+d)*10e0/1e6 AND (p.mz+d)+(p.mz+d)*10e0/1e6 AND abs(q.rt-p.rt)<=0.05e0 AND p.id<>q.id),
ae AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(i,j), greatest(i,j) ORDER BY floor(abs(e)*1e6+0.5e0), i, d) AS n FROM ad) q WHERE n=1)"""


def ions(spark: SparkSession, d: str) -> DataFrame:
    k = spark.createDataFrame([(0, C.PROTON), (1, C.ADDUCTS_POSITIVE["NH4"]), (2, C.ADDUCTS_POSITIVE["NA"])], "k int, s double")
    return pair(spark, d)[0].crossJoin(F.broadcast(k)).where("id % 3 = 0 OR k = 0").select((F.col("id") * 4 + F.col("k")).alias("id"), (F.col("mz") + F.col("s")).alias("mz"), "rt")


@register("adduct_edges", f"WITH {_AE} SELECT least(i,j) AS id1, greatest(i,j) AS id2, {m('abs(d)')} AS delta FROM ae")
def _(spark, d):
    return adducts.adduct_edges(ions(spark, d)).select("id1", "id2", micro(F.abs("delta_da")).alias("delta"))


@register("adduct_groups", f"WITH RECURSIVE {_AE}, u AS (SELECT i AS a, j AS b FROM ae UNION ALL SELECT j, i FROM ae), r(node, lab) AS (SELECT a, a FROM u UNION SELECT u.b, r.lab FROM r JOIN u ON u.a=r.node WHERE r.lab<u.b), c AS (SELECT node, min(lab) AS g FROM r GROUP BY node) SELECT io.id, coalesce(g, io.id) AS group_id FROM io LEFT JOIN c ON c.node=io.id")
def _(spark, d):
    f = ions(spark, d)
    return adducts.adduct_groups(f, adducts.adduct_edges(f))


_MASSES = ", ".join(f"('{a}', {x!r}e0)" for a, x in adducts.AdductConfig().masses())
_LABELS = f"""{_AE}, u AS (SELECT i AS a, j AS b FROM ae UNION ALL SELECT j, i FROM ae), r(node, lab) AS (SELECT a, a FROM u UNION SELECT u.b, r.lab FROM r JOIN u ON u.a=r.node WHERE r.lab<u.b),
co AS (SELECT io.id, io.mz, coalesce(g, io.id) AS g FROM io LEFT JOIN (SELECT node, min(lab) AS g FROM r GROUP BY node) c ON c.node=io.id), ms AS (SELECT * FROM (VALUES {_MASSES}) t(ad, mass)),
gu AS (SELECT g, id, ad, mz-mass AS x FROM co, ms WHERE g IN (SELECT g FROM co GROUP BY g HAVING count(*)>1)),
ft AS (SELECT c.g, c.id AS cid, c.ad AS cad, p.id, p.ad, p.x, abs(p.x-c.x)/c.x*1e6 AS e FROM gu c JOIN gu p ON p.g=c.g WHERE c.x>0 AND abs(p.x-c.x)/c.x*1e6<=10e0),
ec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, cid, cad, id ORDER BY e, ad) AS n FROM ft) q WHERE n=1),
sc AS (SELECT g, cid, cad, count(*) AS n, quantile_cont(e,0.5) AS md, quantile_cont(x,0.5) AS nm FROM ec GROUP BY 1,2,3),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, floor(md*1e3+0.5e0), cid, cad) AS k FROM sc) q WHERE k=1)"""


@register("neutral_masses", f"WITH RECURSIVE {_LABELS} SELECT g AS group_id, {m('nm')} AS neutral_mass, n AS n_assigned FROM tp")
def _(spark, d):
    f = ions(spark, d)
    return adducts.neutral_masses(f.select("id", "mz"), adducts.adduct_groups(f, adducts.adduct_edges(f))).select("group_id", micro(F.col("neutral_mass")).alias("neutral_mass"), "n_assigned")


@register("adduct_labels", f"WITH RECURSIVE {_LABELS} SELECT ec.id, ec.ad AS adduct, {m('nm')} AS neutral_mass FROM tp JOIN ec ON ec.g=tp.g AND ec.cid=tp.cid AND ec.cad=tp.cad")
def _(spark, d):
    f = ions(spark, d)
    labels = adducts.adduct_labels(f.select("id", "mz"), adducts.adduct_groups(f, adducts.adduct_edges(f)))
    return labels.select("id", "adduct", micro(F.col("neutral_mass")).alias("neutral_mass"))


# --- repository metadata -------------------------------------------------------------------------------------------


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(s,'{w}')" for w in words) + ")"


_TEXTS = """t AS (SELECT event_id, event_type || ' values were ' || CASE user_id%8 WHEN 0 THEN 'Log2 and imputed' WHEN 1 THEN 'Pareto scaled' WHEN 2 THEN 'normalized collision energy' WHEN 3 THEN 'LOESS batch corrected' WHEN 4 THEN 'raw peak area' WHEN 5 THEN 'z-score of normalised data' WHEN 6 THEN 'ion counts' ELSE 'as is' END AS x FROM events)"""


@register("value_scale_classify", f"WITH {_TEXTS}, s AS (SELECT event_id, replace(replace(lower(x),'normalized collision energy','collision energy'),'normalised collision energy','collision energy') AS s FROM t), h AS (SELECT event_id, {_any(C.LOG_WORDS)} AS l, {_any(C.SCALE_WORDS)} AS c, {_any(C.NORM_WORDS)} AS n, {_any(C.RAW_WORDS)} AS r, contains(s,'imput') AS i, contains(s,'batch') AND (contains(s,'correct') OR contains(s,'drift')) AS b FROM s) SELECT event_id, CASE WHEN l THEN 'log_transformed' WHEN c THEN 'scaled' WHEN n THEN 'normalized' WHEN r THEN 'raw_like' ELSE 'unknown' END AS scale, concat_ws('|', CASE WHEN l THEN 'log_transformed' END, CASE WHEN c THEN 'scaled' END, CASE WHEN n THEN 'normalized' END, CASE WHEN i THEN 'imputed' END, CASE WHEN b THEN 'batch_adjusted' END) AS hints FROM h")
def _(spark, d):
    t = spark.sql(_TEXTS.removeprefix("t AS (")[:-1].replace("FROM events", "FROM {events}"), events=read(spark, d, "events"))
    scale, hints = C.value_scale(F.col("x"))
    return t.select("event_id", scale.alias("scale"), hints.alias("hints"))


_STRATA = "s AS (SELECT event_id, CASE user_id%4 WHEN 0 THEN 'POSITIVE ion' WHEN 1 THEN 'neg' WHEN 2 THEN '' ELSE 'both' END AS ion, CASE user_id%7 WHEN 0 THEN 'HILIC amide' WHEN 1 THEN 'Reversed phase' WHEN 2 THEN 'RP' WHEN 3 THEN 'C18 column' WHEN 4 THEN 'GC' WHEN 5 THEN '' ELSE 'carp' END AS chrom, CASE user_id%5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'neutral masses' WHEN 3 THEN '' ELSE '?' END AS yn FROM events)"
_CANON = "CASE WHEN lower(ion) LIKE '%pos%' THEN 'positive' WHEN lower(ion) LIKE '%neg%' THEN 'negative' ELSE 'unknown' END AS ion_mode, CASE WHEN chrom='' THEN 'unknown' WHEN lower(chrom) LIKE '%hilic%' THEN 'hilic' WHEN lower(chrom) LIKE '%reverse%' OR regexp_matches(lower(chrom),'\\brp\\b') OR lower(chrom) LIKE '%c18%' THEN 'reversed_phase' WHEN lower(chrom) LIKE '%gc%' THEN 'gc' ELSE 'other' END AS chromatography"


def strata(spark: SparkSession, d: str) -> DataFrame:
    s = spark.sql(_STRATA.removeprefix("s AS (")[:-1].replace("FROM events", "FROM {events}"), events=read(spark, d, "events"))
    return s.select("event_id", "yn", C.ion_mode(F.col("ion")).alias("ion_mode"), C.chromatography(F.col("chrom")).alias("chromatography"))


@register("canonical_strata", f"WITH {_STRATA} SELECT event_id, {_CANON}, CASE WHEN yn='' THEN 'unknown' WHEN lower(yn) LIKE 'y%' THEN 'yes' WHEN lower(yn) LIKE 'n%' THEN 'no' ELSE 'other' END AS yes_no, CASE WHEN yn='' THEN 'unknown' WHEN lower(yn) LIKE '%neutral%' THEN 'neutral_masses' WHEN lower(yn) LIKE 'y%' THEN 'yes' WHEN lower(yn) LIKE 'n%' THEN 'no' ELSE 'other' END AS semantics FROM s")
def _(spark, d):
    return strata(spark, d).select("event_id", "ion_mode", "chromatography", C.yes_no(F.col("yn")).alias("yes_no"), C.mz_semantics(F.col("yn")).alias("semantics"))


@register("strata_grouping", f"WITH {_STRATA}, c AS (SELECT event_id, {_CANON} FROM s) SELECT ion_mode || '__' || chromatography AS group_id, count(*) AS n FROM c WHERE ion_mode IN ('positive','negative') AND chromatography NOT IN ('unknown','other') GROUP BY 1 HAVING count(*)>=2")
def _(spark, d):
    from specmatch.plans.reuse import group_analyses

    kept, _ = group_analyses(strata(spark, d).withColumnRenamed("event_id", "analysis_id"), 2)
    return kept.groupBy("group_id").agg(F.count("*").alias("n"))


@register("metabolite_name_normalize", "SELECT p_partkey, upper(regexp_replace(trim('  ' || replace(p_name,' ','   ') || ' '),'\\s+',' ','g')) AS name FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", C.metabolite_name(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" "))).alias("name"))


@register("shared_all_intersect", "WITH l AS (SELECT DISTINCT l_suppkey%3 AS an, l_partkey AS name FROM lineitem) SELECT name FROM l GROUP BY name HAVING count(DISTINCT an)=3")
def _(spark, d):
    from specmatch.plans.reuse import shared_all

    return shared_all(read(spark, d, "lineitem").select((F.col("l_suppkey") % 3).alias("analysis_id"), F.col("l_partkey").alias("name")), 3)


@register("shared_pairs", "WITH l AS (SELECT DISTINCT l_suppkey%5 AS an, l_partkey AS name FROM lineitem) SELECT p.an AS analysis_1, q.an AS analysis_2, count(*) AS n_shared FROM l p JOIN l q ON p.name=q.name AND p.an<q.an GROUP BY 1,2")
def _(spark, d):
    from specmatch.plans.reuse import shared_pairs

    return shared_pairs(read(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("analysis_id"), F.col("l_partkey").alias("name"))).groupBy("analysis_1", "analysis_2").agg(F.count("*").alias("n_shared"))


@register("facet_counts", "SELECT coalesce(nullif(CASE WHEN user_id%9=0 THEN '' ELSE event_type END,''),'<missing>') AS value, count(*) AS n FROM events WHERE user_id%5 IN (1,2) GROUP BY 1")
def _(spark, d):
    from specmatch.plans.finder import facet_counts

    e = read(spark, d, "events").select(F.when(F.col("user_id") % 9 == 0, "").otherwise(F.col("event_type")).alias("kind"), (F.col("user_id") % 5).cast("string").alias("stratum"))
    return facet_counts(e, "kind", {"stratum": {"1", "2"}, "kind": {"nothing"}})


@register("sample_buckets", "SELECT CASE WHEN c IS NULL THEN '<missing>' WHEN c<=5 THEN '1-5' WHEN c<=10 THEN '6-10' WHEN c<=20 THEN '11-20' WHEN c<=50 THEN '21-50' WHEN c<=100 THEN '51-100' ELSE '101+' END AS bucket, count(*) AS n FROM (SELECT CASE WHEN user_id%10=0 THEN NULL ELSE count(*) END AS c FROM events GROUP BY user_id) q GROUP BY 1")
def _(spark, d):
    c = read(spark, d, "events").groupBy("user_id").count().select(F.when(F.col("user_id") % 10 != 0, F.col("count")).alias("c"))
    return c.groupBy(C.sample_bucket(F.col("c")).alias("bucket")).agg(F.count("*").alias("n"))


@register("text_filter", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def _(spark, d):
    from specmatch.plans.finder import text_filter

    return text_filter(read(spark, d, "part"), ["p_name", "p_brand", "p_type"], "Brand#1").select("p_partkey")


@register("id_canonicalize", "SELECT p_partkey, 'AN' || CASE WHEN length(CAST(p_partkey*7919 AS VARCHAR))>=6 THEN CAST(p_partkey*7919 AS VARCHAR) ELSE lpad(CAST(p_partkey*7919 AS VARCHAR),6,'0') END AS an FROM part")
def _(spark, d):
    n = (F.col("p_partkey") * 7919).cast("string")
    return read(spark, d, "part").select("p_partkey", C.canonical_id(F.when(F.col("p_partkey") % 3 == 0, n).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" an00"), n)).otherwise(F.concat(F.lit("AN"), n, F.lit(" "))), "AN").alias("an"))


@register("json_key_lookup", "SELECT event_id, CAST(json_extract_string(props,'$.k') AS VARCHAR) AS k FROM events")
def _(spark, d):
    p = F.from_json("props", "map<string,string>")
    return read(spark, d, "events").select("event_id", C.key_lookup(F.transform_keys(p, lambda k, v: F.concat(F.upper(k), F.lit(":"))), "k").alias("k"))


@register("hedges_g", f"WITH x AS ({X}), y AS (SELECT feature_id%200 AS cluster_id, sample_id%2 AS o, ln(1e0+v) AS v FROM x), s AS (SELECT cluster_id, count(CASE WHEN o=1 THEN 1 END) AS n1, count(CASE WHEN o=0 THEN 1 END) AS n0, avg(CASE WHEN o=1 THEN v END) AS m1, avg(CASE WHEN o=0 THEN v END) AS m0, var_samp(CASE WHEN o=1 THEN v END) AS s1, var_samp(CASE WHEN o=0 THEN v END) AS s0 FROM y GROUP BY 1), g AS (SELECT *, (1e0-3e0/(4e0*(n1+n0)-9e0))*(m1-m0)/sqrt(((n1-1)*s1+(n0-1)*s0)/(n1+n0-2)) AS g FROM s WHERE n1>=2 AND n0>=2) SELECT cluster_id, {m('g')} AS g, {m('sqrt((n1+n0)/(n1*n0*1e0)+g*g/(2e0*(n1+n0-2)))')} AS se, {m('g/sqrt((n1+n0)/(n1*n0*1e0)+g*g/(2e0*(n1+n0-2)))')} AS z FROM g")
def _(spark, d):
    from specmatch.operators.effects import hedges_g

    x = expression(spark, d).select((F.col("feature_id") % 200).alias("cluster_id"), (F.col("sample_id") % 2).alias("outcome"), F.col("v"))
    return hedges_g(x).where("hedges_g IS NOT NULL").select("cluster_id", micro(F.col("hedges_g")).alias("g"), micro(F.col("se")).alias("se"), micro(F.col("z")).alias("z"))


# --- whole plans and iterative fits: no SQL equivalent; tests hold them to numpy and to the known truth ----------------


@register("match_default")
def _(spark, d):
    from specmatch.plans.match import match_features

    a, b = (x.select("id", F.col("mz").alias("MZ"), F.col("rt").alias("RT")) for x in pair(spark, d))
    return match_features(a, b).top1.select("id1", "id2", "decision", "prob_raw", "margin", "p_null", "top1_source")


@register("huber_drift")
def _(spark, d):
    from specmatch.operators import drift

    p = bandjoin.mutual(*pair(spark, d), 7.0).withColumn("ppm", C.ppm_over_mean(F.col("mz1"), F.col("mz2")))
    fit = drift.robust_linear(p, "mz1", "ppm")
    return spark.createDataFrame([(fit.slope, fit.intercept)], "slope double, intercept double")


@register("lowess_drift")
def _(spark, d):
    from specmatch.operators import drift

    p = bandjoin.mutual(*pair(spark, d), 7.0).withColumn("ppm", C.ppm_over_mean(F.col("mz1"), F.col("mz2")))
    return spark.createDataFrame(list(zip(*(v.tolist() for v in drift.lowess_curve(p, "mz1", "ppm", 10)))), "mz double, ppm_fit double")


@register("ransac_transfer")
def _(spark, d):
    from specmatch.operators.align import infer_transfer
    from specmatch.plans.config import MatchConfig

    t = infer_transfer(*pair(spark, d), MatchConfig())
    return spark.createDataFrame([(t.policy, t.scale, t.offset, t.n_anchors, t.n_inliers)], "policy string, scale double, offset double, n_anchors long, n_inliers long")


@register("stable_graph")
def _(spark, d):
    return structure.stable_knn(expression(spark, d), 5, n_boot=5)


from specmatch import plan_queries  # noqa: E402, F401  registers its own
