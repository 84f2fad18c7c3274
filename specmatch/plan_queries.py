"""Registered queries of sources, sinks, repository plans and whole-study plans; the same in plain SQL beside them.

A query of a reader writes the driver tables in the layout it reads, into the shared folder, and reads them back.
"""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmatch.functions import columns as C
from specmatch.functions.columns import PROTON, micro
from specmatch.operators import align, bandjoin, cluster, decide, drift, stats, structure
from specmatch.plans import finder, match, reuse
from specmatch.plans.config import MatchConfig
from specmatch.queries import LOCAL, MNN, STUDIES, TOPS, band, m, nn_sql, read, register, softmax, softmax_rows, strata, studies, tops, _CANON, _PAIRS, _STRATA
from specmatch.session import cut, temporary
from specmatch.sources import metadata, readers
from specmatch.sources.views import X, ctes, expression, pair


# --- feature tables and matrices -------------------------------------------------------------------------------------


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Study a by way of a file: written as CSV, in order of id, and read again."""
    at = temporary(spark, "query") + "/features.csv"
    readers.write_table(pair(spark, d)[0].orderBy("id").select(F.col("id").alias("part"), F.col("mz").alias("MZ"), F.col("rt").alias("RT")), at)
    return readers.read_features(spark, at)


@register("csv_features", f"WITH {ctes()} SELECT id AS part, {m('mz')} AS mz, {m('rt')} AS rt FROM a")
def _(spark, d):
    return _features(spark, d).select(F.col("part").cast("long").alias("part"), micro(F.col("MZ")).alias("mz"), micro(F.col("RT")).alias("rt"))


@register("row_position_ids", f"WITH {ctes()} SELECT id AS part, row_number() OVER (ORDER BY id)-1 AS id FROM a")
def _(spark, d):
    return match.with_ids(_features(spark, d)).select(F.col("part").cast("long").alias("part"), F.col("id").cast("long").alias("id"))


#: Samples by 25 features; not every sample has every feature.
CELLS = "SELECT l_suppkey AS s, l_partkey%25 AS k, sum(l_quantity) AS v FROM lineitem WHERE (l_suppkey+l_partkey)%5<>0 GROUP BY 1,2"
_GRID = f"cells AS ({CELLS}), ks AS (SELECT DISTINCT l_partkey%25 AS k FROM lineitem), ss AS (SELECT DISTINCT s FROM cells), grid AS (SELECT ss.s, ks.k, cells.v FROM ss CROSS JOIN ks LEFT JOIN cells ON cells.s=ss.s AND cells.k=ks.k)"


def _wide(spark: SparkSession, d: str, names: list[str], first: str) -> DataFrame:
    cells = spark.sql(CELLS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read(spark, d, "lineitem"))
    wide = cells.groupBy("s").pivot("k", list(range(25))).agg(F.first("v")).orderBy("s")
    return wide.select(F.col("s").cast("string").alias(first), *[F.col(str(k)).cast("string").alias(n) for k, n in enumerate(names)])


def _mz(k: int) -> float:
    return 100.0 + 31.25 * k


def _rt(k: int) -> float:
    return 0.5 + 0.75 * k


def _special(spark: SparkSession, d: str) -> str:
    names, at = [f"f{k}" for k in range(25)], temporary(spark, "query") + "/matrix.tsv"
    wide = _wide(spark, d, names, "Samples")
    head = spark.createDataFrame([("m/z", *(str(_mz(k)) for k in range(25))), ("rt", *(str(_rt(k)) for k in range(25)))], wide.schema)
    readers.write_table(head.coalesce(1).unionByName(wide), at, "\t")
    return at


def _separate(spark: SparkSession, d: str) -> tuple[str, str]:
    """A matrix of all features and a table that lacks each fifth."""
    at = temporary(spark, "query")
    readers.write_table(_wide(spark, d, [f"f{k}" for k in range(25)], "sample"), f"{at}/matrix.csv", ";")
    readers.write_table(spark.createDataFrame([(_rt(k), f"f{k}", _mz(k)) for k in range(25) if k % 5 != 4], "RT double, Feature_ID string, mz double"), f"{at}/features.tsv", "\t")
    return f"{at}/matrix.csv", f"{at}/features.tsv"


_FEATURE = f"'f' || k AS feature_id, {m('100e0+31.25e0*k')} AS mz, {m('0.5e0+0.75e0*k')} AS rt, {m('avg(coalesce(v,0e0))')} AS intensity"


def _shown(f: DataFrame) -> DataFrame:
    return f.select("feature_id", micro(F.col("MZ")).alias("mz"), micro(F.col("RT")).alias("rt"), micro(F.col("Intensity")).alias("intensity"))


def _values(x: DataFrame) -> DataFrame:
    return x.select(F.col("sample_id").cast("long").alias("sample_id"), "feature_id", micro(F.col("v")).alias("v"))


@register("matrix_special_rows", f"WITH {_GRID} SELECT {_FEATURE} FROM grid GROUP BY k")
def _(spark, d):
    return _shown(readers.read_matrix(spark, _special(spark, d))[0])


@register("matrix_values", f"WITH {_GRID} SELECT s AS sample_id, 'f' || k AS feature_id, {m('v')} AS v FROM grid")
def _(spark, d):
    return _values(readers.read_matrix(spark, _special(spark, d), na_as_zero=False)[1])


@register("matrix_encoded_headers", f"WITH {_GRID} SELECT {m('100e0+31.25e0*k')} AS mz, {m('0.5e0+0.75e0*k')} AS rt, {m('avg(coalesce(v,0e0))')} AS intensity, count(*) AS n FROM grid GROUP BY k")
def _(spark, d):
    at = temporary(spark, "query") + "/matrix.tsv"
    readers.write_table(_wide(spark, d, [f"{_rt(k)}_{_mz(k)}" for k in range(25)], "Samples").withColumn("remark", F.lit("none")), at, "\t")
    f, x = readers.read_matrix(spark, at)
    return _shown(f).join(x.groupBy("feature_id").agg(F.count("*").alias("n")), "feature_id").drop("feature_id")


@register("separate_tables", f"WITH {_GRID} SELECT {_FEATURE}, count(*) AS n FROM grid WHERE k%5<>4 GROUP BY k")
def _(spark, d):
    f, x = readers.read_tables(spark, *_separate(spark, d))
    return _shown(f).join(x.groupBy("feature_id").agg(F.count("*").alias("n")), "feature_id", "full")


@register("load_study", f"WITH {_GRID} SELECT 'one' AS study_id, {_FEATURE} FROM grid GROUP BY k UNION ALL SELECT 'two', {_FEATURE} FROM grid WHERE k%5<>4 GROUP BY k")
def _(spark, d):
    matrix, table = _separate(spark, d)
    specs = [readers.StudySpec("one", "mw_special_rows", _special(spark, d)), readers.StudySpec("two", "separate_tables", matrix, table)]
    one, two = (readers.load_study(spark, s)[0] for s in specs)
    both = one.unionByName(two)
    return both.select("study_id", "feature_id", micro(F.col("MZ")).alias("mz"), micro(F.col("RT")).alias("rt"), micro(F.col("Intensity")).alias("intensity"))


@register("header_sniff", "SELECT n_regionkey AS region, sum(CASE WHEN n_nationkey*10+0.5>=40 THEN 1 ELSE 0 END) AS n FROM nation GROUP BY 1")
def _(spark, d):
    tokens: dict[int, list[str]] = {}
    for r in read(spark, d, "nation").orderBy("n_nationkey").collect():  # 25 rows: header lines of a few names
        tokens.setdefault(r.n_regionkey, ["Samples", "no_number"]).append(f"{r.n_nationkey * 10}.5_{r.n_regionkey}")
    return spark.createDataFrame([(k, readers.feature_count("\t".join(v))) for k, v in tokens.items()], "region int, n long")


@register("study_manifest", "SELECT n_name AS analysis_id, 'separate_tables' AS feature_format, CASE WHEN n_regionkey%2=0 THEN 'positive' ELSE 'negative' END AS polarity, 'm' || n_nationkey || '.csv' AS matrix, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def _(spark, d):
    rows = [{("analysis_id" if r.n_nationkey % 2 else "study_id"): r.n_name, "feature_format": "separate_tables", "matrix_path": f"m{r.n_nationkey}.csv", "polarity": "Positive" if r.n_regionkey % 2 == 0 else "NEGATIVE", "region": r.n_regionkey} for r in read(spark, d, "nation").collect()]
    with tempfile.TemporaryDirectory() as at:  # the driver alone reads a manifest
        path = Path(at, "studies.json")
        path.write_text(json.dumps({"studies": rows}))
        specs = readers.load_manifest(str(path))
    return spark.createDataFrame([(s.analysis_id, s.feature_format, s.polarity, Path(s.matrix_path).name, s.metadata["region"]) for s in specs], "analysis_id string, feature_format string, polarity string, matrix string, region long")


@register("analysis_list", "SELECT 'AN' || lpad(CAST(n_nationkey+1 AS VARCHAR),6,'0') AS analysis_id FROM nation")
def _(spark, d):
    ids = [r[0] + 1 for r in read(spark, d, "nation").select("n_nationkey").collect()]
    half = len(ids) // 2
    with tempfile.TemporaryDirectory() as at:
        path = Path(at, "ids.txt")
        path.write_text("# analyses\n" + "\n".join(f"an{i}  # again" for i in ids[half - 2 :]))
        found = readers.analysis_ids([f"AN00{i}" for i in ids[:half]] + [str(i) for i in ids[:2]], str(path))
    return spark.createDataFrame([(x,) for x in found], "analysis_id string")


# --- sinks -------------------------------------------------------------------------------------------------------------


@register("sink_wide_matrix", f"WITH x AS ({X}) SELECT sample_id, 'C' || feature_id%40 AS cluster_id, {m('max(v)')} AS v FROM x WHERE feature_id%3<>sample_id%3 GROUP BY 1,2")
def _(spark, d):
    """A sample by cluster matrix written as one gzipped TSV file and read again; cells that are not there are left out."""
    x = expression(spark, d).where("feature_id % 3 != sample_id % 3").select(F.col("sample_id"), F.concat(F.lit("C"), F.col("feature_id") % 40).alias("cluster_id"), "v")
    at, names = temporary(spark, "query") + "/matrix.tsv.gz", [f"C{k}" for k in range(40)]
    readers.write_wide(x.groupBy("sample_id", "cluster_id").agg(F.max("v").alias("v")), at, names)
    wide = spark.read.csv(at, sep="\t", header=True)
    long = wide.select(F.col("sample_id").cast("long").alias("sample_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("cluster_id"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")).select("sample_id", "x.*")
    return long.where("v IS NOT NULL").select("sample_id", "cluster_id", micro(F.col("v")).alias("v"))


@register("sink_candidates", f"WITH {LOCAL} SELECT id1, id2, {m('p')} AS p FROM lo")
def _(spark, d):
    at = temporary(spark, "query") + "/candidates.csv"
    readers.write_table(softmax(spark, d, 1.0).select("id1", "id2", "p_row"), at)
    return spark.read.schema("id1 long, id2 long, p double").csv(at, header=True).select("id1", "id2", micro(F.col("p")).alias("p"))


# --- repository documents ----------------------------------------------------------------------------------------------

_ANALYSES = """SELECT c_custkey AS n, CASE c_custkey%4 WHEN 0 THEN 'POSITIVE' WHEN 1 THEN 'Neg. mode' WHEN 2 THEN '' ELSE 'both' END AS ion,
  CASE c_custkey%5 WHEN 0 THEN 'HILIC' WHEN 1 THEN 'Reversed phase LC' WHEN 2 THEN 'GC' WHEN 3 THEN '' ELSE 'ion exchange' END AS chrom,
  CASE c_custkey%6 WHEN 0 THEN 'Peak area' WHEN 1 THEN 'log2 of values' WHEN 2 THEN 'Pareto scaled' WHEN 3 THEN 'normalized' WHEN 4 THEN '' ELSE 'pmol' END AS unit,
  CASE c_custkey%3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'neutral masses' ELSE 'no' END AS mz, CASE c_custkey%2 WHEN 0 THEN 'Seconds' ELSE 'min' END AS ru FROM customer"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    a = spark.sql(_ANALYSES.replace("FROM customer", "FROM {customer}"), customer=read(spark, d, "customer"))
    text = F.concat(F.lit("R"), F.col("n"), F.lit(".txt UNITS:"), "unit", F.lit(" Has m/z:"), "mz", F.lit(" Has RT:Yes RT units:"), "ru")
    return a.select(
        "n",
        F.to_json(
            F.struct(
                F.struct(F.concat(F.lit("an"), F.col("n")).alias("Analysis ID"), F.concat(F.lit("ST"), F.col("n") % 7).alias("STUDY_ID")).alias("METABOLOMICS WORKBENCH"),
                F.struct(F.col("chrom").alias("CHROMATOGRAPHY_TYPE")).alias("CHROMATOGRAPHY"),
                F.struct(F.col("ion").alias("ION_MODE"), text.alias("MS_RESULTS_FILE")).alias("MS"),
            )
        ).alias("json"),
    )


_SCALE = "CASE unit WHEN 'Peak area' THEN 'raw_like' WHEN 'log2 of values' THEN 'log_transformed' WHEN 'Pareto scaled' THEN 'scaled' WHEN 'normalized' THEN 'normalized' ELSE 'unknown' END"


@register("metadata_fields", f"WITH t AS ({_ANALYSES}) SELECT 'AN' || lpad(CAST(n AS VARCHAR),6,'0') AS analysis_id, 'ST' || n%7 AS study_id, ion AS ion_mode_raw, CASE n%4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'unknown' END AS ion_mode_norm, CASE n%5 WHEN 0 THEN 'hilic' WHEN 1 THEN 'reversed_phase' WHEN 2 THEN 'gc' WHEN 3 THEN 'unknown' ELSE 'other' END AS chromatography_norm, unit AS ms_results_units, CASE n%3 WHEN 0 THEN 'yes' WHEN 1 THEN 'neutral_masses' ELSE 'no' END AS ms_results_has_mz_semantics, CASE n%2 WHEN 0 THEN 'seconds' ELSE 'minutes' END AS ms_results_rt_units, {_SCALE} AS value_scale FROM t")
def _(spark, d):
    return metadata.metadata(_documents(spark, d)).select("analysis_id", "study_id", "ion_mode_raw", "ion_mode_norm", "chromatography_norm", "ms_results_units", "ms_results_has_mz_semantics", "ms_results_rt_units", "value_scale")


@register("cached_documents", f"WITH t AS ({_ANALYSES}) SELECT 'AN' || lpad(CAST(n AS VARCHAR),6,'0') AS analysis_id, 'AN' || lpad(CAST(n AS VARCHAR),6,'0') AS hint, CASE n%4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'unknown' END AS ion_mode_norm FROM t")
def _(spark, d):
    """A cache folder of one document to a file, read back whole."""
    at = temporary(spark, "query")
    named = _documents(spark, d).withColumn("id", F.format_string("AN%06d", F.col("n")))
    metadata.write_cache(named.select("id", F.col("json").alias("value")), f"{at}/cache")
    docs = cut(metadata.read_cache(spark, f"{at}/cache"))
    return metadata.metadata(docs).join(docs.select(F.col("analysis_id_hint").alias("hint")), F.col("analysis_id") == F.col("hint")).select("analysis_id", "hint", "ion_mode_norm")


@register("labelled_metabolites", "SELECT o_custkey AS n, upper(o_orderpriority) AS name, 'K' || o_orderkey AS kegg_id, 'mwtab_ms_metabolite_data' AS source FROM orders WHERE o_orderkey%9<>0")
def _(spark, d):
    item = F.struct(F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.concat(F.lit(" "), F.replace("o_orderpriority", F.lit(" "), F.lit("  ")))).alias("Metabolite"), F.concat(F.lit("K"), "o_orderkey").alias("KEGG ID"))
    docs = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("n")).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("Metabolites")).alias("MS_METABOLITE_DATA"))).alias("json"))
    return metadata.labelled_metabolites(docs).select("n", "name", "kegg_id", "source")


_RECORDS = "SELECT o_custkey AS n, o_orderkey AS k, upper(o_orderpriority) AS name, CASE WHEN o_orderkey%4=0 THEN 'ME' || o_orderkey%100 ELSE '' END AS met, CASE WHEN o_orderkey%4=0 THEN 'ME' || o_orderkey%100 ELSE 'NAME:' || upper(o_orderpriority) END AS col, o_totalprice AS v, o_orderstatus AS st FROM orders"


def _study_documents(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    record = F.struct(F.concat(F.lit("ST"), "o_custkey").alias("study_id"), F.lit("an12").alias("analysis_id"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("ME"), F.col("o_orderkey") % 100)).alias("metabolite_id"), F.col("o_orderpriority").alias("metabolite_name"), F.create_map(F.lit("s1"), F.col("o_totalprice").cast("string"), F.lit("s2"), F.when(F.col("o_orderstatus") == "F", "n/a").otherwise("1.5")).alias("DATA"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.to_json(record).alias("r"))))
    text = F.array_join(F.transform(rows, lambda x: F.concat(F.lit('"'), x["k"].cast("string"), F.lit('":'), x["r"])), ",")
    return o.groupBy(F.col("o_custkey").alias("n")).agg(F.concat(F.lit("{"), text, F.lit("}")).alias("json"))


@register("study_data_metabolites", f"WITH r AS ({_RECORDS}) SELECT n, name, met AS metabolite_id, col AS matrix_col, 'AN000012' AS analysis_id, count(*) AS records FROM r GROUP BY ALL")
def _(spark, d):
    named = metadata.study_data(_study_documents(spark, d))[0]
    return named.groupBy("n", "name", "metabolite_id", "matrix_col", "analysis_id").agg(F.count("*").alias("records"))


@register("study_data_matrix", f"WITH r AS ({_RECORDS}), l AS (SELECT *, row_number() OVER (PARTITION BY n, col ORDER BY k DESC) AS q FROM r) SELECT n, col AS feature_id, 's1' AS sample_id, {m('v')} AS v FROM l WHERE q=1 UNION ALL SELECT n, col, 's2', CASE WHEN st<>'F' THEN 1500000 END FROM l WHERE q=1")
def _(spark, d):
    return metadata.study_data(_study_documents(spark, d))[1].select("n", "feature_id", "sample_id", micro(F.col("v")).alias("v"))


@register("best_names", "SELECT an AS analysis_id, name, source, seq FROM (SELECT l_suppkey%7 AS an, 'N' || l_partkey%50 AS name, CASE l_linenumber%3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source, l_orderkey*10+l_linenumber AS seq, row_number() OVER (PARTITION BY l_suppkey%7, l_partkey%50 ORDER BY CASE l_linenumber%3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END, l_orderkey*10+l_linenumber) AS n FROM lineitem) q WHERE n=1")
def _(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("analysis_id"), F.concat(F.lit("N"), F.col("l_partkey") % 50).alias("name"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return reuse.best_names(rows, {"b": 0, "c": 1})


@register("dropped_ledger", f"WITH {_STRATA}, c AS (SELECT event_id, {_CANON} FROM s), z AS (SELECT *, count(*) OVER (PARTITION BY ion_mode, chromatography) AS n, ion_mode NOT IN ('positive','negative') OR chromatography IN ('unknown','other') AS u FROM c) SELECT event_id AS analysis_id, CASE WHEN u THEN 'unknown_strata' ELSE 'group_below_min_size' END AS reason FROM z WHERE u OR n<(SELECT count(*)/30 FROM c)")
def _(spark, d):
    s = strata(spark, d).withColumnRenamed("event_id", "analysis_id")
    return reuse.group_analyses(s, -(-s.count() // 30))[1]


_POLICY = "SELECT event_type AS kind, CASE event_type WHEN 'view' THEN 'raw_like' WHEN 'click' THEN CASE WHEN user_id%2=0 THEN 'raw_like' ELSE 'scaled' END WHEN 'error' THEN 'normalized' WHEN 'purchase' THEN 'unknown' ELSE 'raw_like' END AS value_scale, CASE WHEN event_type='signup' AND user_id%3=0 THEN 'qtof' ELSE ' Orbitrap' END AS instrument_type FROM events"


@register("intensity_policy", f"WITH p AS ({_POLICY}), g AS (SELECT kind, bool_or(value_scale IN ('log_transformed','scaled')) AS a, bool_or(value_scale='normalized') AS b, bool_or(value_scale='unknown') AS c, count(DISTINCT lower(trim(instrument_type))) AS n FROM p GROUP BY 1) SELECT kind, NOT (a OR b OR c OR n>1) AS used, CASE WHEN a THEN 'auto_disabled_scaled_or_log_values' WHEN b THEN 'auto_disabled_normalized_values' WHEN c THEN 'auto_disabled_unknown_value_scale' WHEN n>1 THEN 'auto_disabled_mixed_instrument_families' ELSE 'auto_enabled_raw_like_single_instrument_family' END AS reason FROM g")
def _(spark, d):
    p = spark.sql(_POLICY.replace("FROM events", "FROM {events}"), events=read(spark, d, "events"))
    kinds = [r[0] for r in p.select("kind").distinct().collect()]  # five event types
    out = [(k, *reuse.resolve_intensity(p.where(F.col("kind") == k), "auto")) for k in kinds]
    return spark.createDataFrame([(k, used, reason) for k, used, _, reason in out], "kind string, used boolean, reason string")


_DISEASES = "SELECT 'D' || user_id%12 AS disease, 'ST' || user_id%40 AS study_id FROM events"


@register("disease_counts", f"SELECT disease, count(DISTINCT study_id) AS n FROM ({_DISEASES}) x GROUP BY 1")
def _(spark, d):
    return finder.disease_counts(spark.sql(_DISEASES.replace("FROM events", "FROM {events}"), events=read(spark, d, "events")))


@register("disease_studies", f"WITH x AS ({_DISEASES}), s AS (SELECT 'ST' || c_custkey AS study_id, c_name AS title FROM customer WHERE c_custkey%4<>0) SELECT DISTINCT x.study_id, s.title FROM x LEFT JOIN s ON s.study_id=x.study_id WHERE disease='D5'")
def _(spark, d):
    x = spark.sql(_DISEASES.replace("FROM events", "FROM {events}"), events=read(spark, d, "events"))
    s = read(spark, d, "customer").where("c_custkey % 4 != 0").select(F.concat(F.lit("ST"), "c_custkey").alias("study_id"), F.col("c_name").alias("title"))
    return finder.drill_down(x, s, "D5")


@register("facet_forms", f"WITH {_STRATA} SELECT event_id, CASE WHEN lower(ion) LIKE '%pos%' THEN 'positive' WHEN lower(ion) LIKE '%neg%' THEN 'negative' ELSE lower(ion) END AS ion_mode, CASE WHEN lower(chrom) LIKE '%hilic%' THEN 'hilic' WHEN lower(chrom) LIKE '%reverse%' OR lower(chrom) LIKE '%rp%' OR lower(chrom) LIKE '%c18%' THEN 'reversed_phase' WHEN lower(chrom) LIKE '%gc%' THEN 'gc' ELSE lower(chrom) END AS chromatography, upper(yn) AS instrument FROM s")
def _(spark, d):
    s = spark.sql(_STRATA.removeprefix("s AS (")[:-1].replace("FROM events", "FROM {events}"), events=read(spark, d, "events"))
    return s.select("event_id", C.facet_ion_mode(F.col("ion")).alias("ion_mode"), C.facet_chromatography(F.col("chrom")).alias("chromatography"), C.facet_instrument(F.col("yn")).alias("instrument"))


# --- parts of a match ----------------------------------------------------------------------------------------------------

#: The dense pair with an intensity, a variation and a retention order of each feature.
_FULL = f"{ctes(True)}, fa AS (SELECT *, id%11/10e0 AS int, id%7/20e0 AS cv, id%13/13e0 AS ro FROM a), fb AS (SELECT *, id%17/10e0 AS int, id%9/20e0 AS cv, id%19/19e0 AS ro FROM b)"


def full(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a, b = pair(spark, d, True)
    put = lambda f, i, c, r: f.withColumn("int", F.col("id") % i / F.lit(10.0)).withColumn("cv", F.col("id") % c / F.lit(20.0)).withColumn("ro", F.col("id") % r / F.lit(float(r)))
    return put(a, 11, 7, 13), put(b, 17, 9, 19)


_PPM = "(b.mz-a.mz)/((a.mz+b.mz)/2e0)*1e6"
_JOIN = "fa a JOIN fb b ON "


@register("edge_differences", f"WITH {_FULL} SELECT a.id AS id1, b.id AS id2, {m(_PPM)} AS ppm, {m('b.rt-a.rt')} AS rt, {m('b.int-a.int')} AS int, {m('b.cv-a.cv')} AS cv, {m('b.ro-a.ro')} AS roi FROM {_JOIN}{band(20)}")
def _(spark, d):
    e = match.differences(bandjoin.band_join(*full(spark, d), 20.0))
    return e.select("id1", "id2", *[micro(F.col(c)).alias(n) for c, n in (("delta_ppm_raw", "ppm"), ("delta_rt", "rt"), ("intensity_log_diff", "int"), ("cv_log_diff", "cv"), ("delta_roi", "roi"))])


@register("candidate_gates", f"WITH {_FULL} SELECT a.id AS id1, b.id AS id2 FROM {_JOIN}{band(20)} AND abs(b.rt-a.rt)<=12e0 AND abs(b.int-a.int)<=0.55e0")
def _(spark, d):
    return match.candidates(*full(spark, d), MatchConfig(rt=12.0, use_intensity=True, intensity_log_diff_max=0.55)).select("id1", "id2")


_TIGHT = "abs(b.rt-a.rt)<=15e0 AND abs(b.ro-a.ro)<=0.45e0 AND abs(b.int-a.int)<=0.75e0"


def _gated(strategy: str) -> MatchConfig:
    return MatchConfig(tight_anchor_strategy=strategy, tight_rt=15.0, tight_roi=0.45, use_intensity=True, tight_intensity_log_diff=0.75)


@register("tight_gates_all", f"WITH {_FULL} SELECT a.id AS id1, b.id AS id2 FROM {_JOIN}{band(7)} AND {_TIGHT}")
def _(spark, d):
    return match.anchors(*full(spark, d), _gated("all")).select("id1", "id2")


def _gated_nn(name: str, x: str, y: str) -> str:
    gates = _TIGHT.replace("b.", "y.").replace("a.", "x.")
    ppm = _PPM.replace("b.", "y.").replace("a.", "x.")
    return f"{name} AS (SELECT i, j FROM (SELECT x.id AS i, y.id AS j, row_number() OVER (PARTITION BY x.id ORDER BY abs({ppm}), abs(y.rt-x.rt), y.mz, y.id) AS n FROM {x} x JOIN {y} y ON {band(7, 'x', 'y')} AND {gates}) q WHERE n=1)"


@register("tight_gates_mutual", f"WITH {_FULL}, {_gated_nn('go', 'fa', 'fb')}, {_gated_nn('back', 'fb', 'fa')} SELECT go.i AS id1, go.j AS id2 FROM go JOIN back ON go.i=back.j AND go.j=back.i")
def _(spark, d):
    return match.anchors(*full(spark, d), _gated("mnn")).select("id1", "id2")


def _weighted(anchors: bool) -> str:
    base = "tr" if anchors else "cr"
    t = lambda r, s: f"(lgamma(2e0)-lgamma(1.5e0)-0.5e0*ln(3e0*pi())-ln({s})-2e0*ln(1e0+({r}/{s})*({r}/{s})/3e0))"
    mad = lambda n, r: f"{n}m AS (SELECT quantile_cont({r},0.5) AS md FROM {base}), {n}s AS (SELECT greatest(1.4826e0*quantile_cont(abs({r}-md),0.5),1e-3) AS {n} FROM {base}, {n}m)"
    cols = f"a.id AS id1, b.id AS id2, a.mz AS mz1, a.rt AS rt1, {_PPM} AS dp, b.rt-a.rt AS dr, b.int-a.int AS di, a.int AS i1"
    return f"""{_FULL}, c AS (SELECT {cols} FROM {_JOIN}{band(20)}), t AS (SELECT {cols} FROM {_JOIN}{band(7)}),
ft AS (SELECT regr_slope(dp,mz1) AS ps, regr_intercept(dp,mz1) AS pi, regr_slope(dr,rt1) AS rs, regr_intercept(dr,rt1) AS ri, regr_slope(di,i1) AS qs, regr_intercept(di,i1) AS qi FROM t),
cr AS (SELECT id1, id2, dp-(pi+ps*mz1) AS p, dr-(ri+rs*rt1) AS r, di-(qi+qs*i1) AS q FROM c, ft), tr AS (SELECT dp-(pi+ps*mz1) AS p, dr-(ri+rs*rt1) AS r, di-(qi+qs*i1) AS q FROM t, ft),
{mad('sp', 'p')}, {mad('sr', 'r')}, {mad('sq', 'q')}, ll AS (SELECT id1, id2, {t('p', 'sp')}+0.5e0*{t('r', 'sr')}+0.25e0*{t('q', 'sq')} AS ll, sp, sr, sq FROM cr, sps, srs, sqs)"""


def _scored(spark: SparkSession, d: str, anchors: bool) -> tuple[DataFrame, dict]:
    cfg = MatchConfig(tight_anchor_strategy="all", rt_drift_model="linear", use_intensity=True, w_rt=0.5, w_roi=0.0, w_int=0.25, use_anchor_scales=anchors, tight_intensity_log_diff=0.0)
    a, b = full(spark, d)
    return match.score(match.differences(bandjoin.band_join(a, b, cfg.ppm)), match.anchors(a, b, cfg), cfg, (a, b))


@register("weighted_loglik", f"WITH {_weighted(False)} SELECT id1, id2, {m('ll')} AS ll FROM ll")
def _(spark, d):
    return _scored(spark, d, False)[0].select("id1", "id2", micro(F.col("loglik")).alias("ll"))


@register("anchor_scales", f"WITH {_weighted(True)} SELECT DISTINCT {m('sp')} AS ppm, {m('sr')} AS rt, {m('sq')} AS int FROM ll")
def _(spark, d):
    s = _scored(spark, d, True)[1]["scales"]
    return spark.createDataFrame([(s["ppm"], s["rt"], s["int"])], "ppm double, rt double, int double").select(*[micro(F.col(c)).alias(c) for c in ("ppm", "rt", "int")])


@register("finish_probability", f"WITH {TOPS} SELECT id1, id2, {m('CASE WHEN id2>=0 THEN prob ELSE p_null END')} AS prob_raw FROM tot WHERE p_null<0.4e0")
def _(spark, d):
    return decide.finish(tops(spark, d)[0], 0.4).select("id1", "id2", micro(F.col("prob_raw")).alias("prob_raw"))


@register("row_trust", f"WITH {LOCAL}, k AS (SELECT id1, id2, p, row_number() OVER (PARTITION BY id1 ORDER BY p DESC) AS k FROM lo), l AS (SELECT id1, max(CASE WHEN k=1 THEN p END)-coalesce(max(CASE WHEN k=2 THEN p END),0e0) AS lead FROM k GROUP BY id1) SELECT id1, {m('pow(1e0/(1e0+lead/0.2e0),1.5e0)')} AS trust FROM l")
def _(spark, d):
    return decide.ranked_top2(softmax_rows(spark, d, 1.0)).select("id1", micro(structure.trust(F.col("margin"), 0.2, 1.5)).alias("trust"))


_UP = f"SELECT id, mz+{PROTON!r}e0 AS mz FROM b"
_SHIFT = f"""{ctes()}, u AS ({_UP}), sh AS (SELECT * FROM (VALUES (0, 0e0, 0e0), (1, {PROTON!r}e0, 0e0), (2, 0e0, {PROTON!r}e0)) t(k, sa, sb)),
xa AS (SELECT k, id, mz+sa AS mz FROM a, sh), xb AS (SELECT k, id, mz+sb AS mz FROM u, sh),
f AS (SELECT k, id1, id2 FROM (SELECT xa.k, xa.id AS id1, xb.id AS id2, row_number() OVER (PARTITION BY xa.k, xa.id ORDER BY abs(xb.mz-xa.mz), xb.mz DESC, xb.id) AS n FROM xa JOIN xb ON xa.k=xb.k AND xb.mz BETWEEN xa.mz-xa.mz*5e0/1e6 AND xa.mz+xa.mz*5e0/1e6) q WHERE n=1),
g AS (SELECT k, id1, id2 FROM (SELECT xa.k, xa.id AS id1, xb.id AS id2, row_number() OVER (PARTITION BY xb.k, xb.id ORDER BY abs(xb.mz-xa.mz), xa.mz DESC, xa.id) AS n FROM xa JOIN xb ON xa.k=xb.k AND xa.mz BETWEEN xb.mz-xb.mz*5e0/1e6 AND xb.mz+xb.mz*5e0/1e6) q WHERE n=1),
c AS (SELECT sh.k, (SELECT count(*) FROM f JOIN g ON f.k=g.k AND f.id1=g.id1 AND f.id2=g.id2 WHERE f.k=sh.k) AS n FROM sh),
z AS (SELECT max(CASE WHEN k=0 THEN n END) AS zero, max(CASE WHEN k=1 THEN n END) AS one, max(n) AS best FROM c)"""


@register("global_mass_shift", f"WITH {_SHIFT} SELECT best, zero, best>=25 AND best>=zero+5 AND best>zero AS applied, CASE WHEN best>=25 AND best>=zero+5 AND one=best THEN {m(f'{PROTON!r}e0')} ELSE 0 END AS shift_a FROM z")
def _(spark, d):
    a, b = pair(spark, d)
    s = align.infer_shift(a, b.withColumn("mz", F.col("mz") + PROTON), MatchConfig(mz_global_shift_model="proton_only"))
    return spark.createDataFrame([(s.best, s.zero, s.applied, s.a)], "best long, zero long, applied boolean, a double").select("best", "zero", "applied", micro(F.col("a")).alias("shift_a"))


@register("adaptive_rt_gate", f"WITH {ctes()}, {nn_sql('fw', 'a', 'b', 7)}, q AS (SELECT count(*) AS n, quantile_cont(abs(b.rt-a.rt),0.95) AS p95 FROM fw JOIN a ON a.id=fw.id1 JOIN b ON b.id=fw.id2) SELECT {m('p95')} AS p95, p95>1e0 AS gate_off FROM q WHERE n>=25")
def _(spark, d):
    p95 = align.drift_p95(*pair(spark, d), 7.0, 25)
    return spark.createDataFrame([(p95,)], "p95 double").select(micro(F.col("p95")).alias("p95"), (F.col("p95") > 1.0).alias("gate_off"))


@register("intensity_zscore", f"WITH i AS (SELECT l_partkey AS id, log10(avg(l_quantity)+1e-9) AS x FROM lineitem GROUP BY 1), s AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM i) SELECT id, {m('least(greatest((x-mu)/sd,-8e0),8e0)')} AS z FROM i, s")
def _(spark, d):
    i = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(C.intensity_log10(F.avg("l_quantity")).alias("x"))
    return stats.zscore(i, "x").select("id", micro(F.col("x")).alias("z"))


def huber_sql(rounds: int) -> str:
    """Unrolled rounds of Huber's reweighting."""
    line = "SELECT regr_slope(ppm,mz1) AS s, regr_intercept(ppm,mz1) AS i FROM p"
    parts = [f"{ctes()}, {MNN}, {_PAIRS}, h0 AS ({line})"]
    for k in range(1, rounds + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT mz1 AS x, ppm AS y, ppm-(i+s*mz1) AS r FROM p, h{k - 1}), d{k} AS (SELECT quantile_cont(r,0.5) AS md FROM r{k}), e{k} AS (SELECT greatest(1.4826e0*quantile_cont(abs(r-md),0.5),1e-12) AS sc FROM r{k}, d{k}), w{k} AS MATERIALIZED (SELECT x, y, CASE WHEN abs(r)<=1.35e0*sc THEN 1e0 ELSE 1.35e0*sc/abs(r) END AS w FROM r{k}, e{k}), c{k} AS (SELECT sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my FROM w{k}), h{k} AS (SELECT sum(w*(x-mx)*(y-my))/sum(w*(x-mx)*(x-mx)) AS s, max(my)-sum(w*(x-mx)*(y-my))/sum(w*(x-mx)*(x-mx))*max(mx) AS i FROM w{k}, c{k})")
    return f"WITH {', '.join(parts)} SELECT {m('s*1e3')} AS slope_milli, {m('i')} AS intercept FROM h{rounds}"


@register("huber_three_rounds", huber_sql(3))
def _(spark, d):
    p = bandjoin.mutual(*pair(spark, d), 7.0).withColumn("ppm", C.ppm_over_mean(F.col("mz1"), F.col("mz2")))
    fit = drift.robust_linear(p, "mz1", "ppm", rounds=3, tol=0.0)
    return spark.createDataFrame([(fit.slope, fit.intercept)], "s double, i double").select(micro(F.col("s") * 1e3).alias("slope_milli"), micro(F.col("i")).alias("intercept"))


# --- clusters over studies -----------------------------------------------------------------------------------------------

#: A match that SQL can follow: mass alone, no drift, transport with one side relaxed.
PLAIN = MatchConfig(retention_mode="mz_only", mz_global_shift_model="none", ppm_drift_model="none", ot_mode="semi_relaxed", top1_policy="ot", use_anchor_scales=False)

_TOP = f"""st3 AS (SELECT * FROM st WHERE k<3),
e AS (SELECT x.k AS k1, y.k AS k2, x.id AS id1, y.id AS id2, y.mz AS mz2, (y.mz-x.mz)/((x.mz+y.mz)/2e0)*1e6 AS r FROM st3 x JOIN st3 y ON x.k<>y.k AND {band(20, 'x', 'y')}),
md AS (SELECT k1, k2, quantile_cont(r,0.5) AS md FROM e GROUP BY 1,2), sc AS (SELECT e.k1, e.k2, greatest(1.4826e0*quantile_cont(abs(r-md),0.5),1e-3) AS s FROM e JOIN md ON e.k1=md.k1 AND e.k2=md.k2 GROUP BY 1,2),
ll AS (SELECT e.*, lgamma(2e0)-lgamma(1.5e0)-0.5e0*ln(3e0*pi())-ln(s)-2e0*ln(1e0+(r/s)*(r/s)/3e0) AS ll FROM e JOIN sc ON e.k1=sc.k1 AND e.k2=sc.k2),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k1, k2, id1 ORDER BY ll DESC, mz2, id2) AS n FROM ll) q WHERE n<=20),
nl AS (SELECT k1, k2, quantile_cont(ll,0.2) AS nl FROM kept GROUP BY 1,2),
ex AS (SELECT kept.*, exp((ll-max(ll) OVER (PARTITION BY kept.k1, kept.k2, id1))/0.5e0) AS x, exp((nl-max(ll) OVER (PARTITION BY kept.k1, kept.k2, id1))/0.5e0) AS x0 FROM kept JOIN nl ON kept.k1=nl.k1 AND kept.k2=nl.k2),
pr AS (SELECT *, x/(sum(x) OVER (PARTITION BY k1, k2, id1)+x0) AS p, x0/(sum(x) OVER (PARTITION BY k1, k2, id1)+x0) AS p0 FROM ex),
top AS (SELECT k1, k2, id1, id2, p FROM (SELECT *, row_number() OVER (PARTITION BY k1, k2, id1 ORDER BY p DESC, mz2, id2) AS q FROM pr) z WHERE q=1 AND p0<p),
mu AS (SELECT f.k1, f.k2, f.id1, f.id2, f.p FROM top f JOIN top g ON f.k1=g.k2 AND f.k2=g.k1 AND f.id1=g.id2 AND f.id2=g.id1)"""


def stacked(spark: SparkSession, d: str) -> DataFrame:
    """Three studies as one table of features."""
    return studies(spark, d).where("k < 3").select(F.concat(F.lit("S"), "k").alias("study_id"), F.col("id").cast("string").alias("feature_id"), F.col("mz").alias("MZ"), F.col("rt").alias("RT"), F.lit(1.0).alias("Intensity"))


@register("hub_mutual_full", f"""WITH {ctes()}, {STUDIES}, {_TOP}, hit AS (SELECT * FROM mu WHERE k2=0),
cm AS (SELECT CAST(id AS VARCHAR) AS cluster_id, 'S0' AS study_id, CAST(id AS VARCHAR) AS feature_id FROM st3 WHERE k=0 UNION ALL SELECT CAST(id2 AS VARCHAR), 'S' || k1, CAST(id1 AS VARCHAR) FROM hit
UNION ALL SELECT 'S' || k || '__' || id, 'S' || k, CAST(id AS VARCHAR) FROM st3 WHERE k>0 AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.k1=st3.k AND hit.id1=st3.id)) SELECT * FROM cm""")
def _(spark, d):
    return cluster.hub_mutual(stacked(spark, d), PLAIN, "S0", full=True).cluster_map


@register("symmetric_clusters", f"""WITH RECURSIVE {ctes()}, {STUDIES}, {_TOP}, nd AS (SELECT k, id, mz, row_number() OVER (ORDER BY 'S' || k, CAST(id AS VARCHAR))-1 AS node FROM st3),
ed AS MATERIALIZED (SELECT x.node AS a, y.node AS b, p AS w FROM mu JOIN nd x ON x.k=k1 AND x.id=id1 JOIN nd y ON y.k=k2 AND y.id=id2 WHERE k1<k2),
u AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), r(node, lab) AS (SELECT a, a FROM u UNION SELECT u.b, r.lab FROM r JOIN u ON u.a=r.node WHERE r.lab<u.b),
co AS (SELECT nd.node, k, id, mz, coalesce(c.lab, nd.node) AS component FROM nd LEFT JOIN (SELECT node, min(lab) AS lab FROM r GROUP BY 1) c ON c.node=nd.node),
wt AS (SELECT node, sum(w) AS w FROM (SELECT a AS node, w FROM ed UNION ALL SELECT b, w FROM ed) z GROUP BY 1),
pk AS (SELECT * FROM (SELECT co.*, row_number() OVER (PARTITION BY component, k ORDER BY coalesce(w,0e0) DESC, co.node) AS n FROM co LEFT JOIN wt ON wt.node=co.node) z WHERE n=1)
SELECT 'C' || lpad(CAST(dense_rank() OVER (ORDER BY component) AS VARCHAR),5,'0') AS cluster_id, 'S' || k AS study_id, CAST(id AS VARCHAR) AS feature_id FROM pk""")
def _(spark, d):
    return cluster.symmetric(stacked(spark, d), PLAIN).cluster_map


@register("cluster_expression", f"WITH x AS ({X}) SELECT 'S' || sample_id%4 AS study_id, sample_id, feature_id%100 AS cluster_id, {m('v')} AS v FROM x WHERE feature_id%3<>sample_id%4")
def _(spark, d):
    x = expression(spark, d).withColumn("study_id", F.concat(F.lit("S"), F.col("sample_id") % 4))
    cmap = x.select("study_id", "feature_id", (F.col("sample_id") % 4).alias("k")).distinct().where("feature_id % 3 != k").select("study_id", "feature_id", (F.col("feature_id") % 100).alias("cluster_id"))
    return cluster.expression_of(cmap, x).select("study_id", "sample_id", "cluster_id", micro(F.col("v")).alias("v"))
