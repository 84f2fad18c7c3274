"""Metadata of public analyses: nested JSON documents to one flat row each, as DataFrame expressions."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specmatch import shared_files
from specmatch.functions import columns as C
from specmatch.session import partitions

#: Labels that end the value of the label before them (fixed values).
LABELS = ("UNITS", "Has m/z", "Has RT", "RT units")


def labelled(text: Column, label: str) -> Column:
    """The value after ``label:`` up to the next label."""
    stop = "|".join(LABELS)
    return F.trim(F.regexp_extract(text, rf"(?i)(?:^|\s){label}\s*:\s*(.*?)(?=\s*(?:{stop})\s*:|$)", 1))


def _field(doc: Column, section: str | None, name: str) -> Column:
    """A string of a JSON document by section and key; the key in any case and punctuation."""
    inner = doc if section is None else F.get_json_object(doc, f"$['{section}']")
    plain = C.key_lookup(F.from_json(inner, "map<string,string>"), name)
    return F.coalesce(F.trim(plain), F.lit(""))


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


def metadata(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """One row of normalised fields for each document (optional ``analysis_id_hint`` beside it)."""
    d = F.col(json_col)
    wb, st, pr, su, co, ch, ms, md, an = "METABOLOMICS WORKBENCH", "STUDY", "PROJECT", "SUBJECT", "COLLECTION", "CHROMATOGRAPHY", "MS", "MS_METABOLITE_DATA", "ANALYSIS"
    hint = F.coalesce(F.col("analysis_id_hint"), F.lit("")) if "analysis_id_hint" in docs.columns else F.lit("")
    results = _field(d, ms, "MS_RESULTS_FILE")
    units, other = labelled(results, "UNITS"), _first(_field(d, md, "Units"), _field(d, None, "Units"))
    raw_units = F.when((units != "") & (other != "") & (units != other), F.concat_ws(" | ", units, other)).otherwise(_first(units, other))
    scale, hints = C.value_scale(F.concat_ws(" ", raw_units, _field(d, ms, "MS_COMMENTS")))
    mz, rt, rt_unit = labelled(results, "Has m/z"), labelled(results, "Has RT"), labelled(results, "RT units")
    size = lambda k: F.coalesce(F.json_array_length(F.get_json_object(d, f"$['{md}'].{k}")), F.lit(0))
    return docs.select(
        C.canonical_id(_first(_field(d, wb, "ANALYSIS_ID"), _field(d, None, "ANALYSIS_ID"), hint), "AN").alias("analysis_id"),
        _first(_field(d, wb, "STUDY_ID"), _field(d, st, "STUDY_ID")).alias("study_id"),
        _first(_field(d, wb, "PROJECT_ID"), _field(d, pr, "PROJECT_ID")).alias("project_id"),
        _field(d, st, "STUDY_TITLE").alias("study_title"),
        _first(_field(d, st, "INSTITUTE"), _field(d, pr, "INSTITUTE")).alias("institute"),
        _field(d, su, "SUBJECT_SPECIES").alias("subject_species"),
        _first(_field(d, co, "SAMPLE_TYPE"), _field(d, su, "SUBJECT_TYPE")).alias("sample_type"),
        _field(d, an, "ANALYSIS_TYPE").alias("analysis_type"),
        _field(d, ms, "ION_MODE").alias("ion_mode_raw"),
        C.ion_mode(_field(d, ms, "ION_MODE")).alias("ion_mode_norm"),
        _field(d, ch, "CHROMATOGRAPHY_TYPE").alias("chromatography_raw"),
        C.chromatography(_field(d, ch, "CHROMATOGRAPHY_TYPE")).alias("chromatography_norm"),
        _field(d, ms, "INSTRUMENT_NAME").alias("instrument_name"),
        _field(d, ms, "INSTRUMENT_TYPE").alias("instrument_type"),
        _field(d, ms, "MS_TYPE").alias("ms_type"),
        results.alias("ms_results_file"),
        units.alias("ms_results_units"),
        mz.alias("ms_results_has_mz_raw"),
        C.mz_semantics(mz).alias("ms_results_has_mz_semantics"),
        C.yes_no(rt).alias("ms_results_has_rt"),
        rt_unit.alias("ms_results_rt_units_raw"),
        C.rt_units(rt_unit).alias("ms_results_rt_units"),
        raw_units.alias("value_units_raw"),
        scale.alias("value_scale"),
        hints.alias("value_scale_hints"),
        size("Metabolites").alias("n_mwtab_metabolites"),
        size("Data").alias("n_mwtab_data_rows"),
    )


#: Output column and the keys it is read from, the first that is there (fixed values).
IDENTIFIERS = {"pubchem_id": ("pubchem_id",), "kegg_id": ("kegg_id",), "hmdb_id": ("hmdb_id",), "chebi_id": ("chebi_id",), "inchikey": ("inchikey",), "lipidmaps_id": ("lipidmaps_id",), "other_id": ("other_id",), "other_id_type": ("other_id_type",)}


def labelled_metabolites(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """(the documents' other columns, seq, source, metabolite_name, name, identifiers) of every named metabolite."""
    rows = F.from_json(F.get_json_object(F.col(json_col), "$['MS_METABOLITE_DATA'].Metabolites"), "array<map<string,string>>")
    one = docs.select(*[c for c in docs.columns if c != json_col], F.posexplode(rows).alias("seq", "m"))
    get = lambda *keys: _first(*[F.coalesce(F.trim(C.key_lookup(F.col("m"), k)), F.lit("")) for k in keys])
    named = one.withColumn("metabolite_name", get("Metabolite", "metabolite_name", "compound_name", "name")).where("metabolite_name != ''")
    return named.select(*[c for c in named.columns if c not in ("m", "metabolite_name")], F.lit("mwtab_ms_metabolite_data").alias("source"), "metabolite_name", C.metabolite_name(F.col("metabolite_name")).alias("name"), *[get(*v).alias(k) for k, v in IDENTIFIERS.items()])


_RECORD = "map<string, struct<study_id: string, analysis_id: string, metabolite_id: string, metabolite_name: string, refmet_name: string, units: string, analysis_summary: string, DATA: map<string, string>>>"


def study_data(docs: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """(named metabolites, long matrix) of study-data documents, an object of records each. A record without a name is left out; of
    records with one ``matrix_col`` in a document the last one's values stand; blank and unreadable values are unknown.
    The first has (the documents' other columns, source, seq, study_id, analysis_id, metabolite_id, metabolite_name, refmet_name, name, units,
    analysis_summary, matrix_col); the second (the other columns, sample_id, feature_id, v)."""
    rest = [c for c in docs.columns if c != json_col]
    each = docs.withColumn("_doc", F.xxhash64(json_col)).select(*rest, "_doc", F.posexplode(F.from_json(F.col(json_col), _RECORD)).alias("seq", "_key", "m"))
    text = lambda c: F.coalesce(F.trim(F.col(f"m.{c}")), F.lit(""))
    flat = each.select(*rest, "_doc", F.lit("workbench_study_data").alias("source"), "seq", text("study_id").alias("study_id"), C.canonical_id(text("analysis_id"), "AN").alias("analysis_id"), *(text(c).alias(c) for c in ("metabolite_id", "metabolite_name", "refmet_name", "units", "analysis_summary")), F.col("m.DATA").alias("_data"))
    named = flat.withColumn("name", C.metabolite_name(_first(F.col("refmet_name"), F.col("metabolite_name")))).where("name != ''")
    named = named.withColumn("matrix_col", F.when(F.col("metabolite_id") != "", F.col("metabolite_id")).otherwise(F.concat(F.lit("NAME:"), "name")))
    last = named.withColumn("_n", F.row_number().over(Window.partitionBy(*rest, "_doc", "matrix_col").orderBy(F.desc("seq")))).where("_n = 1")
    values = last.select(*rest, F.col("matrix_col").alias("feature_id"), F.explode("_data").alias("sample_id", "_v")).where("sample_id != ''")
    return named.drop("_doc", "_data"), values.select(*rest, "sample_id", "feature_id", C.known(F.trim("_v")).alias("v"))


def write_cache(docs: DataFrame, folder: str) -> None:
    """Documents (id, value) as files ``id``.json of a folder that all tasks share, written where they are: a file comes whole or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        n = 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                temporary = f"{at}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(temporary) as f:
                    f.write(value.encode())
                system.move(temporary, f"{at}/{name}.json")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    path = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)
    docs.select("id", "value").mapInArrow(run, "n long").agg(F.sum("n")).collect()


#: Stores that tasks read without Spark's readers.
_STORES = ("file:", "hdfs:", "s3:", "gs:")


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cached documents of a folder, one to a file: (path, analysis_id_hint, json). Without a network the cache is the source.

    One task lists names and all tasks read files, so the driver holds neither; in stores that only Spark's readers open it lists them itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not whole.startswith(_STORES):
        files = spark.read.text(f"{folder}/*.json", wholetext=True).withColumn("path", F.col("_metadata.file_path"))
        files = files.coalesce(partitions(spark))  # small files fill Spark's splits by a few, and each split would be a task
        return files.select("path", F.regexp_extract("path", r"(AN\d+)[^/]*$", 1).alias("analysis_id_hint"), F.col("value").alias("json"))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(folder)
    there = shared_files.local(whole)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            own: list[str] = []
            for name in _listed(whole):
                if name.endswith(".json") and name[0] not in "._":
                    own.append(name)
                if len(own) == 10_000:
                    yield pa.RecordBatch.from_pydict({"name": own})
                    own = []
            if own:
                yield pa.RecordBatch.from_pydict({"name": own})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = (None, there) if there is not None else fs.FileSystem.from_uri(whole)
        for batch in batches:
            paths, values, size = [], [], 0
            for name in batch.column(0).to_pylist():
                with open(f"{at}/{name}", "rb") if system is None else system.open_input_stream(f"{at}/{name}") as f:
                    value = f.read().decode("utf-8", "replace")
                paths.append(f"file://{there}/{name}" if system is None else f"{whole}/{name}")
                values.append(value)
                size += len(value)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pydict({"path": paths, "json": values})
                    paths, values, size = [], [], 0
            if paths:
                yield pa.RecordBatch.from_pydict({"path": paths, "json": values})

    listed = spark.range(0, 1, 1, 1).select("id").mapInArrow(names, "name string").repartition(partitions(spark), "name")
    return listed.mapInArrow(texts, "path string, json string").select("path", F.regexp_extract("path", r"(AN\d+)[^/]*$", 1).alias("analysis_id_hint"), "json")


def _listed(folder: str) -> Iterator[str]:
    """Names of the files of a folder."""
    there = shared_files.local(folder)
    if there is not None:
        with os.scandir(there) as found:
            yield from (x.name for x in found if x.is_file())
        return
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(folder)
    yield from (x.base_name for x in system.get_file_info(fs.FileSelector(at)) if x.is_file)
