"""Feature tables, matrices and manifests as DataFrames. Matrices leave as long tables; no Spark column per feature."""

from __future__ import annotations

import gzip
import json
import re
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmatch.functions.columns import known

_NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


@dataclass(frozen=True)
class StudySpec:
    analysis_id: str
    feature_format: str
    matrix_path: str
    features_path: str | None = None
    endpoints_path: str | None = None
    polarity: str = "positive"
    chromatography: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of features with a header."""
    return spark.read.csv(path, header=True, inferSchema=True)


def load_manifest(path: str) -> list[StudySpec]:
    """Studies of a YAML or JSON manifest: a list, or a mapping with ``studies``. Paths are relative to the manifest."""
    p = Path(path)
    if p.suffix.lower() in (".yaml", ".yml"):
        import yaml

        data = yaml.safe_load(p.read_text())
    elif p.suffix.lower() == ".json":
        data = json.loads(p.read_text())
    else:
        raise ValueError(f"a manifest is .yaml, .yml or .json, not {p.suffix!r}")
    rows = data.get("studies") if isinstance(data, dict) else data
    if not isinstance(rows, list):
        raise ValueError("a manifest is a list of studies, or has one under 'studies'")
    out = []
    for r in rows:
        name = str(r.get("analysis_id") or r.get("study_id") or "").strip()
        for key, value in (("analysis_id", name), ("feature_format", r.get("feature_format")), ("matrix_path", r.get("matrix_path"))):
            if not str(value or "").strip():
                raise ValueError(f"a study of the manifest lacks {key}")
        place = lambda k: str(p.parent / r[k]) if r.get(k) else None
        rest = {k: v for k, v in r.items() if k not in StudySpec.__dataclass_fields__ and k != "study_id"} | dict(r.get("metadata") or {})
        out.append(StudySpec(name, str(r["feature_format"]), place("matrix_path"), place("features_path"), place("endpoints_path"), str(r.get("polarity") or "positive").lower(), r.get("chromatography"), rest))
    return out


def analysis_ids(ids: list[str] = (), file: str | None = None) -> list[str]:
    """``AN000123`` ids of arguments and a text (``#`` comments) or JSON file, each once, in order."""
    found = list(ids)
    if file:
        text = Path(file).read_text()
        try:
            data = json.loads(text)
            found += [str(x) for x in (data.get("analysis_ids", []) if isinstance(data, dict) else data)]
        except (ValueError, TypeError):
            found += [line.split("#")[0].strip() for line in text.splitlines()]
    out = []
    for x in found:
        m = re.fullmatch(r"(?:AN)?0*(\d+)", str(x).strip().upper())
        out.append(f"AN{int(m[1]):06d}" if m else str(x).strip().upper())
    return [x for x in dict.fromkeys(out) if x]


def feature_count(header: str, least_mz: float = 40.0) -> int:
    """How many names of a header line look like two numbers of which one may be a mass."""
    n = 0
    for token in header.strip().split("\t" if "\t" in header else ","):
        if re.fullmatch(rf"\s*{_NUMBER}[_/@]{_NUMBER}\s*", token):
            a, b = (float(x) for x in re.findall(_NUMBER, token.replace("/", "_"))[:2])
            n += a > 0 and max(a, b) >= least_mz
    return n


def _long(wide: DataFrame, id_col: str, features: list[str], na_as_zero: bool) -> DataFrame:
    value = known(F.col("v"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature_id"), F.col(f"`{f}`").cast("string").alias("v")) for f in features]))
    out = wide.select(F.col(f"`{id_col}`").cast("string").alias("sample_id"), pairs.alias("_x")).select("sample_id", "_x.*")
    return out.withColumn("v", F.coalesce(value, F.lit(0.0)) if na_as_zero else value)


def with_intensity(features: DataFrame, expr: DataFrame) -> DataFrame:
    return features.join(expr.groupBy("feature_id").agg(F.avg("v").alias("Intensity")), "feature_id", "left")


def read_matrix(spark: SparkSession, path: str, na_as_zero: bool = True) -> tuple[DataFrame, DataFrame]:
    """(features, long expression) of a tab-separated matrix with a ``Samples`` column: coordinates are in rows ``m/z``
    and ``rt``, or in the feature names."""
    wide = spark.read.csv(path, sep="\t", header=True)
    if "Samples" not in wide.columns:
        raise ValueError(f"{path} has no 'Samples' column")
    names = [c for c in wide.columns if c not in ("Samples", "group")]
    if not names:
        raise ValueError(f"{path} has no feature columns")
    special = {r["Samples"]: r for r in wide.where(F.col("Samples").isin("m/z", "rt")).collect()}  # two rows
    if len(special) == 2:
        number = lambda x: float(x) if re.fullmatch(rf"\s*{_NUMBER}\s*", x or "") else None
        coords = [(n, number(special["m/z"][n]), number(special["rt"][n])) for n in names]
        wide = wide.where(~F.col("Samples").isin("m/z", "rt"))
    else:
        parsed = []
        for n in names:
            first, _, rest = n.partition("_")
            m = re.match(r"\s*" + _NUMBER, rest)
            try:
                parsed.append((n, float(first), float(m[0])))
            except (ValueError, TypeError):
                continue
        if not parsed:
            raise ValueError(f"{path} has no feature names that hold two numbers")
        coords = _axes(parsed, path)
        names = [n for n, _, _ in coords]
    expr = _long(wide, "Samples", names, na_as_zero)
    return with_intensity(spark.createDataFrame(coords, "feature_id string, MZ double, RT double"), expr), expr


def _axes(parsed: list[tuple[str, float, float]], path: str) -> list[tuple[str, float, float]]:
    """Which of two numbers is the mass: by how many lie in its usual range and how far the medians are apart."""
    import numpy as np

    x, y = np.array([p[1] for p in parsed]), np.array([p[2] for p in parsed])

    def score(mz, rt) -> float:
        return float(np.mean((mz >= 50) & (mz <= 5000)) + np.mean((rt >= 0) & (rt <= 60)) + (np.median(mz) - np.median(rt)) / 1000)

    one, two = score(x, y), score(y, x)
    if abs(one - two) < 1e-6:
        raise ValueError(f"{path}: cannot tell masses from retention times in the feature names")
    return parsed if one > two else [(n, b, a) for n, a, b in parsed]


def _sniffed(spark: SparkSession, path: str) -> DataFrame:
    head = spark.read.text(path).first()
    line = head[0] if head else ""
    return spark.read.csv(path, header=True, sep=max(("\t", ",", ";"), key=line.count))


def read_tables(spark: SparkSession, matrix: str, features: str, na_as_zero: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same of a matrix (first column: sample) and a table ``feature_id, mz, rt`` in files of their own."""
    wide = _sniffed(spark, matrix)
    if len(wide.columns) < 2:
        raise ValueError(f"{matrix} needs a sample column and feature columns")
    table = _sniffed(spark, features)
    named = {c.strip().lower(): c for c in table.columns}
    if not {"feature_id", "mz", "rt"} <= set(named):
        raise ValueError(f"{features} needs the columns feature_id, mz and rt")
    f = table.select(F.col(f"`{named['feature_id']}`").cast("string").alias("feature_id"), known(F.col(f"`{named['mz']}`")).alias("MZ"), known(F.col(f"`{named['rt']}`")).alias("RT"))
    expr = _long(wide, wide.columns[0], wide.columns[1:], na_as_zero)
    return with_intensity(f, expr), expr.join(f.select("feature_id"), "feature_id", "left_semi")


def load_study(spark: SparkSession, spec: StudySpec, na_as_zero: bool = True) -> tuple[DataFrame, DataFrame]:
    """(features, long expression) of a study, with its ``study_id``."""
    if spec.feature_format in ("mw_special_rows", "id_encodes_mz_rt"):
        f, x = read_matrix(spark, spec.matrix_path, na_as_zero)
    elif spec.feature_format == "separate_tables":
        if not spec.features_path:
            raise ValueError(f"{spec.analysis_id}: separate_tables needs features_path")
        f, x = read_tables(spark, spec.matrix_path, spec.features_path, na_as_zero)
    else:
        raise ValueError(f"{spec.analysis_id}: unknown feature_format {spec.feature_format!r}")
    name = F.lit(spec.analysis_id).alias("study_id")
    return f.select(name, "feature_id", "MZ", "RT", "Intensity"), x.select(name, "sample_id", "feature_id", "v")


def _joined(spark: SparkSession, parts: str, path: str, head: bytes) -> None:
    """One file of a head and the parts of a folder, in order; the folder goes. Bytes stream through the driver a block at a time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, place = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    fs.delete(place, True)
    fs.setWriteChecksum(False)  # no companion file beside the user's
    try:
        out = fs.create(place, True)
        try:
            out.write(bytearray(head))
            for part in sorted(s.getPath().getName() for s in fs.listStatus(folder)):
                if part.startswith("part-"):
                    source = fs.open(jvm.org.apache.hadoop.fs.Path(folder, part))
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                    finally:
                        source.close()
        finally:
            out.close()
    finally:
        fs.setWriteChecksum(True)
    fs.delete(folder, True)


def write_wide(expr: DataFrame, path: str, clusters: list[str]) -> None:
    """A sample by cluster matrix as one gzipped TSV file, samples in order. A line is made of the values a sample has and the
    tabs between their places, so there is neither a Spark column nor a cell in memory for a value that is not there."""
    spark = expr.sparkSession
    place = spark.createDataFrame(list(enumerate(clusters)), "pos int, cluster_id string")
    one = expr.join(place, "cluster_id").groupBy("sample_id", "pos").agg(F.first("v", ignorenulls=True).cast("string").alias("v")).where("v IS NOT NULL")
    cells = one.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("x"))
    text = F.array_join(F.transform("x", lambda c, i: F.concat(F.repeat(F.lit("\t"), c["pos"] - F.coalesce(F.get(F.col("x"), i - 1)["pos"], F.lit(-1))), c["v"])), "")
    rest = F.repeat(F.lit("\t"), F.lit(len(clusters) - 1) - F.coalesce(F.element_at("x", -1)["pos"], F.lit(-1)))
    samples = expr.select("sample_id").distinct().join(cells, "sample_id", "left")
    lines = samples.orderBy("sample_id").select(F.concat(F.col("sample_id").cast("string"), F.coalesce(text, F.lit("")), F.coalesce(rest, F.lit("\t" * len(clusters)))).alias("value"))
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines.write.text(parts, compression="gzip")
    _joined(spark, parts, path, gzip.compress(("\t".join(["sample_id", *clusters]) + "\n").encode(), mtime=0))


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """One plain file with a header: tasks write parts, which are joined in order."""
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    df.write.csv(parts, sep=sep)
    quoted = ['"' + c.replace('"', '""') + '"' if sep in c or '"' in c else c for c in df.columns]
    _joined(df.sparkSession, parts, path, (sep.join(quoted) + "\n").encode())
