"""Frames of an operator's own: columns under names that cannot clash, and steps written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from specmatch.session import temporary

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def plain(docs: DataFrame, without: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ... and the new name of each old one (of columns that share a name, the first); columns named in
    ``without`` are left out. Whatever the caller's columns are called, an operator's own names are free then."""
    names = docs.columns
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))
    kept = [i for i, n in enumerate(names) if n not in without]
    return own.select(*(f"c{i}" for i in kept)), {names[i]: f"c{i}" for i in reversed(kept)}


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, and the shuffle files behind it are removed."""
    spark = df.sparkSession
    path = temporary(spark, "step")
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path, compression="uncompressed")  # mostly hashes; codecs would keep buffers outside the heap
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def drop(step: DataFrame) -> None:
    """Delete the files of a ``stored`` step that nothing reads any more."""
    context = step.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(step._step)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
