"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _gone_at_exit(spark: SparkSession, folder: str) -> None:
    """Make a folder that goes when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A temporary one only where none is configured and driver and executors are one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="specmatch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
        _gone_at_exit(spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return folder


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that are not needed after the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/specmatch-{spark.sparkContext.applicationId}"
    _gone_at_exit(spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage. The shuffle files behind it are removed at once, not when the
    driver happens to collect its garbage."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def partitions(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * factor)
