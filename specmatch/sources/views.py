"""Feature studies over the driver tables: one SQL text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

A = """SELECT p_partkey AS id, 80e0+((p_partkey*7919)%100003)*900e0/100003e0 AS mz, 0.5e0+((p_partkey*104729)%20011)*24e0/20011e0 AS rt FROM part"""
A_DENSE = """SELECT p_partkey AS id, 200e0+((p_partkey*7919)%100003)*8e0/100003e0 AS mz, 0.5e0+((p_partkey*104729)%20011)*24e0/20011e0 AS rt FROM part"""
B = """SELECT id, mz*(1e0+(5e0+(((id*31)%201)-100)/1e2)*1e-6) AS mz, 2e0*rt+1e0+(((id*17)%101)-50)/1e3 AS rt FROM a WHERE id%7<>0"""
X = """SELECT l_suppkey AS sample_id, l_partkey AS feature_id, sum(l_quantity) AS v FROM lineitem GROUP BY l_suppkey, l_partkey"""


def ctes(dense: bool = False) -> str:
    """``a AS (...), b AS (...)`` for an oracle's WITH."""
    return f"a AS ({A_DENSE if dense else A}), b AS ({B})"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def pair(spark: SparkSession, sf_dir: str, dense: bool = False) -> tuple[DataFrame, DataFrame]:
    """Study a and its drifted copy b: (id, mz, rt)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    a = spark.sql((A_DENSE if dense else A).replace("FROM part", "FROM {part}"), part=part)
    return a, spark.sql(B.replace("FROM a", "FROM {a}"), a=a)


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, feature_id, v): quantities of parts by supplier."""
    return spark.sql(X.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
