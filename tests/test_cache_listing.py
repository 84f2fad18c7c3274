"""The document cache at size: the driver does not list its files."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrameReader

from specmatch.session import temporary
from specmatch.sources import metadata


def test_driver_does_not_list_the_cache(spark, monkeypatch):
    at = temporary(spark, "cache") + "/cache"
    docs = [(f"AN{i:06d}", f'{{"n": {i}, "x": "é"}}\nend') for i in range(50)]
    metadata.write_cache(spark.createDataFrame(docs, "id string, value string"), at)
    metadata.write_cache(spark.createDataFrame([("_AN1", "hidden"), ("b c%20d", "no id")], "id string, value string"), at)
    spark_reads = {(r.analysis_id_hint, r.json) for r in _by_spark(spark, at)}

    def refuse(*_, **__):
        raise AssertionError("listed by the driver")

    with monkeypatch.context() as p:
        p.setattr(DataFrameReader, "text", refuse)
        got = metadata.read_cache(spark, at).collect()
    assert {(r.analysis_id_hint, r.json) for r in got} == spark_reads == {*docs, ("", "no id")} and len(got) == 51
    with pytest.raises(FileNotFoundError):
        metadata.read_cache(spark, at + "-none")


def _by_spark(spark, at):
    with pytest.MonkeyPatch.context() as p:
        p.setattr(metadata, "_STORES", ())
        return metadata.read_cache(spark, at).collect()
