"""The document cache: one file a document, read in few tasks."""

from __future__ import annotations

from specmatch.session import temporary
from specmatch.sources import metadata


def test_cache_is_read_in_few_tasks(spark):
    at = temporary(spark, "cache") + "/cache"
    docs = spark.createDataFrame([(f"AN{i:06d}", f'{{"n": {i}, "x": "é"}}') for i in range(300)], "id string, value string")
    metadata.write_cache(docs, at)
    metadata.write_cache(docs.limit(5), at)  # again: replaced, not doubled
    got = metadata.read_cache(spark, at)
    assert {(r.analysis_id_hint, r.json) for r in got.collect()} == {tuple(r) for r in docs.collect()}
    assert got.rdd.getNumPartitions() <= 8  # 300 small files were some 10 splits and more
