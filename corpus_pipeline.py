"""The corpus pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specmatch.llm import mixing, near_dedup, quality_classifier, sentencepiece_codec, suffix_dedup
from specmatch.session import temporary

STAGES = [
    ("quality_classifier", quality_classifier.stage),
    ("minhash_near_dedup", near_dedup.stage),
    ("suffix_array_dedup", suffix_dedup.stage),
    ("source_mixing", mixing.stage),
    ("sentencepiece", sentencepiece_codec.stage),
]
#: The stages train a classifier, confirm similarity on hashed sets and run a tokenizer: not SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = temporary(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
