"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from specmatch.llm import fingerprint, license_scan, lm_scoring, mixing, near_dedup, quality_classifier, quality_rules, sentencepiece_codec, sharding, suffix_dedup

QUERIES = {
    "op1_edit_fingerprint": fingerprint.query,
    "op2_license_scan": license_scan.query,
    "op3_sentencepiece": sentencepiece_codec.query,
    "op4_tiered_sharding": sharding.query,
    "op5_source_mixing": mixing.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_kneser_ney": lm_scoring.query,
    "op8_minhash": near_dedup.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_quality_rules": quality_rules.query,
    "op1_near_pairs": fingerprint.near_query,
}
#: The others fit models, walk, run tokenizers or write files; tests hold them to brute force.
ORACLES = {"op5_source_mixing": mixing.ORACLE, "op6_suffix_dedup": suffix_dedup.ORACLE, "op8_minhash": near_dedup.ORACLE, "op10_quality_rules": quality_rules.ORACLE}
