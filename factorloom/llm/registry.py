"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import bpe, hard_negatives, license_scan, media, packing, quality, sharding, similarity, spelling, substring, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_roundtrip": bpe.op1_bpe_roundtrip,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_media_containers": media.op3_media_containers,
        "op4_lexical_packing": packing.op4_lexical_packing,
        "op5_warc_seekable_bundles": warc.op5_warc_seekable_bundles,
        "op6_stratified_sharding": sharding.op6_stratified_sharding,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_substring_dedup": substring.op8_substring_dedup,
        "op9_ngram_jaccard_join": similarity.op9_ngram_jaccard_join,
        "op10_url_filters": url_filter.op10_url_filters,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_license_scan": license_scan.op12_license_scan,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc_seekable_bundles": warc.ORACLE,
        "op10_url_filters": url_filter.ORACLE,
        "op11_hard_negatives": hard_negatives.ORACLE,
        "op12_license_scan": license_scan.ORACLE,
    }
