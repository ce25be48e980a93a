"""Queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from foliant.llm import decontaminate, hilbert, line_dedup, near_dedup, nearest, pieces, substring_dedup, surrogates, toxicity, url_filter

QUERIES = {
    "op1_toxicity_chain": toxicity.query,
    "op2_benchmark_decontamination": decontaminate.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_url_filters": url_filter.query,
    "op5_line_dedup": line_dedup.query,
    "op6_pii_surrogates": surrogates.query,
    "op7_hilbert_sharding": hilbert.query,
    "op8_sentencepiece": pieces.query,
    "op9_nearest_neighbours": nearest.query,
    "op10_minhash_near_dedup": near_dedup.query,
}

ORACLES = {
    "op2_benchmark_decontamination": decontaminate.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_url_filters": url_filter.ORACLE,
    "op9_nearest_neighbours": nearest.ORACLE,
    "op10_minhash_near_dedup": near_dedup.ORACLE,
}
