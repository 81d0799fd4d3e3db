"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from geotally.llm import op1_bpe, op2_exact_dedup, op3_quality_classifier, op4_packing, op5_quality_rules, op6_html_extraction, op7_secret_scans, op8_minhash, op9_token_counts, op10_substrings, op11_whitening, op12_language, op13_search

QUERIES = {
    "op1_byte_bpe": op1_bpe.query,
    "op2_exact_dedup": op2_exact_dedup.query,
    "op3_quality_classifier": op3_quality_classifier.query,
    "op4_packing": op4_packing.query,
    "op5_quality_rules": op5_quality_rules.query,
    "op6_html_extraction": op6_html_extraction.query,
    "op7_secret_scans": op7_secret_scans.query,
    "op8_minhash_near_dedup": op8_minhash.query,
    "op9_token_counts": op9_token_counts.query,
    "op10_substring_dedup": op10_substrings.query,
    "op11_whitening": op11_whitening.query,
    "op12_language_id": op12_language.query,
    "op13_lexical_search": op13_search.query,
}
SQL = {"op2_exact_dedup": op2_exact_dedup.SQL, "op13_lexical_search": op13_search.SQL}
