"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from turnlake.llm import additive_ann, flac, language_id, line_dedup, mixing, near_dedup, packing, pii, runs, secret_scan, sharding, toxicity, vector_codes

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_packing": packing.query,
    "op3_line_dedup": line_dedup.query,
    "op4_pii": pii.query,
    "op5_language_id": language_id.query,
    "op6_mixing": mixing.query,
    "op7_flac": flac.query,
    "op8_additive_ann": additive_ann.query,
    "op9_toxicity": toxicity.query,
    "op10_secret_scan": secret_scan.query,
    "op11_run_detection": runs.query,
    "op12_vector_codes": vector_codes.query,
    "op13_histogram_sort": sharding.query,
}
ORACLE_SQL = {
    "op1_near_dedup": near_dedup.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
}
