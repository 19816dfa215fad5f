"""Registered queries of this subpackage and their DuckDB SQL where there is one."""

from __future__ import annotations

from adlytics.llm import (
    op1_suffix_dedup, op2_fingerprint, op3_quality, op4_jaccard_join, op5_byte_bpe, op6_mixing, op7_exact_search, op8_url_filter, op9_personal_data,
    op10_language_id, op11_vector_codes, op12_merkle_manifest, op13_token_files,
)

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup.op1_suffix_dedup,
    "op2_fingerprint": op2_fingerprint.op2_fingerprint,
    "op3_quality": op3_quality.op3_quality,
    "op4_jaccard_join": op4_jaccard_join.op4_jaccard_join,
    "op5_byte_bpe": op5_byte_bpe.op5_byte_bpe,
    "op6_mix_sources": op6_mixing.op6_mix_sources,
    "op7_exact_search": op7_exact_search.op7_exact_search,
    "op8_url_filter": op8_url_filter.op8_url_filter,
    "op9_personal_data": op9_personal_data.op9_personal_data,
    "op10_language_id": op10_language_id.op10_language_id,
    "op11_vector_codes": op11_vector_codes.op11_vector_codes,
    "op12_merkle_manifest": op12_merkle_manifest.op12_merkle_manifest,
    "op13_token_files": op13_token_files.op13_token_files,
}
ORACLE = {
    "op6_mix_sources": op6_mixing.ORACLE,
    "op7_exact_search": op7_exact_search.ORACLE,
    "op8_url_filter": op8_url_filter.ORACLE,
    "op11_vector_codes": op11_vector_codes.ORACLE,
    "op12_merkle_manifest": op12_merkle_manifest.ORACLE,
}
