"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from termloom.llm import (
    byte_cnn,
    filter_audit,
    mixing,
    ngram_join,
    packing,
    page_text,
    quality_rules,
    quotations,
    rotated_codes,
    suffix_dedup,
    token_alignment,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op2_page_text": page_text.op2_page_text,
    "op3_quotations": quotations.op3_quotations,
    "quoted_round_trip": quotations.quoted_round_trip,
    "op5_byte_cnn": byte_cnn.op5_byte_cnn,
    "op6_rotated_codes": rotated_codes.op6_rotated_codes,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_packing": packing.op8_packing,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_toxicity": toxicity.op13_toxicity,
}

SQL: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op6_rotated_codes": rotated_codes.OP6_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
