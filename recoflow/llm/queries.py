"""Queries of the operators (opN_<name>) and their SQL, for the driver contract."""

from __future__ import annotations

from recoflow.llm import (
    conversation_repair,
    decontam,
    histogram_shards,
    line_dedup,
    lm_mixing,
    ngram_join,
    packing,
    pii,
    quality_fm,
    quality_rules,
    substring_dedup,
    token_align,
    token_arrow,
)

QUERIES = {
    "op1_lm_mixing": lm_mixing.op1,
    "op2_decontamination": decontam.op2,
    "op3_token_arrow": token_arrow.op3,
    "op4_pii_semi_crf": pii.op4,
    "op5_quality_fm": quality_fm.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_ngram_join": ngram_join.op7,
    "op8_packing": packing.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_token_align": token_align.op11,
    "op12_histogram_shards": histogram_shards.op12,
    "op13_conversation_repair": conversation_repair.op13,
}
ORACLES = {
    "op7_ngram_join": ngram_join.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
}
