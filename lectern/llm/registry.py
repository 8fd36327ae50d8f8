"""Queries of this subpackage by name, and the SQL that says what they return."""

from __future__ import annotations

from lectern.llm import fim, hard_negatives, licences, mixing, partenum, queries_text, radix_dedup

QUERIES = {
    "op1_bpe": queries_text.op1_bpe,
    "op2_licence_scan": queries_text.op2_licence_scan,
    "op3_warc": queries_text.op3_warc,
    "op4_gif": queries_text.op4_gif,
    "op5_mix": queries_text.op5_mix,
    "op6_toxicity": queries_text.op6_toxicity,
    "op7_sharding": queries_text.op7_sharding,
    "op8_exact_dedup": queries_text.op8_exact_dedup,
    "op9_language_id": queries_text.op9_language_id,
    "op10_simhash": queries_text.op10_simhash,
    "op11_hard_negatives": queries_text.op11_hard_negatives,
    "op12_fim": queries_text.op12_fim,
    "op13_partenum": queries_text.op13_partenum,
}
ORACLES = {
    "op2_licence_scan": licences.oracle_scan(),
    "op5_mix": mixing.ORACLE_MIX,
    "op8_exact_dedup": radix_dedup.ORACLE_GROUPS,
    "op11_hard_negatives": hard_negatives.ORACLE_HARD,
    "op12_fim": fim.ORACLE_FIM,
    "op13_partenum": partenum.ORACLE_SIMILAR,
}
