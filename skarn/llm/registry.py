"""Queries of the training-text operators, and SQL twins where SQL can express them on whole tables."""

from __future__ import annotations

from skarn.llm import chat, exact, neardup, packing, pieces, quality, ranker, substring, urlfilter, warc

QUERIES = {
    "op1_exact_dedup": exact.op1_exact_dedup,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_minhash_near_dedup": neardup.op3_minhash_near_dedup,
    "op4_warc": warc.op4_warc,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_packing": packing.op7_packing,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_url_filters": urlfilter.op9_url_filters,
    "op10_quality_classifier": ranker.op10_quality_classifier,
}
ORACLE = {
    "op1_exact_dedup": exact.OP1_SQL,
    "op2_chat_formatting": chat.OP2_SQL,
    "op3_minhash_near_dedup": neardup.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op8_substring_dedup": substring.OP8_SQL,
    "op9_url_filters": urlfilter.OP9_SQL,
}
