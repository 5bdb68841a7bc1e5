"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from tessera.llm import chat_format, decontaminate, language_id, near_dup, quality_classifier, quality_rules, sentencepiece_sampling, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_sentencepiece": sentencepiece_sampling.op1_sentencepiece,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_near_dup": near_dup.op7_near_dup,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_language_id": language_id.op10_language_id,
}

ORACLE = {
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op7_near_dup": near_dup.OP7_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
}
