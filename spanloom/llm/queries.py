"""Queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from spanloom.llm import decontaminate, exact_dedup, html_text, language_id, secrets, sentencepieces, sharding, simhash, toxicity, url_filter

QUERIES = {
    "op1_sentencepiece": sentencepieces.op1_sentencepiece,
    "op2_sharding": sharding.op2_sharding,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_language_id": language_id.op4_language_id,
    "op5_secrets": secrets.op5_secrets,
    "op6_html_text": html_text.op6_html_text,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_simhash": simhash.op8_simhash,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
}
ORACLES = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op6_html_text": html_text.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
