"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import (
    chat_repair,
    decontamination,
    html_extraction,
    lm_scoring,
    merkle,
    mixing,
    near_duplicates,
    quality_rules,
    quotations,
    sharding,
    token_files,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_toxicity": toxicity.query,
    "op3_quality_rules": quality_rules.query,
    "op4_mixing": mixing.query,
    "op5_url_filter": url_filter.query,
    "op6_html_extraction": html_extraction.query,
    "op7_sharding": sharding.query,
    "op8_decontamination": decontamination.query,
    "op9_quotation_linking": quotations.query,
    "op10_near_duplicates": near_duplicates.query,
    "op11_token_files": token_files.query,
    "op12_chat_repair": chat_repair.query,
    "op13_merkle_manifest": merkle.query,
}

ORACLE_SQL = {
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op9_quotation_linking": quotations.ORACLE_SQL,
    "op12_chat_repair": chat_repair.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
