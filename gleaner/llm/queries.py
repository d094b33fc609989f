"""Queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import op1_warc, op2_toxicity, op3_chat, op4_bpe, op5_jaccard, op6_secrets, op7_decontaminate, op8_language, op9_quality, op10_html, op11_align, op12_caps, op13_audit


def queries() -> dict:
    return {
        "op1_warc_round_trip": op1_warc.op1_warc_round_trip,
        "op2_toxic_segments": op2_toxicity.op2_toxic_segments,
        "op3_chat_formatting": op3_chat.op3_chat_formatting,
        "op4_bpe_round_trip": op4_bpe.op4_bpe_round_trip,
        "op5_jaccard_join": op5_jaccard.op5_jaccard_join,
        "op6_secret_scan": op6_secrets.op6_secret_scan,
        "op7_decontamination": op7_decontaminate.op7_decontamination,
        "op8_language_id": op8_language.op8_language_id,
        "op9_quality_rules": op9_quality.op9_quality_rules,
        "op10_html_extraction": op10_html.op10_html_extraction,
        "op11_token_alignment": op11_align.op11_token_alignment,
        "op12_embedding_near_dedup": op12_caps.op12_embedding_near_dedup,
        "op13_filter_audit": op13_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_round_trip": op1_warc.ORACLE, "op3_chat_formatting": op3_chat.ORACLE, "op9_quality_rules": op9_quality.ORACLE, "op13_filter_audit": op13_audit.ORACLE}
