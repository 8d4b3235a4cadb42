"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from larkfield.llm import decontaminate, derived, html_text, language, line_quality, lm_score, merkle, mixing, near_dedup, pii, secrets, tool_chat, url_filter, vector_codes

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_language_id": language.op2_language_id,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_line_quality": line_quality.op4_line_quality,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_pii": pii.op6_pii,
    "op7_tool_chat": tool_chat.op7_tool_chat,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_html_text": html_text.op13_html_text,
    **derived.QUERIES,
}
SQL = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op4_line_quality": line_quality.OP4_SQL,
    "op8_near_dedup": near_dedup.OP8_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    **derived.SQL,
}
