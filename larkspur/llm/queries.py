"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from larkspur.llm import chat, decontam, fingerprint, html, langid, lm, mixing, neardup, quality, toxicity

QUERIES = {
    "op1_near_duplicates": neardup.op1_near_duplicates,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_fingerprints": fingerprint.op4_fingerprints,
    "op5_lm_scoring": lm.op5_lm_scoring,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": langid.op7_language_id,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality": quality.op9_quality,
    "op10_chat_formatting": chat.op10_chat_formatting,
}
SQL = {"op1_near_duplicates": neardup.OP1_SQL, "op8_mixing": mixing.OP8_SQL, "op10_chat_formatting": chat.OP10_SQL}
