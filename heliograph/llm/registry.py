"""Queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from heliograph.llm import bases, chat, decontam, langid, lm, neardup, packing, pii, secrets, substrings, topk


def queries() -> dict:
    return {
        "op1_topk": topk.op1_topk,
        "op2_language_id": langid.op2_language_id,
        "op3_secrets": secrets.op3_secrets,
        "op4_chat_format": chat.op4_chat_format,
        "op5_near_duplicates": neardup.op5_near_duplicates,
        "op6_repeats": substrings.op6_repeats,
        "op7_decontaminate": decontam.op7_decontaminate,
        "op8_packing": packing.op8_packing,
        "op9_lm_scores": lm.op9_lm_scores,
        "op10_pii": pii.op10_pii,
    } | bases.queries()


def oracle_sql() -> dict:
    return {
        "op1_topk": topk.OP1_SQL,
        "op4_chat_format": chat.OP4_SQL,
        "op5_near_duplicates": neardup.OP5_SQL,
        "op6_repeats": substrings.OP6_SQL,
        "op7_decontaminate": decontam.OP7_SQL,
    } | bases.oracle_sql()
