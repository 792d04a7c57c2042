"""Queries of the training-data operators and the SQL that checks them, for __spark_entry__."""

from __future__ import annotations

from claimgraph.llm import chat, decontaminate, htmltext, katz, language, near_duplicates, neighbours, packing, substrings, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_html_text": htmltext.op2_html_text,
        "op3_neighbours": neighbours.op3_neighbours,
        "op4_perspectives": chat.op4_perspectives,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_language": language.op6_language,
        "op7_substring_dedup": substrings.op7_substring_dedup,
        "op8_packing": packing.op8_packing,
        "op9_katz": katz.op9_katz,
        "op10_near_duplicates": near_duplicates.op10_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    """Operators that SQL can't express have none: their tests hold them against brute force."""
    return {"op4_perspectives": chat.SQL, "op5_decontamination": decontaminate.SQL, "op7_substring_dedup": substrings.SQL}
