"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, langid, linededup, lm, mixing, nearjoin, quality, rules, toxicity

QUERIES = {
    "op1_line_dedup": linededup.op1,
    "op2_quality_rules": rules.op2,
    "op3_language_id": langid.op3,
    "op4_chat_formatting": chat.op4,
    "op5_decontamination": decontaminate.op5,
    "op6_quality_classifier": quality.op6,
    "op7_toxicity": toxicity.op7,
    "op8_source_mixing": mixing.op8,
    "op9_ngram_jaccard_join": nearjoin.op9,
    "op10_lm_scoring": lm.op10,
}

ORACLES = {
    "op1_line_dedup": linededup.OP1_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
}
