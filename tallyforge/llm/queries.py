"""Queries over the driver's tables, one for each operator, and SQL where it can express one."""

from __future__ import annotations

from . import decontamination, language, mixing, near_dedup, oracles, pii, secrets, substring_dedup, topk, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_near_dedup": near_dedup.op2,
    "op3_substring_dedup": substring_dedup.op3,
    "op4_warc": warc.op4,
    "op5_pii": pii.op5,
    "op6_language": language.op6,
    "op7_topk": topk.op7,
    "op8_secrets": secrets.op8,
    "op9_decontamination": decontamination.op9,
    "op10_mixing": mixing.op10,
}

ORACLE_SQL = {
    "op2_near_dedup": oracles.OP2,
    "op3_substring_dedup": oracles.OP3,
    "op4_warc": warc.ORACLE,
    "op7_topk": oracles.OP7,
    "op9_decontamination": oracles.OP9,
}
