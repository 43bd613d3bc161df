"""Queries of this subpackage, for the entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import language, leakage, licences, neighbours, pages, pii, secrets, simhash, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_simhash": simhash.op2_simhash,
    "op3_nearest": neighbours.op3_nearest,
    "op4_secrets": secrets.op4_secrets,
    "op5_bpe": tokens.op5_bpe,
    "op6_licences": licences.op6_licences,
    "op7_language": language.op7_language,
    "op8_decontaminate": leakage.op8_decontaminate,
    "op9_pages": pages.op9_pages,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op3_nearest": neighbours.OP3_SQL}
