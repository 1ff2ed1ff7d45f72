"""The queries of this package, by the names under which they are registered, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_quality_rules": "quality_rules",
    "op2_mpeg_audio": "mpeg_audio",
    "op3_warc_index": "warc_index",
    "op4_chat_windows": "chat_windows",
    "op5_toxicity": "toxicity",
    "op6_byte_bpe": "byte_bpe",
    "op7_url_filters": "url_filters",
    "op8_source_mixing": "source_mixing",
    "op9_lm_scoring": "lm_scoring",
    "op10_near_dedup": "near_dedup",
    "op11_phrase_mining": "phrase_mining",
    "op12_token_alignment": "token_alignment",
    "op13_simhash_dedup": "simhash_dedup",
}

SQL = (("op3_warc_index", "warc_index", "OP3_SQL"), ("op7_url_filters", "url_filters", "OP7_SQL"), ("op11_phrase_mining", "phrase_mining", "OP11_SQL"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"brinewave.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; tests hold the others against brute force."""
    return {name: getattr(importlib.import_module(f"brinewave.llm.{module}"), sql) for name, module, sql in SQL}
