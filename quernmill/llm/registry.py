"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_fingerprints": "fingerprints",
    "op2_decontamination": "decontaminate",
    "op3_near_duplicates": "neardup",
    "op4_substring_repeats": "substrings",
    "op5_bpe": "bpe",
    "op6_pii": "pii",
    "op7_language_id": "langid",
    "op8_toxicity": "toxicity",
    "op9_quality": "quality",
    "op10_secret_scan": "secretscan",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, over its whole table."""
    return {name: getattr(import_module(f"quernmill.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express."""
    found = {name: getattr(import_module(f"quernmill.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
