"""Queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "quality_rules",
    "quality_classifier",
    "decontamination",
    "chat_format",
    "warc",
    "license_scan",
    "token_counts",
    "sentencepiece_lattice",
    "secret_scan",
    "simhash_dedup",
    "importance_resampling",
    "hard_negatives",
    "toxicity",
)


def _modules() -> list:
    return [import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {module.NAME: module.query for module in _modules()}


def oracle_sql() -> dict[str, str]:
    return {module.NAME: module.ORACLE_SQL for module in _modules() if module.ORACLE_SQL}
