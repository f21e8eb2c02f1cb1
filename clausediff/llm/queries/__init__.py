"""Queries of the operators and their SQL, by operator."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"{__name__}.{m}"), "ORACLE_SQL", {}).items()}
