"""Passages of 50 words or more that stand in two documents (no SQL: runs of any length are compared)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausediff.llm.storage import table
from clausediff.llm.substrings import repeated_passages


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
