"""Toxicity of every text of ``documents`` (no SQL: terms are learned)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausediff.llm.storage import table
from clausediff.llm.toxicity import toxicity_report

THRESHOLD = 0.5


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), THRESHOLD)


QUERIES = {"op5_toxicity": op5_toxicity}
