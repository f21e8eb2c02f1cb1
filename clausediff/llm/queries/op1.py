"""Personal data in every text of ``documents`` (no SQL: offsets of matches and a trained tagger)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausediff.llm.pii import pii_report
from clausediff.llm.storage import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii}
