"""Quality of every text of ``documents`` (no SQL: a network is trained)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausediff.llm.quality import quality_report
from clausediff.llm.storage import table

THRESHOLD = 0.3


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), THRESHOLD)


QUERIES = {"op7_quality": op7_quality}
