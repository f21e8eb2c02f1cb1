"""Small documents for tests, and plain restatements to hold results against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausediff.schema import UNITS_SCHEMA


def units(spark: SparkSession, *docs: tuple[int, str, list[str]]) -> DataFrame:
    """(pair, side, blocks) as units; block i is on page i + 1."""
    rows = [(p, s, f"{p}-{s}", i + 1, i, 0, len(t), t) for p, s, blocks in docs for i, t in enumerate(blocks)]
    return spark.createDataFrame(rows, UNITS_SCHEMA)


def one(spark: SparkSession, column, **values):
    """The value of an expression over one row of ``values``."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def article(title: str, number: int, body: str) -> str:
    return f"{title}\nMADDE {number}- {body}"
