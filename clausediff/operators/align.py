"""Sequence alignment kernels: opcodes and ratios of the standard library's matcher, over Arrow batches.

Rows whose sequences are equal never reach Python's matcher: callers pass null.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: As a type, for a name of a type can be read in a session only.
OPCODES = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("i1", "i2", "j1", "j2"))]))


@F.pandas_udf(OPCODES)
def _opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        if x is None or y is None:
            return None
        return [{"op": op, "i1": i1, "i2": i2, "j1": j1, "j2": j2} for op, i1, i2, j1, j2 in SequenceMatcher(a=list(x), b=list(y), autojunk=False).get_opcodes()]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, list(x), list(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def opcodes(a: Column, b: Column) -> Column:
    """Opcodes that turn array ``a`` into ``b``, without the popularity heuristic."""
    same = a == b
    whole = F.when(F.size(a) > 0, F.array(F.struct(F.lit("equal").alias("op"), F.lit(0).alias("i1"), F.size(a).alias("i2"), F.lit(0).alias("j1"), F.size(b).alias("j2")))).otherwise(F.array().cast(OPCODES))
    return F.coalesce(_opcodes(F.when(~same, a), F.when(~same, b)), whole)


def ratio(a: Column, b: Column) -> Column:
    """Similarity of arrays ``a`` and ``b``, with the popularity heuristic of 200 elements or more."""
    same = a == b
    return F.coalesce(_ratio(F.when(~same, a), F.when(~same, b)), F.lit(1.0))
