"""Predicates by which a reader narrows a comparison."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausediff.functions.text import section_label
from clausediff.operators.metrics import shown
from clausediff.schema import ALL_SECTIONS, CONTENT_LABELS, STRUCTURAL_LABELS


def has_label(labels: Iterable[str] = CONTENT_LABELS + STRUCTURAL_LABELS) -> Column:
    """Whether a row has any of the content or structural labels; of no labels none."""
    chosen = set(labels)
    return F.col("change_type").isin(*(c for c in CONTENT_LABELS if c in chosen)) | (F.lit("RENUMBERED" in chosen) & F.col("renumbered")) | (F.lit("MOVED" in chosen) & F.col("moved"))


def in_section(section: str = ALL_SECTIONS) -> Column:
    return F.lit(True) if section == ALL_SECTIONS else section_label(shown()) == section


def visible(rows: DataFrame, labels: Iterable[str] = CONTENT_LABELS + STRUCTURAL_LABELS, section: str = ALL_SECTIONS) -> DataFrame:
    return rows.where(has_label(labels) & in_section(section))
