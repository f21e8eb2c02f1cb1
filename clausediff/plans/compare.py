"""The whole comparison: units of two versions to rows, differences and changed dates."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausediff.operators import metrics
from clausediff.operators.classify import classified, ordered
from clausediff.operators.diff import pair_sections, sentence_diffs, temporal_changes, word_diffs
from clausediff.operators.match import match_sections
from clausediff.operators.structure import parse_sections
from clausediff.schema import MIN_COSINE, SIDES
from clausediff.sources.documents import read_files, require, units_of_contents


#: Of a section, what is no text; and the tables that several others need.
_BRIEF = ("order_index", "section_type", "madde_no", "baslik", "heading_path")
_KEPT = ("sections", "matches", "sentence_diffs", "brief")


class Comparison:
    """Lazy tables of a comparison of all pairs; each is planned when it is first asked for.

    ``persist`` keeps what several tables need once it is made (memory, then
    disk): the sections, the matches, the sentence differences and the rows
    without their texts.
    """

    def __init__(self, sections: DataFrame, vectors: DataFrame | None = None, min_cosine: float = MIN_COSINE) -> None:
        self.sections, self._vectors, self._min_cosine = sections, vectors, min_cosine

    def without_places(self) -> Comparison:
        """The same comparison of sections without their units, each of which holds its text again: for what shows no pages."""
        none = F.array().cast(self.sections.schema["units"].dataType)
        return Comparison(self.sections.withColumn("units", none), self._vectors, self._min_cosine)

    @cached_property
    def matches(self) -> DataFrame:
        return match_sections(self.sections, self._vectors, self._min_cosine)

    @cached_property
    def pairs(self) -> DataFrame:
        return pair_sections(self.sections, self.matches)

    @cached_property
    def sentence_diffs(self) -> DataFrame:
        return sentence_diffs(self.pairs)

    @cached_property
    def word_diffs(self) -> DataFrame:
        return word_diffs(self.sentence_diffs)

    @cached_property
    def temporal_changes(self) -> DataFrame:
        return temporal_changes(self.sentence_diffs)

    @cached_property
    def rows(self) -> DataFrame:
        return ordered(classified(self.sections, self.pairs, self.matches))

    @cached_property
    def brief(self) -> DataFrame:
        """``rows`` whose old and new hold no texts: all that counts, tables and filters need."""
        side = lambda s: F.when(F.col(s).isNotNull(), F.struct(*(F.col(f"{s}.{c}") for c in _BRIEF))).alias(s)
        found = classified(self.sections, self.pairs, self.matches)
        return ordered(found.select("pair_id", "change_type", "renumbered", "moved", "method", *map(side, SIDES)))

    @cached_property
    def shown(self) -> DataFrame:
        """``rows`` whose old and new hold a body only where it stands alone: what is rendered beside the differences."""
        lone = {"old": "REMOVED", "new": "ADDED"}
        body = lambda s: F.when(F.col("change_type") == lone[s], F.col(f"{s}.body")).alias("body")
        side = lambda s: F.when(F.col(s).isNotNull(), F.struct(*(F.col(f"{s}.{c}") for c in _BRIEF), body(s))).alias(s)
        found = classified(self.sections, self.pairs, self.matches)
        return ordered(found.select("pair_id", "change_type", "renumbered", "moved", "method", *map(side, SIDES)))

    @cached_property
    def summary(self) -> DataFrame:
        return metrics.summary_stats(self.brief)

    def persist(self, kept: tuple[str, ...] = _KEPT) -> Comparison:
        for name in kept:
            setattr(self, name, getattr(self, name).persist())
        return self

    def unpersist(self) -> None:
        for name in _KEPT:
            if name in self.__dict__:
                getattr(self, name).unpersist()

    def register(self, prefix: str = "") -> None:
        """Views sections, matches, sentence_diffs, temporal_changes and comparison for SQL."""
        for name, df in (("sections", self.sections), ("matches", self.matches), ("sentence_diffs", self.sentence_diffs), ("temporal_changes", self.temporal_changes), ("comparison", self.rows)):
            df.createOrReplaceTempView(prefix + name)


def compare_units(units: DataFrame, vectors: DataFrame | None = None, min_cosine: float = MIN_COSINE) -> Comparison:
    """Compares the documents of each pair; ``units`` as in ``schema.UNITS_SCHEMA``."""
    return Comparison(parse_sections(units), vectors, min_cosine)


def compare_contents(contents: DataFrame, extract: Callable[[bytes], list[tuple]] | None = None, strict: bool = False) -> tuple[Comparison, DataFrame]:
    """Compares files (pair_id, side, name, content), and gives the rejects (pair_id, side, name, error); ``strict`` raises the first one's exception."""
    units, rejects = units_of_contents(contents, extract)
    if strict:
        require(rejects)
    return compare_units(units), rejects


def compare_files(spark: SparkSession, old: str, new: str, extract: Callable[[bytes], list[tuple]] | None = None) -> Comparison:
    """Compares two files, as pair 0; raises UnsupportedFormat, NoTextLayer or CorruptDocument if one can't be read."""
    one = lambda path, side: read_files(spark, path, strict=True).select(F.lit(0).cast("long").alias("pair_id"), F.lit(side).alias("side"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
    return compare_contents(one(old, "old").union(one(new, "new")), extract, strict=True)[0]
