"""Sentence boundaries as one zero-width pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausediff.functions.text import bare, lead, starts
from clausediff.schema import ABBREVIATIONS

_ABBREVIATION = "|".join(re.escape(a) for a in ABBREVIATIONS)
#: After a run of . ! ? unless that ends an abbreviation or a single capital, stands between digits, or a small letter follows.
BOUNDARY = (
    r"(?U)(?<=[.!?])(?![.!?])"
    rf"(?<!(?:^|\s)(?:{_ABBREVIATION}|[A-ZÇĞİÖŞÜ]\.))"
    r"(?!(?<=\p{Nd}[.!?]{1,64})\p{Nd})"
    r"(?!\s*\p{IsLowercase})"
)


def sentences(text: Column) -> Column:
    """Array of (start, end, text): the trimmed sentences that are not blank; the rest after the last boundary is one."""
    return F.transform(F.array(F.split(text, BOUNDARY)), _spans)[0]


def _spans(parts: Column) -> Column:
    def span(x: Column) -> Column:
        first, own = x["at"] + lead(x["part"]), bare(x["part"])
        return F.struct(first.alias("start"), (first + F.length(own)).alias("end"), own.alias("text"))

    placed = F.zip_with(parts, F.slice(starts(parts), 1, F.size(parts)), lambda p, at: F.struct(p.alias("part"), at.alias("at")))
    return F.filter(F.transform(placed, span), lambda s: s["text"] != "")


def unit_sentences(unit: Column, *inherited: str) -> Column:
    """The sentences of a unit as units of their own: places in the unit's block, and its page, block and further fields."""
    one = lambda s: F.struct(
        *(unit[c].alias(c) for c in ("page_no", "block_index", *inherited)), (unit["char_start"] + s["start"]).alias("char_start"), (unit["char_start"] + s["end"]).alias("char_end"), s["text"].alias("text")
    )
    return F.transform(sentences(unit["text"]), one)
