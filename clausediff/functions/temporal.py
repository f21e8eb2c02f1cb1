"""Dates and durations in text, dates of documents, names of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausediff.schema import MONTHS, NUMBER_WORDS, UNITS

_MONTH = "|".join(MONTHS)
_UNIT = "|".join(UNITS)
_NUMBER = "|".join(NUMBER_WORDS)
# Fixed pattern of dates and durations.
EXPRESSION = (
    r"(?U)\b\d{1,2}[./]\d{1,2}[./]\d{4}\b"
    rf"|\b\d{{1,2}}\s+(?:{_MONTH})\s+\d{{4}}\b"
    r"|\b\d{4}\s+yılı(?:nda|nın|ndan)?\b"
    rf"|\b\d+\s+(?:{_UNIT})\b"
    rf"|\b(?:(?:{_NUMBER})\s+)*(?:{_NUMBER})\s+(?:{_UNIT})\b"
)


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def number_of_words(tokens: Column) -> Column:
    """Value of a number in words: a thousand closes a group, a hundred multiplies one, others add."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("group"))

    def add(acc: Column, word: Column) -> Column:
        value = F.element_at(_map(NUMBER_WORDS), word).cast("long")
        ones = F.when(acc["group"] == 0, F.lit(1)).otherwise(acc["group"])
        total = F.when(value == 1000, acc["total"] + ones * 1000).otherwise(acc["total"])
        group = F.when(value == 1000, F.lit(0)).when(value == 100, ones * 100).otherwise(acc["group"] + value)
        return F.struct(total.alias("total"), group.cast("long").alias("group"))

    return F.aggregate(tokens, start, add, lambda acc: acc["total"] + acc["group"])


def _date(y: Column, m: Column, d: Column) -> Column:
    """The ISO date, or null if there is none; years count from 1."""
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(y.cast("int") >= 1, F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"))


def temporal_expressions(text: Column) -> Column:
    """Array of (kind, text, value), in order; expressions of no calendar date are left out.

    ``value`` is the key that expressions are compared by: an ISO date,
    ``yyyy-YIL`` for a year, or amount and unit of a duration.
    """

    def one(m: Column) -> Column:
        parts = F.split(m, r"(?U)[./]|\s+")
        numeric = m.rlike(r"(?U)^\d{1,2}[./]\d{1,2}[./]\d{4}$")
        named = m.rlike(rf"(?U)^\d{{1,2}}\s+(?:{_MONTH})\s+\d{{4}}$")
        year = m.rlike(r"(?U)^\d{4}\s+yılı")
        digits = m.rlike(rf"(?U)^\d+\s+(?:{_UNIT})$")
        unit = F.element_at(parts, -1)
        value = (
            F.when(numeric, _date(F.get(parts, F.lit(2)), F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))
            .when(named, _date(F.get(parts, F.lit(2)), F.try_element_at(_map(MONTHS), F.get(parts, F.lit(1))).cast("string"), F.get(parts, F.lit(0))))
            .when(year, F.concat(F.get(parts, F.lit(0)), F.lit("-YIL")))
            .when(digits, F.concat_ws(" ", F.get(parts, F.lit(0)), unit))
            .otherwise(F.concat_ws(" ", number_of_words(F.when(numeric | named | year | digits, F.array().cast("array<string>")).otherwise(F.slice(parts, 1, F.size(parts) - 1))).cast("string"), unit))
        )
        return F.struct(F.when(numeric | named | year, "DATE").otherwise("DURATION").alias("kind"), m.alias("text"), value.alias("value"))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(EXPRESSION), 0), one), lambda e: e["value"].isNotNull())


def filename_date(name: Column) -> Column:
    """The first day-month-year in a file name, else the first year-month-day, else January 1 of the first year; a pattern whose first match is no date is passed over."""
    dmy, ymd = r"(?<!\d)(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})(?!\d)", r"(?<!\d)(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})(?!\d)"
    part = lambda p, i: F.nullif(F.regexp_extract(name, p, i), F.lit(""))
    return F.coalesce(
        _date(part(dmy, 3), part(dmy, 2), part(dmy, 1)).cast("date"),
        _date(part(ymd, 1), part(ymd, 2), part(ymd, 3)).cast("date"),
        _date(part(r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1), F.lit("1"), F.lit("1")).cast("date"),
    )


def metadata_date(raw: Column) -> Column:
    """The date of a file's own metadata: ``D:yyyymmdd...`` or text that begins with an ISO date."""
    pdf = r"^D:(\d{4})(\d{2})(\d{2})"
    of_pdf = _date(F.regexp_extract(raw, pdf, 1), F.regexp_extract(raw, pdf, 2), F.regexp_extract(raw, pdf, 3)).cast("date")
    iso = F.substring(raw, 1, 10)
    parts = F.split(iso, "-")
    of_iso = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), _date(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))).cast("date"))
    return F.when(raw.rlike(pdf), of_pdf).otherwise(of_iso)


def suggested_date(path: Column, raw: Column) -> Column:
    """(suggested_date, source): metadata before the file name before none."""
    meta, name = metadata_date(raw), filename_date(base_name(path))
    return F.struct(F.coalesce(meta, name).alias("suggested_date"), F.when(meta.isNotNull(), "metadata").when(name.isNotNull(), "filename").otherwise("none").alias("source"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def display_name(slot: Column, version_label: Column, effective: Column, published: Column, path: Column) -> Column:
    """Name by which reports call a document."""
    shown = F.coalesce(F.nullif(version_label, F.lit("")), F.date_format(effective, "dd.MM.yyyy"), F.date_format(published, "dd.MM.yyyy"), base_name(path))
    return F.concat(F.lit("Belge"), F.when(slot.isNotNull(), F.concat(F.lit(" "), slot)).otherwise(""), F.lit(" ("), shown, F.lit(")"))


def citation(name: Column, label: Column, page_no: Column) -> Column:
    return F.concat_ws(", ", name, label, F.when(page_no.isNotNull(), F.concat(F.lit("s. "), page_no.cast("string"))))
