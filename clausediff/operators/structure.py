"""Lines and articles of documents, by windows over a document's lines.

Lines of all documents are numbered in one pass; what a line is follows from
its text and the next line's, and what it belongs to from running counts and
carried values: one shuffle by document, however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from clausediff.functions.text import bare, lead, starts
from clausediff.schema import ORDINALS

# Fixed patterns of headings; case folds as in Unicode, so dotted and dotless i are one letter.
_FLAGS = r"(?iuUd)"
_ORDINAL = "|".join(ORDINALS)
ARTICLE = _FLAGS + r"^\s*MADDE\s+(\d+)\s*[-–—.]?\s*"
TEMPORARY_ARTICLE = _FLAGS + r"^\s*GEÇİCİ\s+MADDE\s+(\d+)\s*[-–—.]?\s*"
CHAPTER = _FLAGS + rf"^\s*({_ORDINAL})\s+BÖLÜM\b"
PART = _FLAGS + rf"^\s*({_ORDINAL})\s+KISIM\b"

_KEY = ("pair_id", "side")


def _order() -> WindowSpec:
    """The order of a document's lines; every window has it, so that rows are sorted once."""
    return Window.partitionBy(*_KEY).orderBy("block_index", "start")


def split_lines(units: DataFrame) -> DataFrame:
    """The lines of each unit that are not blank: trimmed, with offsets in their block, numbered over the document (line_no from 0).

    ``units`` has pair_id, side, doc_id, page_no, block_index, char_start and
    text; null texts have no lines.
    """
    raw = units.where("text is not null").select(*_KEY, "doc_id", "page_no", "block_index", "char_start", F.split("text", "\n").alias("pieces"))
    placed = F.arrays_zip(F.col("pieces").alias("piece"), F.slice(starts(F.col("pieces"), 1), 1, F.size("pieces")).alias("at"))
    raw = raw.select(*_KEY, "doc_id", "page_no", "block_index", "char_start", F.explode(placed).alias("p"))
    start = F.col("char_start") + F.col("p.at") + lead(F.col("p.piece"))
    lines = raw.select(*_KEY, "doc_id", "page_no", "block_index", start.alias("start"), bare(F.col("p.piece")).alias("text")).where("text <> ''")
    return lines.select(*_KEY, "doc_id", (F.row_number().over(_order()) - 1).alias("line_no"), "page_no", "block_index", "start", (F.col("start") + F.length("text")).alias("end"), "text")


def line_kind(text: Column) -> Column:
    """B chapter, K part, G temporary article, M article, else null; the first that matches."""
    return F.when(text.rlike(CHAPTER), "B").when(text.rlike(PART), "K").when(text.rlike(TEMPORARY_ARTICLE), "G").when(text.rlike(ARTICLE), "M")


def mark_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with kind (T for the line before an article, its title), part, chapter and the article that a line belongs to (section_no, null outside)."""
    order = _order()
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("k0", line_kind(F.col("text")))
    marked = marked.withColumn("label", F.when(F.col("k0") == "K", F.regexp_extract("text", PART, 1)).when(F.col("k0") == "B", F.regexp_extract("text", CHAPTER, 1)))
    marked = marked.withColumn("kind", F.coalesce("k0", F.when(F.lead("k0").over(order).isin("M", "G"), F.lit("T"))))
    article = F.col("kind").isin("M", "G")
    heading = F.last(F.when(F.col("label").isNotNull(), F.struct("k0", "label")), ignorenulls=True).over(running)  # a part closes the chapter before it
    marked = marked.select(
        *(c for c in marked.columns if c not in ("k0", "label")), F.lag("kind").over(order).alias("before"), F.lag("text").over(order).alias("before_text"),
        F.sum(F.when(article, 1).otherwise(0)).over(running).alias("articles"), F.last("kind", ignorenulls=True).over(running).isin("M", "G").alias("open"),
        F.concat(F.last(F.when(F.col("k0") == "K", F.col("label")), ignorenulls=True).over(running), F.lit(" KISIM")).alias("kisim"), heading.alias("heading"),
    )
    marked = marked.withColumn("bolum", F.when(F.col("heading.k0") == "B", F.concat(F.col("heading.label"), F.lit(" BÖLÜM"))))
    return marked.withColumn("section_no", F.when(F.col("open"), F.col("articles") - 1).cast("int")).drop("articles", "open", "heading")


def parse_sections(units: DataFrame) -> DataFrame:
    """Articles: pair_id, side, doc_id, order_index, section_type, madde_no, baslik, heading_path, units, body.

    One unit per line of the body, headings' remainders first; ``body`` joins
    them by a space. A document without articles has no rows.
    """
    marked = mark_lines(split_lines(units)).where("section_no is not null")
    temporary, article = F.col("kind") == "G", F.col("kind").isin("M", "G")
    found = lambda group: F.when(temporary, F.regexp_extract("text", TEMPORARY_ARTICLE, group)).when(article, F.regexp_extract("text", ARTICLE, group))
    marked = marked.withColumns({"number": found(1).try_cast("int"), "head": F.coalesce(F.length(found(0)), F.lit(0))})
    marked = marked.withColumn("rest", F.expr("substring(text, head + 1)"))
    number, unit_text = F.col("number"), F.col("rest")
    shown = F.when(article, F.concat(F.when(temporary, "GEÇİCİ MADDE ").otherwise("MADDE "), number.cast("string")))
    unit = F.struct("line_no", "page_no", "block_index", (F.col("end") - F.length(unit_text)).alias("char_start"), F.col("end").alias("char_end"), unit_text.alias("text"))
    rows = marked.select(
        *_KEY, "doc_id", "section_no", "line_no", F.when(article, F.when(temporary, "GECICI_MADDE").otherwise("MADDE")).alias("section_type"), number.alias("madde_no"),
        F.when(article & (F.col("before") == "T"), F.col("before_text")).alias("baslik"),
        F.when(article, F.array_compact(F.array("kisim", "bolum", shown))).alias("heading_path"), F.when(unit_text != "", unit).alias("unit"),
    )
    grouped = rows.groupBy(*_KEY, F.col("section_no").alias("order_index")).agg(
        F.first("doc_id").alias("doc_id"), *(F.max(c).alias(c) for c in ("section_type", "madde_no", "baslik")), F.max("heading_path").alias("heading_path"), F.array_sort(F.collect_list("unit")).alias("u")
    )
    units_of = F.transform("u", lambda u: F.struct(u["page_no"].alias("page_no"), u["block_index"].alias("block_index"), u["char_start"].alias("char_start"), u["char_end"].alias("char_end"), u["text"].alias("text")))
    return grouped.select(*_KEY, "doc_id", "order_index", "section_type", "madde_no", "baslik", "heading_path", units_of.alias("units"), F.array_join(F.transform("u", lambda u: u["text"]), " ").alias("body"))
