"""Counts and tables of comparisons; every operator gives rows of all pairs at once.

``rows`` is the table of ``classify.ordered``. Labels that no row has count
zero, for pairs that have rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausediff.functions.text import article_label, neutral_formula, section_bucket, section_label
from clausediff.schema import CONTENT_LABELS, HIGHLIGHTS, KIND_LABELS_TR, LABELS_TR, NO_VALUE


def label_tr(label: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in LABELS_TR.items() for x in pair)), label)


def shown() -> Column:
    """The heading path that a row is counted under: the old section's before the new one's."""
    return F.when(F.col("old").isNotNull(), F.col("old.heading_path")).otherwise(F.col("new.heading_path"))


def _title() -> Column:
    return F.when(F.col("old").isNotNull(), F.col("old.baslik")).otherwise(F.col("new.baslik"))


def content_counts(rows: DataFrame) -> DataFrame:
    """(pair_id, change_type, label_no, n): all four labels of each pair."""
    wide = rows.groupBy("pair_id").agg(*(F.count_if(F.col("change_type") == c).alias(c) for c in CONTENT_LABELS))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("change_type"), F.lit(i).alias("label_no"), F.col(c).alias("n")) for i, c in enumerate(CONTENT_LABELS))))
    return wide.select("pair_id", pairs.alias("x")).select("pair_id", "x.*")


def structural_counts(rows: DataFrame) -> DataFrame:
    """(pair_id, renumbered, moved): two sums that may count a row twice."""
    return rows.groupBy("pair_id").agg(F.count_if("renumbered").alias("renumbered"), F.count_if("moved").alias("moved"))


def percent(n: Column, total: Column) -> Column:
    """One decimal, halves to even; 0 of a total of 0."""
    return F.when(total > 0, F.bround(n / total * 100, 1)).otherwise(0.0)


def summary_table(rows: DataFrame) -> DataFrame:
    counts = content_counts(rows)
    total = F.sum("n").over(Window.partitionBy("pair_id"))
    return counts.select("pair_id", "label_no", label_tr(F.col("change_type")).alias("label"), "n", percent(F.col("n"), total).alias("pct"))


def structural_table(rows: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.lit(LABELS_TR["RENUMBERED"]).alias("label"), F.col("renumbered").alias("n")), F.struct(F.lit(LABELS_TR["MOVED"]).alias("label"), F.col("moved").alias("n")))
    return structural_counts(rows).select("pair_id", F.inline(both))


def section_breakdown(rows: DataFrame) -> DataFrame:
    """(pair_id, section, one column per content label, section_no): sections by first appearance."""
    counted = rows.groupBy("pair_id", section_bucket(shown()).alias("section")).agg(*(F.count_if(F.col("change_type") == c).alias(c.lower()) for c in CONTENT_LABELS), F.min("row_idx").alias("first"))
    return counted.withColumn("section_no", F.row_number().over(Window.partitionBy("pair_id").orderBy("first"))).drop("first")


def changed() -> Column:
    return (F.col("change_type") != "IDENTICAL") | F.col("renumbered") | F.col("moved")


def most_changed_sections(rows: DataFrame) -> DataFrame:
    """(pair_id, section, n, place): all sections that share the largest number of changed rows, by first appearance; rows without a section are left out."""
    counted = rows.where(changed()).select("pair_id", "row_idx", section_label(shown()).alias("section")).where("section <> ''")
    counted = counted.groupBy("pair_id", "section").agg(F.count("*").alias("n"), F.min("row_idx").alias("first"))
    top = counted.withColumn("rank", F.rank().over(Window.partitionBy("pair_id").orderBy(F.desc("n")))).where("rank = 1")
    return top.select("pair_id", "section", "n", F.row_number().over(Window.partitionBy("pair_id").orderBy("first")).alias("place"))


# Fixed sentences.
_ONE = {"MODIFIED": " maddesinde içerik değişikliği tespit edildi.", "REMOVED": " maddesi yeni belgede bulunmuyor.", "ADDED": " maddesi yeni belgede eklendi."}
_MORE = {"MODIFIED": ("İçeriği değişen ", " madde daha var."), "REMOVED": ("Yeni belgede bulunmayan ", " madde daha var."), "ADDED": ("Yeni belgede eklenen ", " madde daha var.")}


def highlights(rows: DataFrame, limit: int = HIGHLIGHTS) -> DataFrame:
    """(pair_id, line_no, line): the first ``limit`` rows of each kind of change, how many more there are, and the structural totals."""
    kinds = list(_ONE)
    kind = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col("change_type")).cast("int")
    mine = rows.where(F.col("change_type").isin(*kinds)).select("pair_id", "row_idx", "change_type", kind.alias("kind"), article_label(_title(), shown()).alias("label"))
    place = Window.partitionBy("pair_id", "kind").orderBy("row_idx")
    placed = mine.select("*", F.row_number().over(place).alias("k"), F.count("*").over(Window.partitionBy("pair_id", "kind")).alias("n")).where(F.col("k") <= limit + 1)
    pick = lambda texts: F.element_at(F.create_map(*(F.lit(x) for pair in texts.items() for x in pair)), F.col("change_type"))
    text = F.when(F.col("k") <= limit, F.concat("label", pick(_ONE))).otherwise(F.concat(pick({k: v[0] for k, v in _MORE.items()}), (F.col("n") - limit).cast("string"), pick({k: v[1] for k, v in _MORE.items()})))
    lines = placed.select("pair_id", "kind", "k", text.alias("line"))
    totals = structural_counts(rows).select("pair_id", F.inline(F.array(
        F.struct(F.lit(4).alias("kind"), F.lit(1).alias("k"), F.col("renumbered").alias("n"), F.lit(" maddenin numarası değişti.").alias("tail")),
        F.struct(F.lit(5).alias("kind"), F.lit(1).alias("k"), F.col("moved").alias("n"), F.lit(" maddenin bölümü değişti.").alias("tail")),
    ))).where("n > 0").select("pair_id", "kind", "k", F.concat(F.col("n").cast("string"), F.col("tail")).alias("line"))
    return lines.union(totals).select("pair_id", (F.row_number().over(Window.partitionBy("pair_id").orderBy("kind", "k")) - 1).alias("line_no"), "line")


def summary_stats(rows: DataFrame) -> DataFrame:
    """One row per pair: totals of either side, counts and percentages of the labels, the most changed sections and the highlights."""
    base = rows.groupBy("pair_id").agg(
        F.count("*").alias("total"), F.count("old").alias("old_total"), F.count("new").alias("new_total"),
        *(F.count_if(F.col("change_type") == c).alias(c.lower()) for c in CONTENT_LABELS), F.count_if("renumbered").alias("renumbered"), F.count_if("moved").alias("moved"),
    )
    base = base.select("*", *(percent(F.col(c.lower()), F.col("total")).alias(f"{c.lower()}_pct") for c in CONTENT_LABELS))
    top = most_changed_sections(rows).groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda x: x["section"]).alias("top_sections"), F.max("n").alias("top_count"))
    lines = highlights(rows).groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("highlights"))
    none = F.array().cast("array<string>")
    return base.join(top, "pair_id", "left").join(lines, "pair_id", "left").withColumns({"top_sections": F.coalesce("top_sections", none), "highlights": F.coalesce("highlights", none)})


def detail_table(rows: DataFrame) -> DataFrame:
    """The ten columns of the detail table, by row; text columns are safe for spreadsheets."""
    yes = lambda c: F.when(F.col(c), "Evet").otherwise("Hayır")
    side = lambda s, f: F.when(F.col(s).isNotNull(), f).otherwise("")
    safe = lambda c: neutral_formula(F.coalesce(c, F.lit("")))
    return rows.select(
        "pair_id", "row_idx", label_tr(F.col("change_type")).alias("Değişim Türü"), yes("renumbered").alias("Numarası Değişti"), yes("moved").alias(LABELS_TR["MOVED"]),
        F.col("old.madde_no").alias("Eski Madde No"), F.col("new.madde_no").alias("Yeni Madde No"), safe(_title()).alias("Başlık"),
        safe(side("old", section_label(F.col("old.heading_path")))).alias("Eski Bölüm"), safe(side("new", section_label(F.col("new.heading_path")))).alias("Yeni Bölüm"),
        safe(F.col("old.body")).alias("Eski Metin"), safe(F.col("new.body")).alias("Yeni Metin"),
    )


def temporal_table(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, change order, madde, kind, old_value, new_value, page)."""
    numbers = pairs.select("pair_id", "old_index", "new_index", F.col("old.madde_no").alias("a"), F.col("new.madde_no").alias("b"))
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in KIND_LABELS_TR.items() for x in pair)), F.coalesce("old.kind", "new.kind"))
    return changes.join(numbers, ["pair_id", "old_index", "new_index"]).select(
        "pair_id", "old_index", "new_index", "diff_no", "change_no", F.when(F.col("a").eqNullSafe(F.col("b")), F.concat(F.lit("MADDE "), a)).otherwise(F.concat(F.lit("MADDE "), a, F.lit(" → "), b)).alias("madde"),
        kind.alias("kind"), F.coalesce("old.text", F.lit(NO_VALUE)).alias("old_value"), F.coalesce("new.text", F.lit(NO_VALUE)).alias("new_value"), F.coalesce(F.col("page_no").cast("string"), F.lit(NO_VALUE)).alias("page"),
    )
