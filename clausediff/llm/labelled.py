"""Bounded samples of labelled documents, and the fold that is held out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausediff.llm.storage import drop, written

#: Every fold but one of so many is learned from.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text is 0 modulo FOLDS; an id of null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> list[tuple[int, str, int]]:
    """Id, text and label of at most ``per_class`` documents of each class, of at most ``max_chars`` characters each.

    The rows of ``labels`` whose ids have the smallest hashes are taken, from
    the folds that are not held out; of several labels of an id the largest
    counts, null labels count as none. Texts reach the driver, at most
    2 * per_class * max_chars characters of them. Null texts count as empty;
    other columns of ``docs`` and ``labels`` are ignored.
    """
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", label)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max(label) >= 1).cast("int").alias("y"))
    sized = docs.select(F.col("doc_id").alias("id"), F.length("text").alias("n")).where("coalesce(n, 0) <= %d" % max_chars).select("id").distinct()
    known = written(known.join(sized, known.doc_id == sized.id, "left_semi"), "labelled")
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = written(some[0].union(some[1]).select(F.col("doc_id").alias("id"), "y"), "sample")  # at most 2 * per_class rows
    rows = docs.join(F.broadcast(chosen), docs.doc_id == chosen.id).where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars).select("id", "y", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    drop(known, chosen)
    return sorted((r.id, r.text, r.y) for r in rows)


def class_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """Documents labelled 0 and 1 in the folds that are learned from."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max(label) >= 1).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    return counts.get(0, 0), counts.get(1, 0)
