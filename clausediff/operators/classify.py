"""Content status and structural flags of sections; the rows of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausediff.functions.text import compare_key, words
from clausediff.operators.align import ratio
from clausediff.operators.diff import sentence_keys
from clausediff.operators.match import unmatched
from clausediff.schema import IDENTICAL_RATIO, MOVED_DELTA


def renumbered(old: str = "old", new: str = "new") -> Column:
    return ~F.col(f"{old}.madde_no").eqNullSafe(F.col(f"{new}.madde_no"))


def _above(side: str) -> Column:
    path = F.col(f"{side}.heading_path")
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def moved(old: str = "old", new: str = "new") -> Column:
    """Other headings above, or a position at least three away."""
    return (_above(old) != _above(new)) | (F.abs(F.col(f"{old}.order_index") - F.col(f"{new}.order_index")) >= MOVED_DELTA)


def classified(sections: DataFrame, pairs: DataFrame, matches: DataFrame, by_sentence: bool = True) -> DataFrame:
    """(pair_id, change_type, renumbered, moved, method, old, new) of every match and every section left alone.

    A match is IDENTICAL from a ratio of its bodies' words of 0.98 on and, by
    sentence, only if none of its sentences differs either. Words are aligned
    for those matches only that nothing plainer decides.
    """
    equal = F.col("old.body") == F.col("new.body")
    keys = F.when(equal, True).otherwise(sentence_keys(F.col("old.body")) == sentence_keys(F.col("new.body"))) if by_sentence else F.lit(True)
    rated = pairs.withColumns({"equal": equal, "keys": keys})
    open_ = F.col("keys") & ~F.col("equal")
    key = lambda c: F.when(open_, words(compare_key(F.col(c))))
    same = F.col("equal") | F.col("keys") & (ratio(key("old.body"), key("new.body")) >= IDENTICAL_RATIO)
    both = rated.select("pair_id", F.when(same, "IDENTICAL").otherwise("MODIFIED").alias("change_type"), renumbered().alias("renumbered"), moved().alias("moved"), "method", "old", "new")
    kind = both.schema["old"].dataType
    whole = F.struct(*(c for c in sections.columns if c not in ("pair_id", "side")))

    def alone(side: str, label: str) -> DataFrame:
        mine, other = whole.cast(kind).alias(side), F.lit(None).cast(kind).alias("new" if side == "old" else "old")
        cols = (mine, other) if side == "old" else (other, mine)
        return unmatched(sections, matches, side).select("pair_id", F.lit(label).alias("change_type"), F.lit(False).alias("renumbered"), F.lit(False).alias("moved"), F.lit(None).cast("string").alias("method"), *cols)

    return both.unionByName(alone("old", "REMOVED")).unionByName(alone("new", "ADDED"))


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with row_idx: by the old position, else the new one; at a tie a match before a removal before an addition."""
    rank = F.when(F.col("method").isNotNull(), 0).when(F.col("change_type") == "REMOVED", 1).otherwise(2)
    order = Window.partitionBy("pair_id").orderBy(F.coalesce("old.order_index", "new.order_index"), rank)
    return rows.select("pair_id", (F.row_number().over(order) - 1).alias("row_idx"), *rows.columns[1:])
