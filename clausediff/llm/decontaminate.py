"""Benchmark decontamination by spaced seeds; DataFrame functions only.

A seed is the hash of five chosen tokens within a span; the tokens between
them may differ. Seeds of every position of every document are joined with
those of the benchmark, and each diagonal (document, item, difference of
positions) that shares one is verified: the item's tokens are laid against the
document's and some window must agree in at least four of five tokens.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausediff.llm.storage import drop, small_enough, written

#: Chosen token positions. Modulo 5, 6 and 7 each leaves a residue free, so substitutions of every fifth, sixth or seventh token leave seeds whole.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
#: Tokens of a window that is verified, and the least share of them that must agree.
WINDOW, AGREE = 13, 0.8
#: Up to so many benchmark seeds (24 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def masks_for(lengths: list[int]) -> list[tuple[int, ...]]:
    """MASKS, a whole-sequence mask for each length too short for one of them, and masks of the tokens that are left for substitutions in items of these lengths that are accepted and leave no seed whole."""
    longest = max(m[-1] for m in MASKS) + 1
    masks = [*MASKS, *(tuple(range(n)) for n in lengths if n < longest)]
    for n in lengths:
        for bad in map(set, combinations(range(n), n - math.ceil(n * AGREE))):
            if not any(bad.isdisjoint(o + at for o in m) for m in masks for at in range(n - m[-1])):
                left = [i for i in range(n) if i not in bad]
                masks.append(tuple(i - left[0] for i in left))
    return masks


def _masks(benchmark: DataFrame) -> list[tuple[int, ...]]:
    """The masks for the lengths of items shorter than a window."""
    short = benchmark.select(F.size("w").alias("n")).where((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().collect()
    return masks_for(sorted(r.n for r in short))


def _positions(hashed: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """The rows of ``hashed`` with, instead of w and h, each position ``at`` and its seed ``s0``, ``s1``, ... by every mask (null past the end).

    The token hashes of a position stand side by side, as shifted copies of h
    zipped and exploded, so that seeds are made by compiled code.
    """
    keep = [c for c in hashed.columns if c not in ("w", "h")]
    offsets = sorted({o for m in masks for o in m})
    shifted = [(F.slice("h", o + 1, 2**30) if o else F.col("h")).alias(f"h{o}") for o in offsets]
    wide = hashed.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("at", "z"))
    seeds = [F.when(F.col(f"z.h{m[-1]}").isNotNull(), F.xxhash64(F.lit(k), *(F.col(f"z.h{o}") for o in m))).alias(f"s{k}") for k, m in enumerate(masks)]
    return wide.select(*keep, "at", *seeds)


def _stacked(positions: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """One row per position and seed."""
    keep = [c for c in positions.columns if c not in [f"s{k}" for k in range(len(masks))]]
    return positions.select(*keep, F.explode(F.array(*(F.col(f"s{k}") for k in range(len(masks))))).alias("seed")).where("seed is not null")


def _hashed(df: DataFrame, *keep: str) -> DataFrame:
    words = df.select(*keep, tokens(F.col("text")).alias("w"))
    return words.select("*", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, t1, t2, item_id, start, matched, n_item)``: the best alignment of each distinct text with each item that it holds.

    A document holds an item if on some diagonal a window of 13 of the item's
    tokens (all of them, if fewer) agrees with the document in at least 80 % of
    its positions. ``start`` is the document's token that lies against the
    item's first (negative if that lies before the text), ``matched`` the
    number of all agreeing tokens; ties go to the smallest start. t1 and t2
    are hashes of the text, so rows of equal doc_id but other texts stay apart
    and repeated rows give one. Null, empty and token-less texts hold nothing,
    and items without tokens are held by nothing. ``docs`` needs doc_id and
    text, ``benchmark`` item_id and text; other columns are ignored.
    """
    spark = docs.sparkSession
    items = written(_hashed(benchmark.select("item_id", "text").distinct(), "item_id").where(F.size("w") > 0), "items")
    masks = _masks(items)
    item_seeds = _stacked(_positions(items, masks), masks).select("item_id", "seed", F.col("at").alias("item_pos"))
    own = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    positions = _positions(_hashed(own, "doc_id", "t1", "t2"), masks)
    small = small_enough(spark, item_seeds, BROADCAST_SEEDS)
    hint = F.broadcast if small else (lambda df: df)
    if small:  # positions without any seed of the benchmark go before a row per seed is made
        some = F.lit(False)
        for k in range(len(masks)):
            known = item_seeds.select(F.col("seed").alias(f"b{k}")).distinct()
            positions = positions.join(F.broadcast(known), F.col(f"s{k}") == F.col(f"b{k}"), "left")
            some = some | F.col(f"b{k}").isNotNull()
        positions = positions.where(some).drop(*(f"b{k}" for k in range(len(masks))))
    hits = (
        _stacked(positions, masks)
        .join(hint(item_seeds), "seed")
        .select("doc_id", "t1", "t2", "item_id", (F.col("at") - F.col("item_pos")).alias("diagonal"))
        .groupBy("doc_id", "t1", "t2", "item_id")
        .agg(F.collect_set("diagonal").alias("diagonals"))  # no more than the text and the item have tokens
    )
    hits = written(hits, "seed-hits")
    # the texts of documents with a hit, read again
    texts = own.join(hits.select(F.col("doc_id").alias("d"), F.col("t1").alias("a"), F.col("t2").alias("b")).distinct(), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("a")) & (F.col("t2") == F.col("b")), "left_semi")
    texts = texts.groupBy(F.col("doc_id").alias("d"), F.col("t1").alias("a"), F.col("t2").alias("b")).agg(F.max("text").alias("text"))
    laid = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("a")) & (F.col("t2") == F.col("b")))
    laid = laid.select("doc_id", "t1", "t2", "item_id", tokens(F.col("text")).alias("dw"), F.explode("diagonals").alias("diagonal"))
    laid = laid.join(hint(items.select("item_id", F.col("w").alias("iw"))), "item_id")
    agrees = F.transform("iw", lambda w, j: F.coalesce(F.get("dw", j + F.col("diagonal")) == w, F.lit(False)).cast("int"))
    laid = laid.select("doc_id", "t1", "t2", "item_id", "diagonal", F.size("iw").alias("n_item"), agrees.alias("agrees"))
    width = F.least(F.lit(WINDOW), F.col("n_item"))
    held = F.exists(F.sequence(F.lit(1), F.col("n_item") - width + 1), lambda s: F.aggregate(F.slice("agrees", s, width), F.lit(0), lambda a, x: a + x) >= F.ceil(width * AGREE))
    best = laid.where(held).select("doc_id", "t1", "t2", "item_id", "n_item", F.col("diagonal").alias("start"), F.aggregate("agrees", F.lit(0), lambda a, x: a + x).alias("matched"))
    best = best.groupBy("doc_id", "t1", "t2", "item_id").agg(F.max("n_item").alias("n_item"), F.max(F.struct(F.col("matched"), (-F.col("start")).alias("s"))).alias("m"))
    best = best.select("doc_id", "t1", "t2", "item_id", (-F.col("m.s")).cast("long").alias("start"), F.col("m.matched").cast("long").alias("matched"), F.col("n_item").cast("long").alias("n_item"))
    best = written(best, "contaminated")
    drop(items, hits)
    return best


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of ``benchmark``."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad_id"), F.col("t1").alias("_bad1"), F.col("t2").alias("_bad2")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad1")) & (F.xxhash64(F.lit(1), "text") == F.col("_bad2"))
    return docs.join(bad, on, "left_anti")
