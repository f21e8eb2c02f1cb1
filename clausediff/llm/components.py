"""Connected components of a distributed list of links.

Alternating large-star and small-star steps (Kiveris et al., 2014): each
replaces the links of a vertex by links to its smallest neighbour, so that the
number of links never grows and a chain of n vertices takes O(log^2 n) rounds.
As soon as the links that are left are few enough for one task (their number
is checked), that task settles them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.llm.storage import drop, written

#: Links that one task settles: about 100 MB of its memory.
ONE_TASK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, each vertex linked with its tree's smallest vertex."""
    if not len(a):
        return a, b
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            short = label[label]
            if np.array_equal(short, label):
                break
            label = short
        if np.array_equal(label[x], label[y]):
            break
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _settled(edges: DataFrame) -> DataFrame:
    """A forest of the links, made by one task."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if cols:
            a, b = forest(*(np.concatenate(c) for c in zip(*cols, strict=True)))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.coalesce(1).mapInArrow(settle, "a long, b long")


def _round(edges: DataFrame) -> DataFrame:
    """Large stars, then small stars."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return large.join(lowest, "a").select(ends.alias("e")).select("e.*").where("a <> b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``(id, component)`` of each vertex with a link, ``component`` the smallest id it reaches; a table that ``written`` returned.

    ``links`` has columns a and b (long). Repeated links, links of a vertex
    with itself and no links at all are fine; nulls are ignored.
    """
    edges = links.select("a", "b").where("a <> b")
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        if edges.count() <= one_task:
            stars = _settled(edges)
            break
        before, edges = edges, written(_round(edges), "links")
        drop(before)
        count, linked = edges.agg(F.count("*"), F.countDistinct("a")).first()
        if count == linked and not edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").take(1):
            stars = edges
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    named = written(stars.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("component")), F.struct(F.col("b").alias("id"), F.col("b").alias("component")))).alias("v")).select("v.*").distinct(), "components")
    drop(edges)
    return named
