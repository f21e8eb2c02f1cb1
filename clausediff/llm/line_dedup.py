"""Removal of lines that many sites share; DataFrame functions only.

How many distinct sites a line stands on is estimated for all lines at once by
HyperLogLog sketches, one per line hash, which merge by aggregation before and
after the shuffle: a line on a third of all pages costs each task one sketch.
Lines whose estimate lies near the threshold are counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausediff.llm.storage import drop, written

#: log2 of a sketch's size; its relative standard error is 1.04 / sqrt(2**LG_K).
LG_K = 10
#: Standard errors around the threshold within which the exact count decides.
SPREAD = 5.0


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _hashes(key: Column) -> list[Column]:
    """128 bits of hash: two lines of 10**12 share them with a chance of about 10**-15."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def _lines(docs: DataFrame) -> DataFrame:
    keys = docs.select(F.col("source").alias("site"), F.explode(F.split("text", "\n")).alias("line")).select("site", _key(F.col("line")).alias("key"))
    return keys.where("key <> ''").select("site", *_hashes(F.col("key")))


def shared_lines(docs: DataFrame, min_sites: int) -> DataFrame:
    """``(h1, h2)`` of the lines of ``docs`` (source, text) that stand on at least ``min_sites`` distinct sites.

    A null site counts as none. The result is a written table.
    """
    band = max(1.0, SPREAD * 1.04 / math.sqrt(1 << LG_K) * min_sites)
    lines = _lines(docs.where("source is not null"))
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    likely = written(
        sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").cast("double").alias("sites")).where(F.col("sites") >= min_sites - band),
        "line-sites",
    )
    near = likely.where(F.col("sites") <= min_sites + band).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").count().groupBy("h1", "h2").count().where(F.col("count") >= min_sites)
    shared = written(likely.where(F.col("sites") > min_sites + band).select("h1", "h2").union(exact.select("h1", "h2")), "shared-lines")
    drop(likely)
    return shared


def remove_shared_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """``docs`` without the lines that at least ``min_sites`` distinct sources share.

    Needs source and text, keeps all columns and adds n_lines, the text's
    lines that are not blank, and n_removed (columns of these names are
    replaced). Lines are compared without blanks at their ends; blank lines
    stay. A null text stays null with 0 lines; a text of which every line goes
    becomes empty. Rows of null source are cleaned too but spread no line.
    Repeated rows are treated alike.
    """
    shared = shared_lines(docs, min_sites)
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    # hashes of a text's shared lines; equal texts have equal lines, so they are found once per distinct text
    placed = rows.where("text is not null").select("t1", "t2", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _key))).alias("key")).where("key <> ''")
    found = placed.select("t1", "t2", *_hashes(F.col("key"))).join(shared, ["h1", "h2"]).groupBy("t1", "t2").agg(F.collect_set("h1").alias("bad1"), F.collect_set("h2").alias("bad2"))
    # a table of its own, so that Spark can split the rows of a text that a third of all documents copy
    found = written(found, "texts-with-shared-lines")
    drop(shared)
    joined = rows.join(found, ["t1", "t2"], "left")
    lines = F.split("text", "\n")

    def shared_line(line: Column) -> Column:
        key = _key(line)
        h1, h2 = _hashes(key)
        return (key != "") & F.array_contains("bad1", h1) & F.array_contains("bad2", h2)

    kept = joined.select(
        "row", "text", F.when(F.col("bad1").isNotNull(), F.filter(lines, lambda x: ~shared_line(x))).otherwise(lines).alias("kept"), lines.alias("lines")
    )
    return kept.select(
        "row.*",
        F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text"),
        F.when(F.col("text").isNotNull(), F.size(F.filter("lines", lambda x: _key(x) != ""))).otherwise(0).cast("long").alias("n_lines"),
        F.when(F.col("text").isNotNull(), F.size("lines") - F.size("kept")).otherwise(0).cast("long").alias("n_removed"),
    )
