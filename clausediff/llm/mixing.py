"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source whose share of the corpus is to become w gets the repetition rate
r = w * M / m, where m is its mass and M the mass of all (a document's mass is
its characters and one more). Each document is repeated k times, k the inverse
of the Poisson distribution with mean r at a number u in [0, 1) drawn from a
hash of seed and doc_id: a document's count depends on nothing but its own id
and its source's rate, so any machine and any retry gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausediff.llm.storage import small_enough, written

#: A Poisson number of a larger mean is the sum of numbers of smaller means, drawn from hashes of their own.
PART_MEAN = 400.0
#: Up to so many sources the table of rates is broadcast (about 3 KB each at the largest rate of a part).
BROADCAST_SOURCES = 20_000
SALTS = 64


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(source, rate, parts, cdf)``; sources that ``weights`` does not name have weight 0, without it all weigh alike."""
    mass = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).cast("double").alias("mass"))
    if weights is None:
        mass = mass.withColumn("weight", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        mass = mass.join(named, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "mass", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = mass.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    rates = mass.crossJoin(F.broadcast(total)).select("source", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_mass") / F.col("mass")).otherwise(0.0).alias("rate"))
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN).cast("int")))
    mean = F.col("rate") / F.col("parts")
    # CDF(0), CDF(1), ... as far as a double below 1 can reach
    steps = F.sequence(F.lit(1), (F.ceil(mean + 9.0 * F.sqrt(mean)) + 24).cast("int"))
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("cdf"))
    cdf = F.aggregate(
        steps,
        start,
        lambda acc, i: F.struct((acc["term"] * mean / i).alias("term"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["term"] * mean / i)).alias("cdf")),
    )
    return rates.withColumn("cdf", cdf["cdf"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 1) -> DataFrame:
    """``docs`` repeated to the target weights, in random order.

    Needs columns doc_id, source and text; keeps all columns and adds copy (1
    to n_copies), n_copies and place, the hash by which rows are dealt and
    ordered (columns of these names are replaced). Null is a source like any
    other; null and empty texts have mass 1; rows of equal doc_id and source
    get equal counts and places, of null doc_id counts by their text. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    rates = written(source_rates(docs, weights), "source-rates")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("copy", "n_copies", "place"))).alias("row"), F.col("source").alias("source"), ident.alias("ident"))
    if small_enough(spark, rates, BROADCAST_SOURCES):
        joined = rows.join(F.broadcast(rates.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name")))
    else:  # a hot source is dealt to SALTS tasks
        salted = rates.withColumnRenamed("source", "name").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("own", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("name")) & (F.col("own") == F.col("salt")))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")),
        F.lit(0),
        lambda acc, j: acc + F.size(F.filter("cdf", lambda c: c <= unit(F.lit(str(seed)), F.col("ident"), j.cast("string")))),
    )
    counted = joined.select("row", "ident", F.when(F.col("rate") > 0, count).otherwise(0).alias("n_copies")).where("n_copies > 0")
    copies = counted.select("row", "ident", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    placed = copies.select("row.*", "copy", "n_copies", F.substring(F.md5(F.concat_ws(":", F.lit(f"place{seed}"), "ident", F.col("copy").cast("string"))), 1, 16).alias("place"))
    return placed.repartition(F.col("place")).sortWithinPartitions("place")
