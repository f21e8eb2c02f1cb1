"""Matching of the sections of two versions: by number, by unique title, by vectors.

Each pass works on what the passes before left, and never pairs sections of
different types. All rows carry pair_id, so one job matches all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausediff.functions.text import title_key
from clausediff.schema import MIN_COSINE

MATCHES = "pair_id long, old_index int, new_index int, method string"
CACHE = "model string, sha string, vector array<float>"
_SIDE = ("pair_id", "order_index", "section_type", "madde_no", "key")


def keyed(sections: DataFrame) -> DataFrame:
    """What matching needs of a section; key is its title's, null without a title."""
    return sections.select("pair_id", "side", "order_index", "section_type", "madde_no", title_key(F.col("baslik")).alias("key"))


def titles_conflict(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (a != b)


def sides(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = keyed(sections) if "baslik" in sections.columns else sections
    return rows.where("side = 'old'").select(*_SIDE), rows.where("side = 'new'").select(*_SIDE)


def match_by_number(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair_id, old_index, new_index): same type and number, titles not in conflict, each section once.

    Where a number stands once on either side that is a join. Where it repeats,
    the old sections in order take the first free new one that does not
    conflict, within the group of the number.
    """
    on = ["pair_id", "section_type", "madde_no"]
    a = old.where("madde_no is not null").groupBy(*on).agg(F.collect_list(F.struct("order_index", "key")).alias("olds"))
    b = new.where("madde_no is not null").groupBy(*on).agg(F.collect_list(F.struct("order_index", "key")).alias("news"))
    both = a.join(b, on)
    single = (F.size("olds") == 1) & (F.size("news") == 1)
    plain = both.where(single).select("pair_id", F.col("olds")[0].alias("o"), F.col("news")[0].alias("n"))
    plain = plain.where(~titles_conflict(F.col("o.key"), F.col("n.key"))).select("pair_id", F.col("o.order_index").alias("old_index"), F.col("n.order_index").alias("new_index"))

    start = F.struct(F.col("ns").alias("free"), F.array().cast("array<struct<old_index:int,new_index:int>>").alias("out"))

    def take(acc: Column, o: Column) -> Column:
        fits = F.filter(acc["free"], lambda n: ~titles_conflict(o["key"], n["key"]))
        got = F.get(fits, F.lit(0))
        pair = F.array(F.struct(o["order_index"].cast("int").alias("old_index"), got["order_index"].cast("int").alias("new_index")))
        return F.when(F.size(fits) == 0, acc).otherwise(
            F.struct(F.filter(acc["free"], lambda n: n["order_index"] != got["order_index"]).alias("free"), F.concat(acc["out"], pair).alias("out"))
        )

    repeated = both.where(~single).select("pair_id", F.array_sort("olds").alias("os"), F.array_sort("news").alias("ns"))
    greedy = repeated.select("pair_id", F.explode(F.aggregate("os", start, take)["out"]).alias("p")).select("pair_id", "p.old_index", "p.new_index")
    return plain.union(greedy)


def match_by_title(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair_id, old_index, new_index): titles that stand once on both sides, among sections of a type."""
    on = ["pair_id", "section_type", "key"]
    unique = lambda df, name: df.where("key is not null").groupBy(*on).agg(F.count("*").alias("n"), F.min("order_index").alias(name)).where("n = 1").drop("n")
    return unique(old, "old_index").join(unique(new, "new_index"), on).select("pair_id", "old_index", "new_index")


def best_assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of rows and columns, as many as the smaller side, of the greatest total weight.

    Rows are added one at a time along a shortest augmenting path over reduced
    costs; n rows and m columns take O(n * n * m).
    """
    if weight.shape[0] > weight.shape[1]:
        return sorted((i, j) for j, i in best_assignment(weight.T))
    n, m = weight.shape
    cost = -weight.astype(float)
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for new in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, reached, last = new, 0.0, -1
        while True:
            step = reached + cost[row] - row_price[row] - col_price
            better = ~done & (step < dist)
            dist[better], via[better] = step[better], last
            col = int(np.where(done, np.inf, dist).argmin())
            reached, last = dist[col], col
            done[col] = True
            if owner[col] < 0:
                break
            row = int(owner[col])
        rows = [new, *(int(owner[c]) for c in np.flatnonzero(done) if owner[c] >= 0)]
        gain = {r: reached if r == new else reached - dist[np.flatnonzero(owner == r)[0]] for r in rows}
        for r, g in gain.items():
            row_price[r] += g
        inside = done & (np.arange(m) != col)
        col_price[inside] += dist[inside] - reached
        while col >= 0:
            before = int(via[col])
            owner[col] = new if before < 0 else owner[before]
            col = before
    return sorted((int(owner[c]), c) for c in range(m) if owner[c] >= 0)


def cosine_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows; a zero vector has cosine 0 with all."""
    unit = lambda x: x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    return unit(a) @ unit(b).T


def _by_type(old: DataFrame, new: DataFrame, vectors: DataFrame, extra: str, pick: Callable[[np.ndarray], Iterator[tuple]]) -> DataFrame:
    """(pair_id, old_index, new_index, ...) of what ``pick`` gives of the cosine matrix of each pair's sections of a type: rows (i, j, ...)."""
    on = ["pair_id", "side", "order_index"]
    left = old.withColumn("side", F.lit("old")).union(new.withColumn("side", F.lit("new"))).drop("madde_no", "key")
    both = left.join(vectors.select(*on, "vector"), on).select("pair_id", "section_type", "side", "order_index", "vector")
    names = ["pair_id", "old_index", "new_index", *(c.split()[0] for c in extra.split(",") if c)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order_index")
        x, y = rows[rows["side"] == "old"], rows[rows["side"] == "new"]
        out: list[tuple] = []
        if len(x) and len(y):
            cosine = cosine_matrix(np.array(x["vector"].tolist(), float), np.array(y["vector"].tolist(), float))
            out = [(int(x["pair_id"].iloc[0]), int(x["order_index"].iloc[i]), int(y["order_index"].iloc[j]), *more) for i, j, *more in pick(cosine)]
        return pd.DataFrame(out, columns=names)

    return both.groupBy("pair_id", "section_type").applyInPandas(run, "pair_id long, old_index int, new_index int" + (f", {extra}" if extra else ""))


def cosines(old: DataFrame, new: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pair_id, old_index, new_index, cosine) of every two sections of a type of either side of a pair."""
    return _by_type(old, new, vectors, "cosine double", lambda c: ((i, j, float(c[i, j])) for i, j in np.ndindex(*c.shape)))


def match_by_vectors(old: DataFrame, new: DataFrame, vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(pair_id, old_index, new_index): the assignment of the greatest total cosine of each pair and type, without pairs below ``min_cosine``.

    The threshold is applied after the assignment. ``vectors`` has pair_id,
    side, order_index and vector.
    """
    return _by_type(old, new, vectors, "", lambda c: ((i, j) for i, j in best_assignment(c) if c[i, j] >= min_cosine))


def _left(side: DataFrame, matched: DataFrame, index: str) -> DataFrame:
    return side.join(matched.select("pair_id", F.col(index).alias("order_index")), ["pair_id", "order_index"], "left_anti")


def match_sections(sections: DataFrame, vectors: DataFrame | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(pair_id, old_index, new_index, method): number, then unique title, then, if ``vectors`` are given, the best assignment."""
    old, new = sides(sections)
    found = match_by_number(old, new).withColumn("method", F.lit("NUMBER_AND_TITLE"))
    rest = lambda f: (_left(old, f, "old_index"), _left(new, f, "new_index"))
    found = found.union(match_by_title(*rest(found)).withColumn("method", F.lit("TITLE_ONLY")))
    if vectors is not None:
        found = found.union(match_by_vectors(*rest(found), vectors, min_cosine).withColumn("method", F.lit("EMBEDDING")))
    return found


def unmatched(sections: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Sections of a side without a match."""
    index = f"{side}_index"
    return sections.where(F.col("side") == side).join(matches.select("pair_id", F.col(index).alias("order_index")), ["pair_id", "order_index"], "left_anti")


def encode_misses(texts: DataFrame, cache: DataFrame, model: str, encode) -> DataFrame:
    """(model, sha, vector) of the texts of ``texts`` that ``cache`` lacks: to be appended to it.

    ``encode`` takes a list of texts and gives a matrix; it is called once per
    Arrow batch, in the workers.
    """
    wanted = texts.where("text is not null").select(F.sha2("text", 256).alias("sha"), "text").dropDuplicates(["sha"])
    missing = wanted.join(cache.where(F.col("model") == model).select("sha"), "sha", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"model": model, "sha": batch["sha"], "vector": [np.asarray(v, np.float32) for v in encode(batch["text"].tolist())]})

    return missing.select("sha", "text").mapInPandas(run, CACHE)


def cached_vectors(texts: DataFrame, cache_path: str, model: str, encode) -> DataFrame:
    """``texts`` (text and any columns) with vector, from the cache under ``cache_path`` (Parquet), to which what it lacks is appended first.

    Every row keeps its place among the other columns: a text that stands in
    many rows is encoded once, and null texts have a null vector. A run that
    is tried again may append a text twice; the least copy counts.
    """
    spark = texts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    known = spark.read.schema(CACHE).parquet(cache_path) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else spark.createDataFrame([], CACHE)
    encode_misses(texts, known, model, encode).write.mode("append").parquet(cache_path)
    found = spark.read.schema(CACHE).parquet(cache_path).where(F.col("model") == model).groupBy("sha").agg(F.min("vector").alias("vector"))
    keyed = texts.withColumn("sha", F.sha2("text", 256))
    return keyed.join(found, "sha", "left").select(*texts.columns, "vector")
