"""Near copies among ``embeddings``: cosine of 0.9 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausediff.llm.storage import table
from clausediff.llm.vectors import near_vectors


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


ORACLE_SQL = {
    "op6_embedding_dedup": """
WITH RECURSIVE
  e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
  pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
            WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.9),
  reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
  comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
  deg AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT x.vec_id, coalesce(deg.n, 0) AS n_links, coalesce(comp.component_id, x.vec_id) AS component_id,
       coalesce(comp.component_id, x.vec_id) = x.vec_id AS kept
FROM embeddings x LEFT JOIN comp ON comp.vec_id = x.vec_id LEFT JOIN deg ON deg.vec_id = x.vec_id"""
}
QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
