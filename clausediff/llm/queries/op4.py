"""Near copies among ``documents``: four-word shingles, Jaccard similarity of 0.85 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausediff.llm.jaccard import jaccard_components
from clausediff.llm.storage import table


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def components_sql(docs: str, n: int, percent: int, clean: str = "lower(coalesce(text, ''))") -> str:
    """CTEs whose last, ``joined``, has doc_id, n_shingles and component_id of each row of ``docs``.

    Candidates share a shingle that at most 200 documents hold, or all of a set
    is more frequent; both are brute force for tables of test size.
    """
    letters = "text"
    for c in range(26):
        letters = f"replace({letters}, '{chr(65 + c)}', '{chr(97 + c)}')"
    return f"""
  words AS (SELECT doc_id, list_filter(string_split_regex(coalesce({letters}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {docs}),
  grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 1}, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM words)),
  sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= {percent} * (x.n + y.n - n_both)),
  edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
  joined AS (SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = d.doc_id), d.doc_id) AS component_id
             FROM {docs} d LEFT JOIN sizes s ON s.doc_id = d.doc_id)"""


ORACLE_SQL = {"op4_jaccard_join": f"WITH RECURSIVE{components_sql('documents', 4, 85)} SELECT * FROM joined"}
QUERIES = {"op4_jaccard_join": op4_jaccard_join}
