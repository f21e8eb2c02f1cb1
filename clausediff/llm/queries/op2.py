"""``documents`` mixed so that each source makes up the same share of the characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausediff.llm.mixing import mix
from clausediff.llm.storage import table


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "text", "copy", "n_copies", "place")


MIXED = """
  mass AS (SELECT source, CAST(sum(coalesce(length(text), 0) + 1) AS DOUBLE) AS mass FROM {docs} GROUP BY source),
  rates AS (SELECT source, 1.0 / (SELECT count(*) FROM mass) * (SELECT sum(mass) FROM mass) / mass AS rate FROM mass),
  terms AS (SELECT source, i, exp(-rate + i * ln(rate) - lgamma(i + 1)) AS term FROM rates, (SELECT unnest(range(0, 200)) AS i)),
  cdf AS (SELECT source, i, sum(term) OVER (PARTITION BY source ORDER BY i) AS c FROM terms),
  drawn AS (SELECT *, CAST(CAST('0x' || substr(md5('1:' || CAST(doc_id AS VARCHAR) || ':1'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM {docs}),
  counted AS (SELECT d.doc_id, count(c.i) AS n_copies FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY d.doc_id),
  mixed AS (SELECT d.*, n.n_copies, unnest(range(1, n.n_copies + 1)) AS copy FROM {docs} d JOIN counted n ON n.doc_id = d.doc_id)"""

ORACLE_SQL = {
    "op2_mix_sources": "WITH"
    + MIXED.format(docs="documents")
    + """
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, CAST(n_copies AS INTEGER) AS n_copies,
       substr(md5('place1:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)), 1, 16) AS place
FROM mixed""",
}
QUERIES = {"op2_mix_sources": op2_mix_sources}
