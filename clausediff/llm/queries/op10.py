"""``documents`` without the lines that stand in ten or more sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausediff.llm.line_dedup import remove_shared_lines
from clausediff.llm.storage import table

MIN_SITES = 10


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), MIN_SITES).select("doc_id", "text", "n_lines", "n_removed")


ORACLE_SQL = {
    "op10_line_dedup": f"""
WITH pieces AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, source, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM pieces),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM lines),
shared AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT k.*, s.key IS NOT NULL AS gone FROM keyed k LEFT JOIN shared s ON s.key = k.key),
summed AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text,
         count(*) FILTER (WHERE key <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text,
       coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN summed s ON s.doc_id = d.doc_id""",
}
QUERIES = {"op10_line_dedup": op10_line_dedup}
