"""Items of ``benchmark`` that texts of ``documents`` hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausediff.llm.decontaminate import contaminated
from clausediff.llm.storage import table


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "matched", "n_item")


def held_sql(docs: str) -> str:
    """CTEs whose last, ``held``, has the best alignment of each document with each item: every diagonal with enough equal tokens is laid out, without seeds."""
    return f"""
  dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {docs}),
  iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
  dt AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS i FROM dw),
  it AS (SELECT item_id, len(w) AS n, unnest(w) AS t, unnest(range(0, len(w))) AS i FROM iw),
  hits AS (SELECT doc_id, item_id, dt.i - it.i AS diagonal FROM dt JOIN it ON dt.t = it.t GROUP BY ALL HAVING count(*) >= ceil(least(13, any_value(n)) * 0.8)),
  cells AS (SELECT h.*, j, len(iw.w) AS n_item, CAST(j + diagonal >= 1 AND coalesce(dw.w[CASE WHEN j + diagonal >= 1 THEN j + diagonal ELSE 1 END] = iw.w[j], false) AS INTEGER) AS ok
            FROM (SELECT h.*, unnest(range(1, len(iw.w) + 1)) AS j FROM hits h JOIN iw ON iw.item_id = h.item_id) h
            JOIN iw ON iw.item_id = h.item_id JOIN dw ON dw.doc_id = h.doc_id),
  sums AS (SELECT *, sum(ok) OVER w AS win, count(*) OVER w AS width, sum(ok) OVER (PARTITION BY doc_id, item_id, diagonal) AS matched
           FROM cells WINDOW w AS (PARTITION BY doc_id, item_id, diagonal ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)),
  good AS (SELECT DISTINCT doc_id, item_id, diagonal, matched, n_item FROM sums WHERE width = least(13, n_item) AND win >= ceil(width * 0.8)),
  held AS (SELECT doc_id, item_id, diagonal AS start, matched, n_item FROM good
           QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, diagonal) = 1)"""


ORACLE_SQL = {"op8_decontamination": f"WITH{held_sql('documents')} SELECT doc_id, item_id, start, CAST(matched AS BIGINT) AS matched, n_item FROM held"}
QUERIES = {"op8_decontamination": op8_decontamination}
