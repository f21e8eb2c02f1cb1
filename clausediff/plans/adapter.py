"""Two versions of a regulation made of each text of ``documents``, as DataFrame and as SQL.

Line n of a text is article "Konu n" of the old version. The new one leaves
out every n of 3 modulo 7, adds "Ek n" after each n divisible by 6, adds a
sentence where n is 1 modulo 5, and lengthens a period where n is 2 modulo 4.
Four lines make a chapter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausediff.schema import ORDINALS


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, n, line): the lines of each text that are not blank, trimmed, numbered from 1.

    Texts are dealt by pair: all windows and groups up to the sections are by
    pair and more, so this one shuffle serves them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("pair_id"), "text").repartition(F.col("pair_id"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return docs.select("pair_id", F.posexplode(lines).alias("n", "line")).select("pair_id", (F.col("n") + 1).alias("n"), "line")


def articles(lines: DataFrame) -> DataFrame:
    """(pair_id, side, n, extra, madde_no, title, chapter, body)."""
    n = F.col("n")
    period = lambda k: F.when(n % 4 == 2, F.concat(F.lit(" Süre "), (n * 10 + k).cast("string"), F.lit(" gün olarak belirlenir."))).otherwise("")
    changed = F.when(n % 5 == 1, F.concat(F.lit(" Ek cümle "), n.cast("string"), F.lit(" uygulanır."))).otherwise("")
    text = lambda *more: F.concat(F.lit("(1) "), F.col("line"), *more)
    row = lambda side, extra, title, body: F.struct(F.lit(side).alias("side"), F.lit(extra).alias("extra"), title.alias("title"), body.alias("body"))
    title = F.concat(F.lit("Konu "), n.cast("string"))
    made = F.array_compact(F.array(
        row("old", 0, title, text(period(0))),
        F.when(n % 7 != 3, row("new", 0, title, text(changed, period(15)))),
        F.when(n % 6 == 0, row("new", 1, F.concat(F.lit("Ek "), n.cast("string")), F.concat(F.lit("(1) Ek hüküm "), n.cast("string"), F.lit(".")))),
    ))
    rows = lines.select("pair_id", "n", F.explode(made).alias("a")).select("pair_id", "n", "a.*")
    chapter = F.element_at(F.array(*map(F.lit, ORDINALS)), (F.floor((n - 1) / 4) % 15 + 1).cast("int"))
    order = Window.partitionBy("pair_id", "side").orderBy("n", "extra")
    return rows.select("pair_id", "side", "n", "extra", F.row_number().over(order).alias("madde_no"), "title", chapter.alias("chapter"), "body")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions as units of two or three lines, as a parser would find them in a file."""
    made = articles(source_lines(spark, sf_dir))
    before = F.lag("chapter").over(Window.partitionBy("pair_id", "side").orderBy("madde_no"))
    head = F.when(before.isNull() | (before != F.col("chapter")), F.concat("chapter", F.lit(" BÖLÜM\n"))).otherwise("")
    text = F.concat(head, "title", F.lit("\nMADDE "), F.col("madde_no").cast("string"), F.lit("- "), "body")
    block = (F.col("madde_no") - 1).cast("int")
    whole = made.select("pair_id", "side", F.concat_ws("-", F.col("pair_id").cast("string"), "side").alias("doc_id"), (F.floor(block / 5) + 1).cast("int").alias("page_no"), block.alias("block_index"), F.lit(0).alias("char_start"), text.alias("text"))
    return whole.select("pair_id", "side", "doc_id", "page_no", "block_index", "char_start", F.length("text").alias("char_end"), "text")


ORDINAL_SQL = "[" + ", ".join(f"'{o}'" for o in ORDINALS) + "]"

#: CTEs: l, art (articles of both sides), m (matches), c (rows of the comparison, without order).
BASE_SQL = f"""
  pieces AS (SELECT doc_id AS pair_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line,
                    unnest(range(1, 1 + len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')))) AS n FROM documents),
  l AS (SELECT pair_id, n, line, CASE WHEN n % 4 = 2 THEN ' Süre ' || (10 * n) || ' gün olarak belirlenir.' ELSE '' END AS p0,
               CASE WHEN n % 4 = 2 THEN ' Süre ' || (10 * n + 15) || ' gün olarak belirlenir.' ELSE '' END AS p1,
               CASE WHEN n % 5 = 1 THEN ' Ek cümle ' || n || ' uygulanır.' ELSE '' END AS e1, ({ORDINAL_SQL})[((n - 1) // 4) % 15 + 1] AS chapter FROM pieces),
  made AS (SELECT pair_id, 'old' AS side, n, 0 AS extra, 'Konu ' || n AS title, chapter, '(1) ' || line || p0 AS body FROM l
           UNION ALL SELECT pair_id, 'new', n, 0, 'Konu ' || n, chapter, '(1) ' || line || e1 || p1 FROM l WHERE n % 7 <> 3
           UNION ALL SELECT pair_id, 'new', n, 1, 'Ek ' || n, chapter, '(1) Ek hüküm ' || n || '.' FROM l WHERE n % 6 = 0),
  art AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY n, extra) AS no FROM made),
  o AS (SELECT * FROM art WHERE side = 'old'), w AS (SELECT * FROM art WHERE side = 'new'),
  m AS (SELECT o.pair_id, o.no AS old_no, w.no AS new_no, o.title, o.chapter AS old_chapter, w.chapter AS new_chapter, o.body AS old_body, w.body AS new_body,
               CASE WHEN o.no = w.no THEN 'NUMBER_AND_TITLE' ELSE 'TITLE_ONLY' END AS method
        FROM o JOIN w ON w.pair_id = o.pair_id AND w.n = o.n AND w.extra = 0),
  c AS (SELECT pair_id, CASE WHEN old_body = new_body THEN 'IDENTICAL' ELSE 'MODIFIED' END AS change_type, old_no <> new_no AS renumbered,
               abs(old_no - new_no) >= 3 OR old_chapter <> new_chapter AS moved, method, old_no, new_no, title, old_chapter, new_chapter, old_body, new_body FROM m
        UNION ALL SELECT pair_id, 'REMOVED', false, false, NULL, no, NULL, title, chapter, NULL, body, NULL FROM o WHERE n % 7 = 3
        UNION ALL SELECT pair_id, 'ADDED', false, false, NULL, NULL, no, title, NULL, chapter, NULL, body FROM w WHERE extra = 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY coalesce(old_no, new_no), CASE WHEN method IS NOT NULL THEN 0 WHEN change_type = 'REMOVED' THEN 1 ELSE 2 END) - 1 AS row_idx,
               coalesce(old_chapter, new_chapter) || ' BÖLÜM' AS section FROM c)"""
