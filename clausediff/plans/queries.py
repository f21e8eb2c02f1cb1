"""Queries over the two versions of each text of ``documents``, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausediff.functions import temporal, text
from clausediff.functions.sentences import sentences
from clausediff.operators import diff, filters, match, metrics, render, structure
from clausediff.plans import adapter
from clausediff.plans.adapter import BASE_SQL
from clausediff.plans.compare import Comparison, compare_units
from clausediff.schema import LABELS_TR, NUMBER_WORDS
from clausediff.sources.documents import body_blocks, pdf_guard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Registers a function under its name, with the SELECT of its SQL twin (after the shared CTEs)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {BASE_SQL} {sql}" if base else sql
        return f

    return add


_kept: list[Comparison] = []


def comparison(spark: SparkSession, sf_dir: str, places: bool = True) -> Comparison:
    """The comparison that a query reads, kept until the next query's (a query that is run again makes it again); without places only its sections and matches are."""
    while _kept:
        _kept.pop().unpersist()
    made = compare_units(adapter.units(spark, sf_dir))
    _kept.append(made.persist() if places else made.without_places().persist(("sections", "matches")))
    return _kept[-1]


def label_sql(column: str) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in LABELS_TR.items()) + " END"


_LABELS = "(SELECT unnest(['IDENTICAL', 'MODIFIED', 'ADDED', 'REMOVED']) AS change_type, unnest([0, 1, 2, 3]) AS label_no)"
_COUNTS = f"""counts AS (SELECT p.pair_id, k.change_type, k.label_no, (SELECT count(*) FROM c WHERE c.pair_id = p.pair_id AND c.change_type = k.change_type) AS n
  FROM (SELECT DISTINCT pair_id FROM c) p, {_LABELS} k)"""

# ---------------------------------------------------------------- counts


@query(f", {_COUNTS} SELECT pair_id, change_type, CAST(label_no AS INTEGER) AS label_no, n FROM counts")
def change_counts(spark, sf_dir):
    return metrics.content_counts(comparison(spark, sf_dir).brief)


@query("SELECT pair_id, count(*) FILTER (WHERE renumbered) AS renumbered, count(*) FILTER (WHERE moved) AS moved FROM c GROUP BY pair_id")
def structural_counts(spark, sf_dir):
    return metrics.structural_counts(comparison(spark, sf_dir).brief)


@query(f", {_COUNTS} SELECT pair_id, CAST(label_no AS INTEGER) AS label_no, {label_sql('change_type')} AS label, n, round_even(n / sum(n) OVER (PARTITION BY pair_id) * 100, 1) AS pct FROM counts")
def summary_pct(spark, sf_dir):
    return metrics.summary_table(comparison(spark, sf_dir).brief)


@query(f"""SELECT pair_id, '{LABELS_TR["RENUMBERED"]}' AS label, count(*) FILTER (WHERE renumbered) AS n FROM c GROUP BY pair_id
  UNION ALL SELECT pair_id, '{LABELS_TR["MOVED"]}', count(*) FILTER (WHERE moved) FROM c GROUP BY pair_id""")
def structural_table(spark, sf_dir):
    return metrics.structural_table(comparison(spark, sf_dir).brief)


@query("""SELECT pair_id, section, count(*) FILTER (WHERE change_type = 'IDENTICAL') AS identical, count(*) FILTER (WHERE change_type = 'MODIFIED') AS modified,
  count(*) FILTER (WHERE change_type = 'ADDED') AS added, count(*) FILTER (WHERE change_type = 'REMOVED') AS removed,
  CAST(row_number() OVER (PARTITION BY pair_id ORDER BY min(row_idx)) AS INTEGER) AS section_no FROM r GROUP BY pair_id, section""")
def section_breakdown(spark, sf_dir):
    return metrics.section_breakdown(comparison(spark, sf_dir).brief)


_CHANGED = "(change_type <> 'IDENTICAL' OR renumbered OR moved)"
_TOP = f"""top AS (SELECT pair_id, section, count(*) AS n, min(row_idx) AS first FROM r WHERE {_CHANGED} GROUP BY pair_id, section
  QUALIFY rank() OVER (PARTITION BY pair_id ORDER BY count(*) DESC) = 1)"""


@query(f", {_TOP} SELECT pair_id, section, n, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY first) AS INTEGER) AS place FROM top")
def most_changed_sections(spark, sf_dir):
    return metrics.most_changed_sections(comparison(spark, sf_dir).brief)


_LINES = """ranked AS (SELECT pair_id, title, change_type, row_number() OVER (PARTITION BY pair_id, change_type ORDER BY row_idx) AS k, count(*) OVER (PARTITION BY pair_id, change_type) AS n,
    CASE change_type WHEN 'MODIFIED' THEN 1 WHEN 'REMOVED' THEN 2 ELSE 3 END AS kind FROM r WHERE change_type <> 'IDENTICAL'),
  told AS (SELECT pair_id, kind, k, CASE WHEN k <= 5 THEN title || CASE kind WHEN 1 THEN ' maddesinde içerik değişikliği tespit edildi.' WHEN 2 THEN ' maddesi yeni belgede bulunmuyor.' ELSE ' maddesi yeni belgede eklendi.' END
      ELSE CASE kind WHEN 1 THEN 'İçeriği değişen ' WHEN 2 THEN 'Yeni belgede bulunmayan ' ELSE 'Yeni belgede eklenen ' END || (n - 5) || ' madde daha var.' END AS line FROM ranked WHERE k <= 6
    UNION ALL SELECT pair_id, 4, 1, count(*) || ' maddenin numarası değişti.' FROM c WHERE renumbered GROUP BY pair_id
    UNION ALL SELECT pair_id, 5, 1, count(*) || ' maddenin bölümü değişti.' FROM c WHERE moved GROUP BY pair_id),
  lines AS (SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY kind, k) - 1 AS INTEGER) AS line_no, line FROM told)"""


@query(f", {_LINES} SELECT * FROM lines")
def highlights_topk(spark, sf_dir):
    return metrics.highlights(comparison(spark, sf_dir).brief)


_STATS = f"""{_TOP}, {_LINES},
  base AS (SELECT pair_id, count(*) AS total, count(old_no) AS old_total, count(new_no) AS new_total, count(*) FILTER (WHERE change_type = 'IDENTICAL') AS identical, count(*) FILTER (WHERE change_type = 'MODIFIED') AS modified,
    count(*) FILTER (WHERE change_type = 'ADDED') AS added, count(*) FILTER (WHERE change_type = 'REMOVED') AS removed, count(*) FILTER (WHERE renumbered) AS renumbered, count(*) FILTER (WHERE moved) AS moved FROM c GROUP BY pair_id),
  stats AS (SELECT b.*, (SELECT string_agg(section, ', ' ORDER BY first) FROM top t WHERE t.pair_id = b.pair_id) AS top_sections, (SELECT max(n) FROM top t WHERE t.pair_id = b.pair_id) AS top_count,
    (SELECT count(*) FROM top t WHERE t.pair_id = b.pair_id) AS tops, (SELECT string_agg(line, chr(10) ORDER BY line_no) FROM lines x WHERE x.pair_id = b.pair_id) AS highlights FROM base b)"""


@query(f""", {_STATS} SELECT pair_id, total, old_total, new_total, identical, modified, added, removed, renumbered, moved, round_even(identical / total * 100, 1) AS identical_pct,
  coalesce(top_sections, '') AS top_sections, top_count, coalesce(highlights, '') AS highlights FROM stats""")
def summary_stats(spark, sf_dir):
    stats = comparison(spark, sf_dir).summary
    return stats.select("pair_id", "total", "old_total", "new_total", "identical", "modified", "added", "removed", "renumbered", "moved", "identical_pct", F.array_join("top_sections", ", ").alias("top_sections"), "top_count", F.array_join("highlights", "\n").alias("highlights"))


def _report_sql(html: bool) -> str:
    """The lines of a report, joined, of ``stats``."""
    strong = ("<strong>", "</strong>") if html else ("**", "**")
    bold = lambda x: f"'{strong[0]}' || {x} || '{strong[1]}'"
    name = lambda c: f'<span class="mk-badge mk-badge-{c.lower()}">{LABELS_TR[c]}</span>' if html else f"**{LABELS_TR[c]}**"
    item = lambda x: f"'<li>' || {x} || '</li>'" if html else f"'- ' || {x}"
    paragraph = lambda x: f"'<p>' || {x} || '</p>'" if html else x
    share = [item(f"'{name(c)}: ' || {c.lower()} || ' madde (%' || printf('%.1f', round_even({c.lower()} / total * 100, 1)) || ')'") for c in ("IDENTICAL", "MODIFIED", "ADDED", "REMOVED")]
    structural = [item(f"'{name(c)}: ' || {c.lower()} || ' maddede {what} değişikliği tespit edildi.'") for c, what in (("RENUMBERED", "madde numarası"), ("MOVED", "bölümü"))]
    intro = paragraph(f"'Eski belgede ' || {bold('old_total')} || ', yeni belgede ' || {bold('new_total')} || ' madde bulundu; toplam ' || {bold('total')} || ' karşılaştırma birimi sınıflandırıldı.'")
    names = f"(SELECT string_agg({bold('section')}, ', ' ORDER BY first) FROM top t WHERE t.pair_id = s.pair_id)"
    top = paragraph(f"'En çok değişiklik ' || {names} || CASE WHEN tops > 1 THEN ' bölümlerinde' ELSE ' bölümünde' END || ' görüldü (' || top_count || ' madde).'")
    lines = f"(SELECT list({item('line')} ORDER BY line_no) FROM lines x WHERE x.pair_id = s.pair_id)"
    if html:
        body = ["""'<div class="mk-summary">'""", "'<h2>Yönetici Özeti</h2>'", intro, "'<h3>İçerik Durumu</h3>'", "'<ul>'", *share, "'</ul>'", "'<h3>Yapısal Değişiklikler</h3>'", "'<ul>'", *structural, "'</ul>'"]
        head, more, tail = "[]", "['<h3>Öne Çıkan Değişiklikler</h3>', '<ul>']", "['</ul>']"
        end = "['</div>']"
    else:
        body = ["'## Yönetici Özeti'", "''", intro, "''", "'### İçerik Durumu'", *share, "''", "'### Yapısal Değişiklikler'", *structural]
        head, more, tail, end = "['']", "['', '### Öne Çıkan Değişiklikler']", "[]", "[]"
    parts = [f"[{', '.join(body)}]", f"CASE WHEN tops > 0 THEN list_concat({head}, [{top}]) ELSE [] END", f"CASE WHEN highlights IS NOT NULL THEN list_concat(list_concat({more}, {lines}), {tail}) ELSE [] END", end]
    return f", {_STATS} SELECT pair_id, array_to_string(list_concat(list_concat({parts[0]}, {parts[1]}), list_concat({parts[2]}, {parts[3]})), chr(10)) AS {'html' if html else 'markdown'} FROM stats s"


@query(_report_sql(False))
def summary_markdown(spark, sf_dir):
    return comparison(spark, sf_dir).summary.select("pair_id", render.summary_markdown().alias("markdown"))


@query(_report_sql(True))
def summary_html(spark, sf_dir):
    return comparison(spark, sf_dir).summary.select("pair_id", render.summary_html().alias("html"))


# ---------------------------------------------------------------- parsing


@query("""SELECT pair_id, side, CAST(no - 1 AS INTEGER) AS order_index, 'MADDE' AS section_type, CAST(no AS INTEGER) AS madde_no, title AS baslik, chapter || ' BÖLÜM > MADDE ' || no AS heading_path, body FROM art""")
def parse_sections(spark, sf_dir):
    return structure.parse_sections(adapter.units(spark, sf_dir)).select("pair_id", "side", F.col("order_index").cast("int").alias("order_index"), "section_type", "madde_no", "baslik", F.array_join("heading_path", " > ").alias("heading_path"), "body")


_RENDERED = """heads AS (SELECT *, lag(chapter) OVER (PARTITION BY pair_id, side ORDER BY no) IS DISTINCT FROM chapter AS opens FROM art),
  rendered AS (SELECT pair_id, side, no, chapter, 1 AS part, chapter || ' BÖLÜM' AS text FROM heads WHERE opens
    UNION ALL SELECT pair_id, side, no, chapter, 2, title FROM heads UNION ALL SELECT pair_id, side, no, chapter, 3, 'MADDE ' || no || '- ' || body FROM heads)"""


@query(f", {_RENDERED} SELECT pair_id, side, CAST(row_number() OVER (PARTITION BY pair_id, side ORDER BY no, part) - 1 AS INTEGER) AS line_no, text FROM rendered")
def section_lines(spark, sf_dir):
    return structure.split_lines(adapter.units(spark, sf_dir)).select("pair_id", "side", "line_no", "text")


@query(f""", {_RENDERED} SELECT pair_id, side, CAST(row_number() OVER (PARTITION BY pair_id, side ORDER BY no, part) - 1 AS INTEGER) AS line_no,
  CASE part WHEN 1 THEN 'B' WHEN 2 THEN 'T' ELSE 'M' END AS kind, chapter || ' BÖLÜM' AS bolum FROM rendered""")
def heading_context(spark, sf_dir):
    return structure.mark_lines(structure.split_lines(adapter.units(spark, sf_dir))).select("pair_id", "side", "line_no", "kind", "bolum")


@query()
def sentence_split(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "s")).select("doc_id", "sentence_no", "s.start", "s.end", "s.text")


# ---------------------------------------------------------------- matching


@query("SELECT pair_id, CAST(old_no - 1 AS INTEGER) AS old_index, CAST(new_no - 1 AS INTEGER) AS new_index FROM m WHERE method = 'NUMBER_AND_TITLE'")
def match_number(spark, sf_dir):
    c = comparison(spark, sf_dir)
    found = match.match_by_number(*match.sides(c.sections))
    return found.select("pair_id", F.col("old_index").cast("int").alias("old_index"), F.col("new_index").cast("int").alias("new_index"))


@query("SELECT pair_id, CAST(old_no - 1 AS INTEGER) AS old_index, CAST(new_no - 1 AS INTEGER) AS new_index FROM m")
def match_title(spark, sf_dir):
    """Every title of the adapter stands once on a side, so all pairs match by title alone."""
    c = comparison(spark, sf_dir)
    return match.match_by_title(*match.sides(c.sections)).select("pair_id", F.col("old_index").cast("int").alias("old_index"), F.col("new_index").cast("int").alias("new_index"))


@query("SELECT pair_id, CAST(old_no - 1 AS INTEGER) AS old_index, CAST(new_no - 1 AS INTEGER) AS new_index, method FROM m")
def match_cascade(spark, sf_dir):
    return comparison(spark, sf_dir).matches.select("pair_id", F.col("old_index").cast("int").alias("old_index"), F.col("new_index").cast("int").alias("new_index"), "method")


@query("SELECT pair_id, CAST(no AS INTEGER) AS madde_no, title AS baslik FROM o WHERE n % 7 = 3")
def removed_articles(spark, sf_dir):
    c = comparison(spark, sf_dir)
    return match.unmatched(c.sections, c.matches, "old").select("pair_id", "madde_no", "baslik")


@query("SELECT pair_id, CAST(no AS INTEGER) AS madde_no, title AS baslik FROM w WHERE extra = 1")
def added_articles(spark, sf_dir):
    c = comparison(spark, sf_dir)
    return match.unmatched(c.sections, c.matches, "new").select("pair_id", "madde_no", "baslik")


def _vector_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Vectors in pairs of 32 as two versions, even ids old and odd ids new: sections without number and title, and their vectors."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = v.select(F.floor(F.col("vec_id") / 32).alias("pair_id"), F.when(F.col("vec_id") % 2 == 0, "old").otherwise("new").alias("side"), F.floor(F.col("vec_id") % 32 / 2).cast("int").alias("order_index"), F.col("embedding").alias("vector"))
    return v.select("pair_id", "side", "order_index", F.lit("MADDE").alias("section_type"), F.lit(None).cast("int").alias("madde_no"), F.lit(None).cast("string").alias("key")), v


@query(
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) + 0.0 AS cosine
  FROM embeddings a JOIN embeddings b ON a.vec_id // 32 = b.vec_id // 32 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1""",
    base=False,
)
def cosine_pairs(spark, sf_dir):
    rows, vectors = _vector_rows(spark, sf_dir)
    found = match.cosines(*match.sides(rows), vectors)
    return found.select((F.col("pair_id") * 32 + F.col("old_index") * 2).alias("a"), (F.col("pair_id") * 32 + F.col("new_index") * 2 + 1).alias("b"), (F.round("cosine", 4) + 0.0).alias("cosine"))


@query()
def embedding_assignment(spark, sf_dir):
    """The best assignment of each pair's vectors; no SQL, for it is an optimum over permutations."""
    rows, vectors = _vector_rows(spark, sf_dir)
    return match.match_by_vectors(*match.sides(rows), vectors, 0.2)


# ---------------------------------------------------------------- rows


@query("""SELECT pair_id, CAST(row_idx AS INTEGER) AS row_idx, change_type, renumbered, moved, method, CAST(old_no AS INTEGER) AS old_no, CAST(new_no AS INTEGER) AS new_no FROM r""")
def comparison_rows(spark, sf_dir):
    rows = comparison(spark, sf_dir).brief
    return rows.select("pair_id", "row_idx", "change_type", "renumbered", "moved", "method", F.col("old.madde_no").alias("old_no"), F.col("new.madde_no").alias("new_no"))


@query(f"""SELECT pair_id, CAST(row_idx AS INTEGER) AS row_idx, {label_sql('change_type')} AS "Değişim Türü", CASE WHEN renumbered THEN 'Evet' ELSE 'Hayır' END AS "Numarası Değişti",
  CASE WHEN moved THEN 'Evet' ELSE 'Hayır' END AS "Bölümü Değişti", CAST(old_no AS INTEGER) AS "Eski Madde No", CAST(new_no AS INTEGER) AS "Yeni Madde No", title AS "Başlık",
  coalesce(old_chapter || ' BÖLÜM', '') AS "Eski Bölüm", coalesce(new_chapter || ' BÖLÜM', '') AS "Yeni Bölüm", coalesce(old_body, '') AS "Eski Metin", coalesce(new_body, '') AS "Yeni Metin" FROM r""")
def detail_table(spark, sf_dir):
    return metrics.detail_table(comparison(spark, sf_dir).rows)


@query("SELECT pair_id, CAST(row_idx AS INTEGER) AS row_idx, change_type FROM r WHERE change_type IN ('MODIFIED', 'ADDED') OR moved")
def filter_labels(spark, sf_dir):
    return filters.visible(comparison(spark, sf_dir).brief, ["MODIFIED", "ADDED", "MOVED"]).select("pair_id", "row_idx", "change_type")


@query("SELECT pair_id, CAST(row_idx AS INTEGER) AS row_idx, change_type FROM r WHERE section = 'İKİNCİ BÖLÜM'")
def filter_section(spark, sf_dir):
    return filters.visible(comparison(spark, sf_dir).brief, section="İKİNCİ BÖLÜM").select("pair_id", "row_idx", "change_type")


# ---------------------------------------------------------------- differences


@query()
def sentence_diff(spark, sf_dir):
    return comparison(spark, sf_dir).sentence_diffs.select("pair_id", "old_index", "new_index", "diff_no", "op", F.col("old.text").alias("old_text"), F.col("new.text").alias("new_text"), F.size("old.fragments").alias("old_pieces"))


@query("SELECT pair_id, CAST(old_no - 1 AS INTEGER) AS old_index, CAST(new_no - 1 AS INTEGER) AS new_index FROM m WHERE old_body <> new_body")
def changed_sections(spark, sf_dir):
    """Matches with a sentence that differs."""
    found = comparison(spark, sf_dir).sentence_diffs.where("op <> 'equal'").select("pair_id", "old_index", "new_index").distinct()
    return found.select("pair_id", F.col("old_index").cast("int").alias("old_index"), F.col("new_index").cast("int").alias("new_index"))


@query()
def word_diff(spark, sf_dir):
    made = comparison(spark, sf_dir).word_diffs.where("op = 'replace'").select("pair_id", "old_index", "new_index", "diff_no", F.posexplode("word_diffs").alias("word_no", "w"))
    return made.select("pair_id", "old_index", "new_index", "diff_no", "word_no", "w.op", F.array_join("w.old_words", " ").alias("old_words"), F.array_join("w.new_words", " ").alias("new_words"))


@query("""SELECT pair_id, CASE WHEN old_no = new_no THEN 'MADDE ' || old_no ELSE 'MADDE ' || old_no || ' → ' || new_no END AS madde, 'Süre' AS kind,
  CASE part WHEN 2 THEN '—' ELSE (10 * n) || ' gün' END AS old_value, CASE part WHEN 1 THEN '—' ELSE (10 * n + 15) || ' gün' END AS new_value, CAST((CASE part WHEN 2 THEN new_no ELSE old_no END - 1) // 5 + 1 AS VARCHAR) AS page
  FROM (SELECT m.*, o.n, unnest(CASE WHEN o.n % 5 = 1 THEN [1, 2] ELSE [0] END) AS part FROM m JOIN o ON o.pair_id = m.pair_id AND o.no = m.old_no WHERE o.n % 4 = 2)""")
def temporal_changes(spark, sf_dir):
    """Where a sentence was added before the changed one, the two stand against other sentences and are not paired."""
    c = comparison(spark, sf_dir)
    table = metrics.temporal_table(c.temporal_changes, c.pairs)
    return table.select("pair_id", "madde", "kind", "old_value", "new_value", "page")


@query()
def seq_similarity(spark, sf_dir):
    return diff.section_ratio(comparison(spark, sf_dir).pairs).select("pair_id", "old_index", "new_index", F.round("similarity", 6).alias("similarity"))


@query()
def rows_html(spark, sf_dir):
    """Two readers share the sections; all else is read once, and is not kept."""
    c = comparison(spark, sf_dir, False)
    return render.rows_html(c.shown, c.word_diffs)


# ---------------------------------------------------------------- text functions


def _docs(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    r"""SELECT doc_id, regexp_replace(translate(regexp_replace('“x” – ' || text || ' ge-' || chr(10) || 'lir', '([\p{L}])-\n([\p{L}])', '\1\2', 'g'), '“”„«»‘’–—−', repeat(chr(34), 5) || repeat(chr(39), 2) || '---'), '\s+', ' ', 'g') AS key FROM documents""",
    base=False,
)
def normalize_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.compare_key(F.concat(F.lit("“x” – "), F.col("text"), F.lit(" ge-\nlir"))).alias("key"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(lower(replace('  YÜRÜRLÜK İŞLERİ  ' || source || ' ' || text, 'İ', 'i' || chr(775))), 'ß', 'ss'), '\s+', ' ', 'g')) AS key FROM documents""", base=False)
def title_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.title_key(F.concat(F.lit("  YÜRÜRLÜK İŞLERİ  "), "source", F.lit(" "), "text")).alias("key"))


@query(r"""SELECT doc_id, regexp_replace(trim(regexp_replace(' Sayfa ' || doc_id || '  / 1000 ' || source, '\s+', ' ', 'g')), '\d+', '#', 'g') AS key FROM documents""", base=False)
def repetition_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.repetition_key(F.concat(F.lit(" Sayfa "), F.col("doc_id").cast("string"), F.lit("  / 1000 "), "source")).alias("key"))


_FIRST = "CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '@' WHEN 3 THEN '-' ELSE 'a' END || source"


@query(f"SELECT doc_id, CASE WHEN substr(x, 1, 1) IN ('=', '+', '-', '@') THEN '''' || x ELSE x END AS cell FROM (SELECT doc_id, {_FIRST} AS x FROM documents)", base=False)
def formula_guard(spark, sf_dir):
    first = F.element_at(F.array(*map(F.lit, "=+@-a")), (F.col("doc_id") % 5 + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", text.neutral_formula(F.concat(first, "source")).alias("cell"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM pages""", base=False)
def html_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.escape(F.col("html")).alias("html"))


def _period(n: int) -> str:
    """A number below a million in words, the inverse of what is tested."""
    names = {v: k for k, v in NUMBER_WORDS.items()}
    out = []
    for value, name in ((1000, "bin"), (100, "yüz")):
        if n >= value:
            out += ([_period(n // value)] if n // value > 1 else []) + [name]
            n %= value
    out += [names[x] for x in (n // 10 * 10, n % 10) if x]
    return " ".join(out)


_WORDS_TABLE = ", ".join(f"({i}, '{_period(i)}')" for i in range(1, 200))


@query(f"SELECT d.doc_id, CAST(w.i AS BIGINT) AS days FROM documents d JOIN (VALUES {_WORDS_TABLE}) w(i, words) ON w.i = d.doc_id % 199 + 1", base=False)
def duration_words(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.element_at(F.array(*(F.lit(_period(i)) for i in range(1, 200))), (F.col("doc_id") % 199 + 1).cast("int")).alias("w"))
    return docs.select("doc_id", temporal.number_of_words(F.split("w", " ")).alias("days"))


@query(r"""SELECT doc_id, 'DATE DURATION DATE DATE' AS kinds, strftime(make_date(2000 + CAST(doc_id % 25 AS INTEGER), CAST(doc_id % 12 + 1 AS INTEGER), CAST(doc_id % 28 + 1 AS INTEGER)), '%Y-%m-%d') || ',' || (doc_id % 90 + 1) || ' gün,'
  || (2000 + doc_id % 25) || '-YIL,2019-11-14' AS expressions FROM documents""", base=False)
def temporal_extract(spark, sf_dir):
    n = lambda k, a: (F.col("doc_id") % k + a).cast("string")
    made = F.concat(F.lit("Bu kural "), n(28, 1), F.lit("."), n(12, 1), F.lit("."), n(25, 2000), F.lit(" günü, "), n(90, 1), F.lit(" gün içinde, 31.2.2020 hariç, "), n(25, 2000), F.lit(" yılında ve 14 Kasım 2019 tarihinde uygulanır."))
    found = _docs(spark, sf_dir).select("doc_id", temporal.temporal_expressions(made).alias("e"))
    return found.select("doc_id", F.array_join(F.col("e.kind"), " ").alias("kinds"), F.array_join(F.col("e.value"), ",").alias("expressions"))


_NAME = "source || CASE doc_id % 3 WHEN 0 THEN '_' || (2000 + doc_id % 25) WHEN 1 THEN '_14.11.' || (2000 + doc_id % 25) ELSE '_son' END || '.pdf'"


def _name():
    year = (2000 + F.col("doc_id") % 25).cast("string")
    return F.concat("source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("_"), year)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("_14.11."), year)).otherwise("_son"), F.lit(".pdf"))


_GUESS = "CASE doc_id % 3 WHEN 0 THEN make_date(2000 + CAST(doc_id % 25 AS INTEGER), 1, 1) WHEN 1 THEN make_date(2000 + CAST(doc_id % 25 AS INTEGER), 11, 14) END"


@query(f"SELECT doc_id, {_NAME} AS name, CAST({_GUESS} AS VARCHAR) AS guess FROM documents", base=False)
def filename_date(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _name().alias("name")).select("doc_id", "name", temporal.filename_date(F.col("name")).cast("string").alias("guess"))


@query(f"""SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN make_date(2019, 11, CAST(doc_id % 28 + 1 AS INTEGER)) ELSE {_GUESS} END AS VARCHAR) AS suggested_date,
  CASE WHEN doc_id % 2 = 0 THEN 'metadata' WHEN doc_id % 3 = 2 THEN 'none' ELSE 'filename' END AS source FROM documents""", base=False)
def date_suggestion(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("D:201911"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("120000Z")))
    return _docs(spark, sf_dir).select("doc_id", temporal.suggested_date(F.concat(F.lit("/in/2001/"), _name()), raw).alias("s")).select("doc_id", F.col("s.suggested_date").cast("string").alias("suggested_date"), "s.source")


def _named(df: DataFrame) -> DataFrame:
    label = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("sürüm "), "source"))
    published = F.when(F.col("doc_id") % 3 == 1, F.make_date(F.lit(2019), F.lit(11), (F.col("doc_id") % 28 + 1).cast("int")))
    return df.select("doc_id", temporal.display_name(F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B"), label, F.lit(None).cast("date"), published, F.concat(F.lit("/in/"), "source", F.lit(".pdf"))).alias("name"))


_SHOWN = """'Belge ' || CASE doc_id % 2 WHEN 0 THEN 'A' ELSE 'B' END || ' (' || CASE doc_id % 3 WHEN 0 THEN 'sürüm ' || source WHEN 1 THEN strftime(make_date(2019, 11, CAST(doc_id % 28 + 1 AS INTEGER)), '%d.%m.%Y') ELSE source || '.pdf' END || ')'"""


@query(f"SELECT doc_id, {_SHOWN} AS name FROM documents", base=False)
def display_name(spark, sf_dir):
    return _named(_docs(spark, sf_dir))


@query(f"SELECT doc_id, {_SHOWN} || ', MADDE ' || (doc_id % 40) || CASE WHEN doc_id % 5 > 0 THEN ', s. ' || (doc_id % 5) ELSE '' END AS citation FROM documents", base=False)
def citation(spark, sf_dir):
    page = F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 5)
    return _named(_docs(spark, sf_dir)).select("doc_id", temporal.citation(F.col("name"), F.concat(F.lit("MADDE "), (F.col("doc_id") % 40).cast("string")), page).alias("citation"))


# ---------------------------------------------------------------- sources


def _blocks(spark, sf_dir) -> DataFrame:
    """Pages of 20 lines of ``documents``, a source's texts as one file, with a header, a footer and one image a page."""
    lines = adapter.source_lines(spark, sf_dir).select(F.col("pair_id").cast("string").alias("doc_id"), (F.floor((F.col("n") - 1) / 6) + 1).cast("int").alias("page_no"), F.col("n").cast("int").alias("n"), F.col("line").alias("text"))
    body = lines.select("doc_id", "page_no", F.col("n").alias("block_index"), F.lit(1000.0).alias("height"), (100.0 + (F.col("n") - 1) % 6 * 100).alias("y0"), (150.0 + (F.col("n") - 1) % 6 * 100).alias("y1"), "text", F.lit(0).alias("block_type"))
    pages = lines.select("doc_id", "page_no").distinct()
    extra = pages.select("doc_id", "page_no", F.explode(F.array(
        F.struct(F.lit(-1).alias("block_index"), F.lit(10.0).alias("y0"), F.lit(30.0).alias("y1"), F.concat(F.lit("Resmî Gazete  "), "page_no").alias("text"), F.lit(0).alias("block_type")),
        F.struct(F.lit(-2).alias("block_index"), F.lit(10.0).alias("y0"), F.lit(30.0).alias("y1"), F.when(F.col("page_no") % 3 == 0, F.concat(F.lit("Not "), F.repeat(F.lit("x"), F.col("page_no")))).otherwise(" ").alias("text"), F.lit(0).alias("block_type")),
        F.struct(F.lit(-3).alias("block_index"), F.lit(970.0).alias("y0"), F.lit(990.0).alias("y1"), F.concat(F.lit("SAYFA "), "page_no", F.lit(" / 9")).alias("text"), F.lit(0).alias("block_type")),
        F.struct(F.lit(-4).alias("block_index"), F.lit(400.0).alias("y0"), F.lit(500.0).alias("y1"), F.lit("image").alias("text"), F.lit(1).alias("block_type")),
    )).alias("b"))
    extra = extra.select("doc_id", "page_no", "b.block_index", F.lit(1000.0).alias("height"), "b.y0", "b.y1", "b.text", "b.block_type")
    return body.unionByName(extra)


_PAGES = "pg AS (SELECT DISTINCT pair_id, (n - 1) // 6 + 1 AS page_no FROM l)"


@query(f""", {_PAGES} SELECT CAST(pair_id AS VARCHAR) AS doc_id, CAST((n - 1) // 6 + 1 AS INTEGER) AS page_no, CAST(n AS INTEGER) AS block_index, line AS text FROM l
  UNION ALL SELECT CAST(pair_id AS VARCHAR), page_no, -2, 'Not ' || repeat('x', CAST(page_no AS INTEGER)) FROM pg WHERE page_no % 3 = 0""")
def header_footer_filter(spark, sf_dir):
    return body_blocks(_blocks(spark, sf_dir)).select("doc_id", "page_no", "block_index", "text")


@query(f""", pt AS (SELECT pair_id, (n - 1) // 6 + 1 AS page_no, sum(CASE WHEN pair_id % 4 = 0 AND n % 12 < 7 THEN 0 ELSE length(line) END) AS chars FROM l GROUP BY ALL)
  SELECT CAST(pair_id AS VARCHAR) AS doc_id, count(*) AS pages, avg(CASE WHEN chars >= 5 THEN 1.0 ELSE 0.0 END) AS share, avg(CASE WHEN chars >= 5 THEN 1.0 ELSE 0.0 END) >= 0.5 AS ok FROM pt GROUP BY pair_id""")
def text_layer_guard(spark, sf_dir):
    lines = adapter.source_lines(spark, sf_dir)
    shown = F.when((F.col("pair_id") % 4 == 0) & (F.col("n") % 12 < 7), " ").otherwise(F.col("line"))
    return pdf_guard(lines.select(F.col("pair_id").cast("string").alias("doc_id"), (F.floor((F.col("n") - 1) / 6) + 1).alias("page_no"), shown.alias("text")))


@query("""SELECT page_id, CASE WHEN page_id % 3 <> 0 AND (octet_length(encode('%PDF' || html)) * (page_id % 4)) BETWEEN 1 AND 60000 THEN base64(encode('%PDF' || html)) END AS payload FROM pages""", base=False)
def pdf_payload(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = F.when(F.col("page_id") % 3 == 0, "docx").otherwise("pdf")
    return pages.select("page_id", render.pdf_payload(kind, F.encode(F.concat(F.lit("%PDF"), "html"), "UTF-8"), F.col("page_id") % 4, 60000).alias("payload"))
