from __future__ import annotations

import io
import itertools
import time
import zipfile
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from helpers import article, units
from pyspark.sql import functions as F

from clausediff.operators import diff, filters, match, metrics, render, structure
from clausediff.plans.compare import compare_units
from clausediff.sources import documents, sinks


def sections_of(spark, blocks):
    return structure.parse_sections(units(spark, (1, "old", blocks))).orderBy("order_index").collect()


def test_part_outlives_chapter_and_clears_it(spark):
    got = sections_of(spark, ["BİRİNCİ KISIM\nBirinci Bölüm - Genel\nAmaç\nMADDE 1- (1) a.\nikinci bölüm", "Kapsam\nMadde 2 – b.", "İKİNCİ KISIM\nSon\nGEÇİCİ MADDE 1. c.\nd."])
    assert [list(s.heading_path) for s in got] == [["BİRİNCİ KISIM", "Birinci BÖLÜM", "MADDE 1"], ["BİRİNCİ KISIM", "ikinci BÖLÜM", "MADDE 2"], ["İKİNCİ KISIM", "GEÇİCİ MADDE 1"]]
    assert [(s.section_type, s.madde_no, s.baslik, s.body) for s in got] == [("MADDE", 1, "Amaç", "(1) a."), ("MADDE", 2, "Kapsam", "b."), ("GECICI_MADDE", 1, "Son", "c. d.")]


def test_untitled_article_takes_the_line_before_and_citations_open_articles(spark):
    got = sections_of(spark, ["Amaç\nMADDE 1- a.\nson satır\nMADDE 2- b.\nMadde 5 uyarınca c."])
    assert [(s.madde_no, s.baslik, s.body) for s in got] == [(1, "Amaç", "a."), (2, "son satır", "b."), (5, None, "uyarınca c.")]


def test_units_keep_their_places(spark):
    blocks = ["  Amaç \n MADDE 1-  ilk satır.  \n\n  ikinci ", "üçüncü\t"]
    for s in sections_of(spark, blocks):
        assert [u.text for u in s.units] == ["ilk satır.", "ikinci", "üçüncü"]
        for u in s.units:
            assert blocks[u.block_index][u.char_start : u.char_end] == u.text and u.page_no == u.block_index + 1


def test_documents_without_articles_and_empty_input(spark):
    assert not sections_of(spark, ["yalnız metin", "  \n "])
    empty = compare_units(units(spark).limit(0))
    assert empty.rows.count() == 0 and metrics.summary_table(empty.rows).count() == 0


def pairs(spark, old, new, **kw):
    rows = [("old", i, *s) for i, s in enumerate(old)] + [("new", i, *s) for i, s in enumerate(new)]
    df = spark.createDataFrame([(1, *r) for r in rows], "pair_id long, side string, order_index int, section_type string, madde_no int, baslik string")
    return sorted((m.old_index, m.new_index, m.method[0]) for m in match.match_sections(df, **kw).collect())


def plain_number_match(old, new):
    free, out = list(enumerate(new)), []
    for i, (t, n, b) in enumerate(old):
        hit = next((x for x in free if x[1][0] == t and x[1][1] == n and not (b and x[1][2] and b.casefold() != x[1][2].casefold())), None)
        if hit:
            free.remove(hit)
            out.append((i, hit[0], "N"))
    return out


def test_number_match_is_greedy_where_numbers_repeat(spark):
    titles = ["A", "B", None]
    cases = list(itertools.product(titles, repeat=4))
    for a, b, c, d in cases[:: 9]:
        old, new = [("MADDE", 1, a), ("MADDE", 1, b)], [("MADDE", 1, c), ("MADDE", 1, d)]
        got = [m for m in pairs(spark, old, new) if m[2] == "N"]
        assert got == plain_number_match(old, new), (old, new)


def test_titles_match_only_if_unique_and_types_never_mix(spark):
    assert pairs(spark, [("MADDE", 1, "X")], [("MADDE", 2, " x ")]) == [(0, 0, "T")]
    assert pairs(spark, [("MADDE", 1, "X"), ("MADDE", 2, "X")], [("MADDE", 3, "X")]) == []
    assert pairs(spark, [("MADDE", 1, None)], [("MADDE", 2, None)]) == []
    assert pairs(spark, [("MADDE", 1, None)], [("MADDE", 1, "Y")]) == [(0, 0, "N")]
    assert pairs(spark, [("MADDE", 1, "X")], [("GECICI_MADDE", 1, "X")]) == []
    assert pairs(spark, [("MADDE", 1, "X")], [("MADDE", 1, "Y")]) == []


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = (int(x) for x in rng.integers(1, 5, 2))
        w = rng.random((n, m))
        got = match.best_assignment(w)
        small, big = (n, m) if n <= m else (m, n)
        best = max(sum((w if n <= m else w.T)[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert len(got) == small and abs(sum(w[i, j] for i, j in got) - best) < 1e-9


def test_vectors_are_assigned_as_a_whole_and_cut_afterwards(spark):
    old, new = [("MADDE", 1, "a"), ("MADDE", 2, "b")], [("MADDE", 3, "c"), ("MADDE", 4, "d")]
    vec = {("old", 0): [1.0, 0.0], ("old", 1): [0.9, 0.436], ("new", 0): [1.0, 0.05], ("new", 1): [0.95, -0.31]}
    vectors = spark.createDataFrame([(1, s, i, v) for (s, i), v in vec.items()], "pair_id long, side string, order_index int, vector array<float>")
    assert pairs(spark, old, new, vectors=vectors) == [(0, 1, "E"), (1, 0, "E")]
    far = vectors.withColumn("vector", F.when(F.col("side") == "new", F.array(F.lit(0.0), F.lit(-1.0))).otherwise(F.col("vector")).cast("array<float>"))
    assert pairs(spark, old, new, vectors=far) == []
    assert not np.isnan(match.cosine_matrix(np.zeros((1, 2)), np.ones((1, 2)))).any()


def test_cache_encodes_only_misses(spark):
    cache = spark.createDataFrame([("m", "x", [1.0])], "model string, sha string, vector array<float>").withColumn("sha", F.sha2(F.lit("a"), 256))
    texts = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "text string")
    got = match.encode_misses(texts, cache, "m", lambda t: [[float(len(x))] for x in t]).collect()
    assert len(got) == 1 and got[0].vector == [1.0]


def test_sentence_over_two_pages_is_one(spark):
    c = compare_units(units(spark, (1, "old", ["A\nMADDE 1- Bu cümle", "burada biter. İkinci."]), (1, "new", ["A\nMADDE 1- Bu cümle burada biter. Üçüncü."])))
    rows = c.word_diffs.orderBy("diff_no").collect()
    assert [(r.op, len(r.old.fragments)) for r in rows] == [("equal", 2), ("replace", 1)]
    assert [(f.page_no, f.text) for f in rows[0].old.fragments] == [(1, "Bu cümle"), (2, "burada biter.")]
    assert [(w.op, w.old_words, w.new_words) for w in rows[1].word_diffs] == [("replace", ["İkinci."], ["Üçüncü."])]


def test_steps_agree_with_the_matcher(spark):
    rng = np.random.default_rng(4)
    cases = [([str(x) for x in rng.integers(0, 5, rng.integers(0, 8))], [str(x) for x in rng.integers(0, 5, rng.integers(0, 8))]) for _ in range(200)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a array<string>, b array<string>")
    from clausediff.operators.align import opcodes, ratio

    for r in df.select("i", diff.steps(opcodes(F.col("a"), F.col("b"))).alias("s"), ratio(F.col("a"), F.col("b")).alias("r")).collect():
        a, b = cases[r.i]
        want = []
        for op, i1, i2, j1, j2 in SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
            k = min(i2 - i1, j2 - j1) if op in ("equal", "replace") else 0
            want += [(op, i1 + x, j1 + x) for x in range(k)] + [("delete", i, None) for i in range(i1 + k, i2)] + [("insert", None, j) for j in range(j1 + k, j2)]
        assert [tuple(s) for s in r.s] == want
        assert r.r == pytest.approx(SequenceMatcher(None, a, b).ratio())


def test_small_change_in_a_long_article_is_found(spark):
    clauses = [f"({i}) Bu fıkra {i} sayılı yükümlülüğü ayrıntılı olarak düzenler." for i in range(1, 61)]
    changed = list(clauses)
    changed[30] = changed[30].replace("yükümlülüğü", "hakkı")
    c = compare_units(units(spark, (1, "old", [article("A", 1, " ".join(clauses))]), (1, "new", [article("A", 1, " ".join(changed))])))
    assert [r.change_type for r in c.rows.collect()] == ["MODIFIED"]
    assert c.sentence_diffs.where("op <> 'equal'").count() == 1


def test_missing_space_is_a_change_without_a_sentence(spark):
    c = compare_units(units(spark, (1, "old", [article("A", 1, "Bir biter.Sonra gelir")]), (1, "new", [article("A", 1, "Bir biter. Sonra gelir")])))
    assert [r.change_type for r in c.rows.collect()] == ["MODIFIED"]


def test_huge_article_in_time(spark):
    old = [f"({i}) Başvuru sahibi {i} numaralı belgeyi ilgili birime süresi içinde teslim eder." for i in range(1200)]
    new = [s.replace("teslim eder", "sunar") if i % 3 == 0 else s for i, s in enumerate(old)]
    c = compare_units(units(spark, (1, "old", [article("A", 1, " ".join(old))]), (1, "new", [article("A", 1, " ".join(new))])))
    pairs = c.pairs.persist()
    assert pairs.count() == 1
    start = time.time()
    ratio = diff.section_ratio(pairs).first().similarity
    took = time.time() - start
    print(f"similarity of an article of 1200 clauses: {took:.1f} s")
    assert took < 10 and 0.8 < ratio < 1
    assert c.rows.first().change_type == "MODIFIED"
    assert c.sentence_diffs.where("op = 'replace'").count() == 400


TEMPORAL = [
    ("Başvuru 30 gün içinde yapılır.", "Başvuru 45 gün içinde yapılır.", [("30 gün", "45 gün")]),
    ("Başvuru otuz gün içinde yapılır.", "Başvuru 45 gün içinde yapılır.", [("otuz gün", "45 gün")]),
    ("Tarih 14.11.2019 olur.", "Tarih 14 Kasım 2019 olur.", []),
    ("Kurul 30 gün bekler.", "Yeni üyeler 2023 yılında atanır ve göreve başlar.", [("30 gün", None), (None, "2023 yılında")]),
]


@pytest.mark.parametrize(("old", "new", "want"), TEMPORAL)
def test_temporal_changes(spark, old, new, want):
    c = compare_units(units(spark, (1, "old", [article("A", 1, old)]), (1, "new", [article("A", 1, new)])))
    got = c.temporal_changes.orderBy("diff_no", "change_no").collect()
    assert [(r.old and r.old.text, r.new and r.new.text) for r in got] == want
    assert all(r.page_no == 1 for r in got)


@pytest.fixture(scope="module")
def sample(spark):
    old = ["BİRİNCİ BÖLÜM", article("Amaç", 1, "Amaç budur."), article("Kapsam", 2, "Kapsam <geniş>."), article("Arşiv", 3, "Arşiv tutulur."), "İKİNCİ BÖLÜM", article("Ceza", 4, "=Ceza 30 gün."), article("Yürürlük", 5, "Yayımında yürürlüğe girer.")]
    new = ["BİRİNCİ BÖLÜM", article("Amaç", 1, "Amaç budur."), article("Kapsam", 2, "Kapsam dardır."), "İKİNCİ BÖLÜM", article("Ceza", 3, "=Ceza 45 gün."), article("Portal", 4, "Portal kurulur."), article("Yürürlük", 5, "Yayımında yürürlüğe girer.")]
    return compare_units(units(spark, (7, "old", old), (7, "new", new))).persist()


def test_rows_counts_and_tables(sample):
    rows = sample.rows
    assert [(r.change_type, r.renumbered, r.moved, r.method) for r in rows.orderBy("row_idx").collect()] == [
        ("IDENTICAL", False, False, "NUMBER_AND_TITLE"), ("MODIFIED", False, False, "NUMBER_AND_TITLE"), ("REMOVED", False, False, None), ("MODIFIED", True, False, "TITLE_ONLY"),
        ("ADDED", False, False, None), ("IDENTICAL", False, False, "NUMBER_AND_TITLE"),
    ]
    assert {r.change_type: r.n for r in metrics.content_counts(rows).collect()} == {"IDENTICAL": 2, "MODIFIED": 2, "ADDED": 1, "REMOVED": 1}
    assert [(r.label, r.n, r.pct) for r in metrics.summary_table(rows).orderBy("label_no").collect()] == [("Değişmedi", 2, 33.3), ("Değişti", 2, 33.3), ("Yeni Eklendi", 1, 16.7), ("Kaldırıldı", 1, 16.7)]
    assert [(r.section, r.identical, r.modified, r.added, r.removed) for r in metrics.section_breakdown(rows).orderBy("section_no").collect()] == [("BİRİNCİ BÖLÜM", 1, 1, 0, 1), ("İKİNCİ BÖLÜM", 1, 1, 1, 0)]
    assert [(r.section, r.n) for r in metrics.most_changed_sections(rows).orderBy("place").collect()] == [("BİRİNCİ BÖLÜM", 2), ("İKİNCİ BÖLÜM", 2)]
    assert [r.line for r in metrics.highlights(rows, 1).orderBy("line_no").collect()] == [
        "Kapsam maddesinde içerik değişikliği tespit edildi.", "İçeriği değişen 1 madde daha var.", "Arşiv maddesi yeni belgede bulunmuyor.", "Portal maddesi yeni belgede eklendi.", "1 maddenin numarası değişti.",
    ]
    table = metrics.temporal_table(sample.temporal_changes, sample.pairs).collect()
    assert [(r.madde, r.kind, r.old_value, r.new_value) for r in table] == [("MADDE 4 → 3", "Süre", "30 gün", "45 gün")]


def test_filters(sample):
    shown = lambda *a, **k: filters.visible(sample.rows, *a, **k).count()
    assert shown() == 6 and shown([]) == 0 and shown(["RENUMBERED"]) == 1 and shown(["ADDED", "RENUMBERED"]) == 2
    assert shown(section="İKİNCİ BÖLÜM") == 3 and shown(["IDENTICAL"], "İKİNCİ BÖLÜM") == 1


def test_reports(sample):
    rows, words = sample.rows, sample.word_diffs
    csv = sinks.csv_report(rows, 7)
    assert csv.startswith(b"\xef\xbb\xbf") and "'=Ceza 30 gün." in csv.decode()
    frame = pd.read_csv(io.BytesIO(csv))
    assert list(frame.columns) == ["Değişim Türü", "Numarası Değişti", "Bölümü Değişti", "Eski Madde No", "Yeni Madde No", "Başlık", "Eski Bölüm", "Yeni Bölüm", "Eski Metin", "Yeni Metin"] and len(frame) == 6
    with zipfile.ZipFile(io.BytesIO(sinks.excel_report(rows, 7))) as z:
        book = z.read("xl/workbook.xml").decode()
        assert book.index("Detay") < book.index("Özet") < book.index("Yapısal") and "Ceza" in z.read("xl/worksheets/sheet1.xml").decode()
    page = sinks.html_report(rows, words, 7).decode()
    assert page == sinks.html_report(rows, words, 7).decode()
    assert 'lang="tr"' in page and "&lt;geniş&gt;" in page and "<geniş>" not in page and page.count('class="mk-row"') == 6 and "(karşılığı yok)" in page
    assert '<span class="mk-diff mk-diff-modified">30</span>' in page and '<span class="mk-diff mk-diff-added">Portal kurulur.</span>' in page
    text = sample.summary.select(render.summary_markdown().alias("m")).first().m
    assert "- **Değişti**: 2 madde (%33.3)" in text and "bölümlerinde görüldü (2 madde)" in text
    with pytest.raises(ValueError):
        render.word_diffs_html(F.col("word_diffs"), "left")


def test_views_are_there_for_sql(spark, sample):
    sample.register("v_")
    assert spark.sql("SELECT count(*) AS n FROM v_comparison WHERE change_type = 'MODIFIED'").first().n == 2


def docx(paragraphs, styles=True):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t xml:space="preserve">{t}</w:t></w:r></w:p>' for t, s in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>hücre</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
        if styles:
            z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_docx_files_and_rejects(spark, tmp_path):
    (tmp_path / "good.docx").write_bytes(docx([("Başlık", "H1"), ("  ", None), ("MADDE 1- Bu bir maddedir.", None)]))
    (tmp_path / "short.DOCX").write_bytes(docx([("kısa", None)]))
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "old.doc").write_bytes(b"x")
    files = documents.read_files(spark, str(tmp_path))
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in files.collect()}
    assert "old.doc" in errors["old.doc"] and ".pdf, .docx" in errors["old.doc"] and errors["good.docx"] is None
    found = documents.decode_docx(files)
    rows = [(r.block_index, r.text, r.style) for r in found.where("path like '%good%'").orderBy("block_index").collect()]
    assert rows == [(0, "Başlık", "Heading 1"), (1, "MADDE 1- Bu bir maddedir.", None)]
    guard = {r.path.rsplit("/", 1)[1]: r.error for r in documents.docx_guard(found).collect()}
    assert guard["good.docx"] is None and "no text layer" in guard["short.DOCX"] and "corrupt" in guard["bad.docx"]
    with pytest.raises(documents.UnsupportedFormat):
        documents.read_files(spark, str(tmp_path), strict=True)
    parsed = structure.parse_sections(documents.units_of(found.where("path like '%good%'"), F.lit(1), F.lit("old"))).first()
    assert (parsed.madde_no, parsed.baslik) == (1, "Başlık")


def test_headers_footers_and_text_layer(spark):
    rows = []
    for page in range(1, 6):
        rows += [("d", page, page * 10, 1000.0, 10.0, 40.0, f"Gazete {page}", 0), ("d", page, page * 10 + 1, 1000.0, 400.0, 500.0, "gövde  metni", 0), ("d", page, page * 10 + 2, 1000.0, 960.0, 990.0, f"Sayfa {page}/5", 0), ("d", page, page * 10 + 3, 1000.0, 1.0, 2.0, "x", 1)]
    rows += [("d", 1, 19, 1000.0, 10.0, 20.0, "tek başlık", 0), ("d", 2, 29, 1000.0, 10.0, 20.0, " ", 0), ("d", 3, 39, 1000.0, 10.0, 30.0, "sayfa 3", 0)]
    blocks = spark.createDataFrame(rows, documents.BLOCKS)
    kept = sorted(r.block_index for r in documents.body_blocks(blocks).collect())
    assert kept == sorted([p * 10 + 1 for p in range(1, 6)] + [19, 39])
    pages = spark.createDataFrame([("a", 1, "metin var"), ("a", 2, " "), ("b", 1, "abcd"), ("b", 2, None), ("b", 3, "yeterli")], "doc_id string, page_no int, text string")
    assert {r.doc_id: r.ok for r in documents.pdf_guard(pages).collect()} == {"a": True, "b": False}


def test_pdf_links(spark):
    df = spark.createDataFrame([("pdf", bytearray(b"%PDF-1"), 2), ("pdf", bytearray(b"%PDF-1"), 0), ("docx", bytearray(b"%PDF-1"), 1), ("pdf", bytearray(b"PK"), 1), ("pdf", bytearray(b"%PDF-1"), 9)], "k string, c binary, n int")
    assert [r.p is not None for r in df.select(render.pdf_payload(F.col("k"), F.col("c"), F.col("n"), 20).alias("p")).collect()] == [True, False, False, False, False]


def test_source_links(spark):
    schema = "units array<struct<page_no:int,text:string>>, payload string"
    df = spark.createDataFrame([([(None, "a"), (3, "b")], "QUJD"), ([(3, "b")], None), ([(3, "b")], ""), ([(None, "a")], "QUJD"), (None, "QUJD")], schema)
    got = [r.x for r in df.select(render.source_link(F.col("units"), F.col("payload")).alias("x")).collect()]
    assert [(x.page_no, x.kind, x.needs_iframe) for x in got] == [(3, "link", True), (3, "page", False), (3, "page", False), (None, "none", False), (None, "none", False)]
    assert "Sayfa 3</a>" in got[0].html and "base64,QUJD'" in got[0].html and "#page=3'" in got[0].html and got[1].html == '<span class="mk-source-page">Sayfa 3</span>' and got[3].html == ""


def test_sentences_of_a_unit_inherit_its_place(spark):
    from clausediff.functions.sentences import unit_sentences

    text = " Bir biter. İki biter "
    df = spark.createDataFrame([((4, 7, 100, 100 + len(text), text, ["BİRİNCİ BÖLÜM"]),)], "u struct<page_no:int,block_index:int,char_start:int,char_end:int,text:string,heading_path:array<string>>")
    got = df.select(unit_sentences(F.col("u"), "heading_path").alias("s")).first().s
    assert [(s.page_no, s.block_index, s.heading_path, text[s.char_start - 100 : s.char_end - 100], s.text) for s in got] == [(4, 7, ["BİRİNCİ BÖLÜM"], t, t) for t in ("Bir biter.", "İki biter")]


def test_arrivals(spark, tmp_path):
    from clausediff.streaming.arrivals import compare_arrivals

    whole = units(spark, (1, "old", [article("A", 1, "x.")]), (1, "new", [article("A", 1, "y.")]), (2, "old", [article("B", 1, "z.")]), (3, "new", [article("C", 1, "z.")]))
    late = units(spark, (2, "new", [article("B", 1, "z.")]))

    def run(arrived):
        arrived.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
        compare_arrivals(stream, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination(180)
        return sorted((r.pair_id, r.change_type) for r in spark.read.parquet(str(tmp_path / "out/*")).collect())

    assert run(whole) == [(1, "MODIFIED")]  # one side alone is neither removed nor added
    assert run(late) == [(1, "MODIFIED"), (2, "IDENTICAL")]


def test_two_files_to_a_result(spark, tmp_path):
    from clausediff.plans.compare import compare_contents, compare_files

    text = lambda body: docx([("Amaç", "H1"), (f"MADDE 1- {body}", None), ("Kapsam", "H1"), ("MADDE 2- Kapsam aynıdır.", None)])
    (tmp_path / "a.docx").write_bytes(text("Başvuru 30 gün içinde yapılır."))
    (tmp_path / "b.docx").write_bytes(text("Başvuru 45 gün içinde yapılır."))
    (tmp_path / "c.docx").write_bytes(text("x")[:200])
    c = compare_files(spark, str(tmp_path / "a.docx"), str(tmp_path / "b.docx"))
    assert [(r.change_type, r.old.baslik) for r in c.rows.orderBy("row_idx").collect()] == [("MODIFIED", "Amaç"), ("IDENTICAL", "Kapsam")]
    with pytest.raises(documents.CorruptDocument):
        compare_files(spark, str(tmp_path / "a.docx"), str(tmp_path / "c.docx"))

    def extract(content):
        if content == b"bad":
            raise IndexError("no such page")
        return [(1, 1000.0, 100.0 * i + 100, 100.0 * i + 150, t, 0) for i, t in enumerate(content.decode().split("|"))]

    rows = [(5, "old", "a.PDF", "Amaç|MADDE 1- Aynı metin.".encode()), (5, "new", "b.pdf", "Amaç|MADDE 1- Aynı metin.".encode()), (6, "old", "a.pdf", b"bad"), (6, "new", "b.pdf", "Amaç|MADDE 1- x.".encode()),
            (7, "old", "a.doc", b"x"), (7, "new", "a.docx", (tmp_path / "a.docx").read_bytes()), (8, "old", "a.pdf", b" "), (8, "new", "a.pdf", "A|MADDE 1- x.".encode())]
    contents = spark.createDataFrame(rows, "pair_id long, side string, name string, content binary")
    c, rejects = compare_contents(contents, extract)
    assert [(r.pair_id, r.change_type) for r in c.rows.collect()] == [(5, "IDENTICAL")]
    assert sorted((r.pair_id, r.side, r.error.split(":")[0]) for r in rejects.collect()) == [(6, "old", "corrupt document"), (7, "old", "unsupported format"), (8, "old", "no text layer")]


def test_cached_vectors_keep_places_and_encode_once(spark, tmp_path):
    texts = spark.createDataFrame([(1, "b"), (2, "aa"), (3, "b"), (4, None)], "id int, text string")
    path = str(tmp_path / "cache")
    first = match.cached_vectors(texts, path, "m", lambda t: [[float(len(x))] for x in t])
    assert sorted((r.id, r.vector) for r in first.collect()) == [(1, [1.0]), (2, [2.0]), (3, [1.0]), (4, None)]
    again = match.cached_vectors(texts, path, "m", lambda t: 1 / 0)  # nothing is left to encode
    assert sorted((r.id, r.vector) for r in again.collect()) == [(1, [1.0]), (2, [2.0]), (3, [1.0]), (4, None)]


def test_regulation_of_fifteen_articles(spark):
    """Counts of the published example: 13 old and 14 new articles, 7 matches by number, 5 by title, 1 removed, 2 added."""
    body = lambda k: f"(1) Bu madde {k} konusundaki usul ve esasları düzenler. (2) İlgili birim {k} işlemlerini yürütür ve sonucu bildirir."
    changed = lambda k: body(k).replace("düzenler", "belirler ve yayımlar")
    old = [(f"Konu {k}", body(k)) for k in range(1, 14)]
    # 1-7 keep their numbers (three are changed), 8 goes, two come after 9, and 9-13 move on
    new = [(t, changed(k) if k in (2, 4, 6) else b) for k, (t, b) in enumerate(old, 1) if k != 8]
    new = new[:7] + [("Geçici görev", body("geçici görev")), ("Portal", body("portal"))] + [(t, changed(12) if t == "Konu 12" else b) for t, b in new[7:]]
    c = compare_units(units(spark, (1, "old", [article(t, i, b) for i, (t, b) in enumerate(old, 1)]), (1, "new", [article(t, i, b) for i, (t, b) in enumerate(new, 1)]))).persist()
    rows = c.brief.collect()
    count = lambda **want: sum(all(r[k] == v for k, v in want.items()) for r in rows)
    assert (len(old), len(new), len(rows)) == (13, 14, 15)
    assert [count(change_type=t) for t in ("IDENTICAL", "MODIFIED", "ADDED", "REMOVED")] == [8, 4, 2, 1]
    assert (count(method="NUMBER_AND_TITLE"), count(method="TITLE_ONLY"), count(method=None)) == (7, 5, 3)
    assert count(renumbered=True, change_type="IDENTICAL") == 4 and count(renumbered=True, change_type="MODIFIED") == 1
