"""Reports of one pair for download: CSV, spreadsheet, HTML page; tables of all pairs are written by Spark.

A report is bytes of one pair's rows, as long as its two documents.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.operators.metrics import detail_table, structural_table, summary_stats, summary_table
from clausediff.operators.render import page_css, rows_html, summary_html


def detail_frame(rows: DataFrame, pair_id: int) -> pd.DataFrame:
    frame = detail_table(rows.where(F.col("pair_id") == pair_id)).orderBy("row_idx").drop("pair_id", "row_idx").toPandas()
    for column in ("Eski Madde No", "Yeni Madde No"):
        frame[column] = frame[column].astype("Int64")
    return frame


def summary_frame(rows: DataFrame, pair_id: int) -> pd.DataFrame:
    table = summary_table(rows.where(F.col("pair_id") == pair_id)).orderBy("label_no")
    return table.select(F.col("label").alias("Değişim Türü"), F.col("n").alias("Sayı"), F.col("pct").alias("Yüzde")).toPandas()


def structural_frame(rows: DataFrame, pair_id: int) -> pd.DataFrame:
    return structural_table(rows.where(F.col("pair_id") == pair_id)).select(F.col("label").alias("Yapısal Değişiklik"), F.col("n").alias("Sayı")).toPandas()


def csv_report(rows: DataFrame, pair_id: int) -> bytes:
    """The detail table as CSV, UTF-8 with a byte order mark."""
    return detail_frame(rows, pair_id).to_csv(index=False).encode("utf-8-sig")


def _column(i: int) -> str:
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def _sheet(frame: pd.DataFrame, active: bool) -> str:
    lines = []
    for r, row in enumerate([frame.columns.tolist(), *frame.itertuples(index=False)], 1):
        cells = []
        for c, value in enumerate(row):
            ref = f"{_column(c)}{r}"
            if value is None or value is pd.NA or value != value:
                continue
            if isinstance(value, str):
                clean = "".join(ch for ch in value if ch >= " " or ch in "\t\n\r")
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{value}</v></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    view = '<sheetViews><sheetView workbookViewId="0"' + (' tabSelected="1"' if active else "") + "/></sheetViews>"
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{view}<sheetData>{"".join(lines)}</sheetData></worksheet>'


def workbook(sheets: dict[str, pd.DataFrame]) -> bytes:
    """A spreadsheet of the sheets in their order; the first is active."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    package = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><bookViews><workbookView activeTab="0"/></bookViews><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for i, frame in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(frame, i == 1))
    return out.getvalue()


def excel_report(rows: DataFrame, pair_id: int) -> bytes:
    return workbook({"Detay": detail_frame(rows, pair_id), "Özet": summary_frame(rows, pair_id), "Yapısal": structural_frame(rows, pair_id)})


def html_pages(rows: DataFrame, diffs: DataFrame, title: str = "Karşılaştırma Raporu") -> DataFrame:
    """(pair_id, html): one stand-alone page per pair; ``diffs`` is the table of ``diff.word_diffs``."""
    bodies = rows_html(rows, diffs).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "html"))).alias("h"))
    summaries = summary_stats(rows).select("pair_id", summary_html().alias("summary"))
    start = f'<!doctype html>\n<html lang="tr">\n<head>\n<meta charset="utf-8">\n<title>{escape(title)}</title>\n<style>\n{page_css()}\n</style>\n</head>\n<body>\n<div class="mk-standalone-page">\n'
    page = F.concat(F.lit(start), F.col("summary"), F.lit("\n"), F.array_join(F.col("h.html"), "\n"), F.lit("\n</div>\n</body>\n</html>\n"))
    return summaries.join(bodies, "pair_id").select("pair_id", page.alias("html"))


def html_report(rows: DataFrame, diffs: DataFrame, pair_id: int) -> bytes:
    one = F.col("pair_id") == pair_id
    return html_pages(rows.where(one), diffs.where(one)).first().html.encode()
