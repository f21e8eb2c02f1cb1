"""Documents as units of text, with provenance; files that hold none as rejects.

Files are read by Spark's binaryFile source, whatever store they are in, and
decoded in Arrow batches; a bad file is a row of the result, and strict mode
raises instead.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausediff.functions.text import repetition_key
from clausediff.schema import EXTENSIONS, FOOTER_BAND, HEADER_BAND, MIN_DOCX_CHARS, MIN_PAGE_CHARS, MIN_PAGE_SHARE, MIN_REPETITION

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPHS = "path string, block_index int, text string, style string, error string"
#: What a PDF extractor gives of a file: text blocks and images by page, with their places.
BLOCKS = "doc_id string, page_no int, block_index int, height double, y0 double, y1 double, text string, block_type int"
PAGE_NUMBER = r"(?iuUd)^\s*Sayfa\s+\d+(\s*/\s*\d+)?\s*$"


#: What an archive or its parts raise that are no document: truncated, encrypted, of an unknown method, or no XML.
_BAD = (zipfile.BadZipFile, zlib.error, KeyError, ElementTree.ParseError, OSError, EOFError, RuntimeError, NotImplementedError, ValueError)


class UnsupportedFormat(ValueError):
    pass


class NoTextLayer(ValueError):
    pass


class CorruptDocument(ValueError):
    pass


#: By the beginning of an error's text, the exception that strict callers get.
ERRORS = {"unsupported format": UnsupportedFormat, "no text layer": NoTextLayer, "corrupt document": CorruptDocument}


def require(rejects: DataFrame) -> None:
    """Raises the exception of the first error of ``rejects`` (error), if there is one."""
    if bad := rejects.where("error is not null").orderBy("error").select("error").first():
        raise next(kind for start, kind in ERRORS.items() if bad.error.startswith(start))(bad.error)


def _unsupported(path: Column) -> Column:
    return F.concat(F.lit("unsupported format: "), path, F.lit(f" (supported: {', '.join(EXTENSIONS)})"))


def file_type(path: str = "path"):
    """pdf, docx, or null for any other suffix; letter case does not count."""
    suffix = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1))
    return F.when(suffix.isin(*EXTENSIONS), F.substring(suffix, 2, 10))


def read_files(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, file_type, content, error) of files; the error of an unsupported one names the supported suffixes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").withColumn("file_type", file_type())
    files = files.withColumn("error", F.when(F.col("file_type").isNull(), _unsupported(F.col("path"))))
    if strict:
        require(files)
    return files


def docx_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(text, style) of the body's own paragraphs, not those of tables, headers or footers; blank ones are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    out = []
    for paragraph in body.findall(f"{_W}p") if body is not None else []:
        parts = []
        for run in paragraph.iter(f"{_W}r"):
            for node in run:
                if node.tag == f"{_W}t":
                    parts.append(node.text or "")
                elif node.tag in (f"{_W}br", f"{_W}cr"):
                    parts.append("\n")
                elif node.tag == f"{_W}tab":
                    parts.append("\t")
        text = "".join(parts).strip()
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        if text:
            key = style.get(f"{_W}val") if style is not None else ""
            name = names.get(key, key) or ""
            heading = name[:1].upper() + name[1:]
            out.append((text, heading if heading.startswith("Heading") or heading == "Title" else ""))
    return out


def decode_docx(files: DataFrame) -> DataFrame:
    """(path, block_index, text, style, error): paragraphs of DOCX files; one row with an error for a file that is none."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = docx_paragraphs(content)
                    rows = [(path, i, t, s or None, None) for i, (t, s) in enumerate(found)] or [(path, None, None, None, None)]
                except _BAD:
                    rows = [(path, None, None, None, f"corrupt document: {path}")]
                out = pd.DataFrame(rows, columns=["path", "block_index", "text", "style", "error"])
                yield out.astype({"block_index": "Int32"})

    return files.where("file_type = 'docx'").select("path", "content").mapInPandas(decode, PARAGRAPHS)


def docx_guard(paragraphs: DataFrame) -> DataFrame:
    """(path, chars, error): files whose paragraphs have fewer than 20 characters in all have no text layer."""
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0))
    found = paragraphs.groupBy("path").agg(chars.alias("chars"), F.max("error").alias("error"))
    few = F.concat(F.lit("no text layer: "), F.col("path"))
    return found.select("path", "chars", F.coalesce("error", F.when(F.col("chars") < MIN_DOCX_CHARS, few)).alias("error"))


def pdf_guard(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, share, ok) of (doc_id, page_no, text): at least half of the pages have five characters or more."""
    chars = F.length(F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")))
    share = F.avg((F.col("chars") >= MIN_PAGE_CHARS).cast("double"))
    per_page = pages.groupBy("doc_id", "page_no").agg(F.sum(chars).alias("chars"))
    return per_page.groupBy("doc_id").agg(F.count("*").alias("pages"), share.alias("share")).withColumn("ok", F.col("share") >= MIN_PAGE_SHARE)


def body_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` (BLOCKS) without images, blank blocks, and headers and footers: those in the top or bottom band whose key
    (white space and digits apart) is on 60 % of the pages in that band, or bottom ones that number the page."""
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    text = blocks.where("block_type = 0").withColumn("bare", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("bare <> ''")
    middle = (F.col("y0") + F.col("y1")) / 2
    band = F.when(middle <= F.col("height") * HEADER_BAND, "header").when(middle >= F.col("height") * (1 - FOOTER_BAND), "footer").otherwise("body")
    placed = text.withColumn("band", band).withColumn("key", repetition_key(F.col("text")))
    seen = placed.where("band <> 'body'").groupBy("doc_id", "band", "key").agg(F.countDistinct("page_no").alias("on"))
    joined = placed.join(seen, ["doc_id", "band", "key"], "left").join(pages, "doc_id")
    repeats = F.coalesce(F.col("on") / F.col("pages") >= MIN_REPETITION, F.lit(False))
    numbered = (F.col("band") == "footer") & F.col("bare").rlike(PAGE_NUMBER)
    kept = joined.where((F.col("band") == "body") | ~(repeats | numbered))
    return kept.select(*(c for c in blocks.columns if c != "text"), F.col("bare").alias("text"))


def units_of(blocks: DataFrame, pair_id, side) -> DataFrame:
    """Units of blocks or paragraphs that have doc_id, block_index and text, and page_no if they have pages."""
    page = F.col("page_no").cast("int") if "page_no" in blocks.columns else F.lit(None).cast("int")
    doc = F.col("doc_id") if "doc_id" in blocks.columns else F.col("path")
    return blocks.where("text is not null").select(
        pair_id.cast("long").alias("pair_id"), side.alias("side"), doc.cast("string").alias("doc_id"), page.alias("page_no"), F.col("block_index").cast("int").alias("block_index"),
        F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "text",
    )


def decode_pdf(files: DataFrame, extract: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Blocks of PDF files by a caller's extractor: bytes to (page_no, height, y0, y1, text, block_type); block_index counts over all pages.

    Whatever the extractor raises makes one row with an error of that file.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, p, i, h, y0, y1, t, k, None) for i, (p, h, y0, y1, t, k) in enumerate(extract(content))]
                except Exception as e:  # noqa: BLE001  a caller's function
                    rows = [(path, None, None, None, None, None, None, None, f"corrupt document: {path} ({type(e).__name__})")]
                out = pd.DataFrame(rows, columns=["doc_id", "page_no", "block_index", "height", "y0", "y1", "text", "block_type", "error"])
                yield out.astype({"page_no": "Int32", "block_index": "Int32", "block_type": "Int32"})

    return files.where("file_type = 'pdf'").select("path", "content").mapInPandas(decode, f"{BLOCKS}, error string")


def units_of_contents(contents: DataFrame, extract: Callable[[bytes], list[tuple]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Units, and rejects (pair_id, side, name, error), of files (pair_id, side, name, content).

    A file is read by its name's suffix. PDF needs ``extract`` (see
    ``decode_pdf``); without it PDF files are rejected. Files without a text
    layer, corrupt ones and those of other formats are rejects, and a pair with
    a reject has no units, for it can't be compared.
    """
    files = contents.select("pair_id", "side", "name", F.concat_ws("/", F.col("pair_id").cast("string"), "side", "name").alias("path"), "content").withColumn("file_type", file_type("name"))
    keys = files.select("pair_id", "side", "name", "path")
    readable = ["docx", "pdf"] if extract else ["docx"]
    other = files.where(F.col("file_type").isNull() | ~F.col("file_type").isin(*readable)).select("path", _unsupported(F.col("name")).alias("error"))
    paragraphs = decode_docx(files)
    found = paragraphs.select("path", F.lit(None).cast("int").alias("page_no"), "block_index", "text")
    wrong = other.union(docx_guard(paragraphs).select("path", "error"))
    if extract:
        blocks = decode_pdf(files, extract)
        guard = pdf_guard(blocks.where("error is null").select("doc_id", "page_no", F.when(F.col("block_type") == 0, F.col("text")).alias("text")))
        # a file without pages has no text either
        empty = files.where("file_type = 'pdf'").select("path").join(guard.where("ok").select(F.col("doc_id").alias("path")), "path", "left_anti").join(blocks.where("error is not null").select(F.col("doc_id").alias("path")), "path", "left_anti")
        wrong = wrong.union(blocks.where("error is not null").select(F.col("doc_id").alias("path"), "error")).union(empty.select("path", F.concat(F.lit("no text layer: "), "path")))
        found = found.union(body_blocks(blocks.where("error is null")).select(F.col("doc_id").alias("path"), "page_no", "block_index", "text"))
    rejects = keys.join(wrong.where("error is not null"), "path").select("pair_id", "side", "name", "error")
    sound = found.join(keys, "path").join(rejects.select("pair_id").distinct(), "pair_id", "left_anti")
    return units_of(sound, F.col("pair_id"), F.col("side")), rejects
