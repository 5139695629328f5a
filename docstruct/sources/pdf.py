"""PDF files as spans. A file that fails is a row with ``error_code``; nothing is raised.

The decoder is the built-in one, or PyMuPDF where a caller passes a decoder that uses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.functions.text import basename, normalize_encoding, strip
from docstruct.schema import SETTINGS, Settings
from docstruct.sources.pdffile import Document, PdfError, Span, read

DECODED = "path string, error_code string, error_message string, seq int, text string, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_size double, font_name string, font_flags int, pages int, failed_pages int"
_BOX = pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")])
_DECODED = pa.schema([("path", pa.string()), ("error_code", pa.string()), ("error_message", pa.string()), ("seq", pa.int32()), ("text", pa.string()), ("page_number", pa.int32()), ("bbox", _BOX), ("font_size", pa.float64()), ("font_name", pa.string()), ("font_flags", pa.int32()), ("pages", pa.int32()), ("failed_pages", pa.int32())])
Decoder = Callable[[bytes, int | None, float], tuple[list[Span], int, int]]


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """A file, or the ``*.pdf`` files of a folder, not of folders in it: ``path, length, content``.

    The folder's pattern heeds case; a single file's ending does not.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if path.lower().endswith(".pdf"):
        return reader.load(path)
    return reader.option("pathGlobFilter", "*.pdf").load(path)


def decode_pdfs(files: DataFrame, settings: Settings = SETTINGS, profile: str = "outline", decoder: Decoder = read, seconds: float = 10.0) -> DataFrame:
    """Rows of ``DECODED``: spans, or one row with the error of a file.

    ``profile`` "outline" caps pages and normalises texts; "relevance" takes all pages and only strips. Each span tells how
    many pages its file has and how many of those read failed.
    """
    cap = settings.max_pages if profile == "outline" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    spans, pages, failed = decoder(content.as_py() or b"", cap, seconds)
                    rows = [(path, None, None, k, s.text, s.page, {"x0": s.x0, "y0": s.y0, "x1": s.x1, "y1": s.y1}, max(s.size, 1.0), s.font, s.flags, pages, failed) for k, s in enumerate(spans)]
                except PdfError as e:
                    rows = [(path, e.code, str(e), *[None] * 9)]
                except Exception as e:  # one file's fault is that file's row
                    rows = [(path, "UNEXPECTED_ERROR", f"{type(e).__name__}: {e}", *[None] * 9)]
                if not rows:
                    rows = [(path, "NO_TEXT_EXTRACTED", "no text", *[None] * 9)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _DECODED, strict=True)], schema=_DECODED)

    rows = files.select("path", "content").mapInArrow(run, DECODED)
    text = normalize_encoding(F.col("text")) if profile == "outline" else strip(F.col("text"))
    return rows.withColumn("text", F.when(F.col("error_code").isNull(), text)).where("error_code is not null or text <> ''")


def pdf_spans(decoded: DataFrame) -> DataFrame:
    """Spans keyed by path."""
    return decoded.where("error_code is null").select(F.col("path").alias("doc_id"), "seq", "text", "page_number", "bbox", "font_size", "font_name", "font_flags")


def pdf_errors(decoded: DataFrame, limit: int = 10) -> DataFrame:
    """``path, kind, message, error_code, limit`` of files that failed, for the error outputs."""
    kind = F.when(F.col("error_code") == "PROCESSING_TIMEOUT", "timeout").otherwise("pdf")
    return decoded.where("error_code is not null").select("path", kind.alias("kind"), F.col("error_message").alias("message"), "error_code", F.lit(limit).alias("limit"))


def missing_files(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Asked paths without a file, as errors."""
    rows = asked.join(files.select("path"), "path", "left_anti")
    return rows.select("path", F.lit("pdf").alias("kind"), F.concat(F.lit("PDF file does not exist: "), "path").alias("message"), F.lit("FILE_NOT_FOUND").alias("error_code"), F.lit(10).alias("limit"))


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """A file or a folder's files of no bytes as errors: Spark's file sources leave them out, so the folder is listed."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    asked = there if path.lower().endswith(".pdf") else spark._jvm.org.apache.hadoop.fs.Path(there, "*.pdf")
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(asked)
    rows = [(str(f.getPath()), "pdf", f"PDF file is empty: {f.getPath()}", "EMPTY_FILE", 10) for f in found or [] if not f.getLen()]
    return spark.createDataFrame(rows, "path string, kind string, message string, error_code string, limit int")


def pdf_metadata(files: DataFrame) -> DataFrame:
    """``path, metadata map, page_count, is_encrypted, is_pdf``; the map is empty for a file that can't be opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("page_count", pa.int32()), ("is_encrypted", pa.bool_()), ("is_pdf", pa.bool_())])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    doc = Document(content.as_py() or b"")
                    row = (path, list(doc.metadata().items()), len(doc.pages()), False, True)
                except PdfError as e:
                    row = (path, [], None, e.code == "PASSWORD_PROTECTED", e.code != "OPEN_FAILED" and e.code != "EMPTY_FILE")
                except Exception:  # one file's fault is that file's row
                    row = (path, [], None, False, True)
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, metadata map<string,string>, page_count int, is_encrypted boolean, is_pdf boolean")


def document_name(path):
    return basename(path)
