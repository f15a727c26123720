"""Documents of whole files: text pages, and pages of PDF files where a reader for them is installed."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the longest text file that is read; a longer one is rejected with a reason.
MOST_CHARS = 20_000_000


def whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def text_pages(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, sha256, page_num, text, reason) of UTF-8 files; a form feed begins a page.

    A file that is not UTF-8, too long, or without any visible text comes as
    one row with a reason and no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    text = content.decode("utf-8-sig")
                except UnicodeDecodeError:
                    out.append((name, 0, None, "not_utf8"))
                    continue
                if len(text) > MOST_CHARS:
                    out.append((name, 0, None, "too_long"))
                elif not text.strip():
                    out.append((name, 0, None, "no_text"))
                else:
                    out += [(name, i + 1, p, None) for i, p in enumerate(text.split("\f"))]
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "page_num", "text", "reason"])

    files = whole_files(spark, path, pattern)
    pages = files.mapInArrow(run, "path string, page_num int, text string, reason string")
    return pages.join(files.select("path", F.sha2("content", 256).alias("sha256")), "path").select("path", "sha256", "page_num", "text", "reason")


def pdf_pages(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, sha256, page_num, text, reason) of PDF files, read by pypdf where it is installed.

    A file that cannot be read, is encrypted or shows no text is one row with a
    reason and no text; without the reader every file is, with 'no_pdf_reader'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = [(name, 0, None, "no_pdf_reader")]
                if PdfReader is not None:
                    try:
                        book = PdfReader(io.BytesIO(content))
                        shown = [] if book.is_encrypted else [(i + 1, page.extract_text() or "") for i, page in enumerate(book.pages)]
                        out = [(name, n, t, None) for n, t in shown if t.strip()] or [(name, 0, None, "encrypted" if book.is_encrypted else "no_text")]
                    except Exception:  # noqa: BLE001 - a reader may fail on a damaged file in any way; the file is one fault
                        out = [(name, 0, None, "unreadable_pdf")]
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "page_num", "text", "reason"])

    files = whole_files(spark, path, pattern)
    read = files.mapInArrow(run, "path string, page_num int, text string, reason string")
    return read.join(files.select("path", F.sha2("content", 256).alias("sha256")), "path").select("path", "sha256", "page_num", "text", "reason")
