"""PDF scans over Spark's binary file source. A parser is loaded only where a file is read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from leafmark.sources import pdfcount
from leafmark.workers import find_us


def parse_pages(content: bytes) -> list[str]:
    import io

    import pypdf  # optional

    return [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages]


def count_pages(content: bytes, parse: Callable[[bytes], list[str]] = parse_pages) -> int:
    """By the file's tables, without reading a page; a file that they don't tell of is parsed."""
    try:
        return pdfcount.count(content)
    except pdfcount.Broken:
        return len(parse(content))


def read_page_counts(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]] = parse_pages) -> DataFrame:
    """(book, total_pages, status, error) of every file."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((at, count_pages(content, parse), "ok", None))
                except Exception as why:  # one bad file mustn't end the scan; it is reported
                    rows.append((at, 0, "error", str(why)))
            yield pd.DataFrame(rows, columns=["book", "total_pages", "status", "error"])

    find_us(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return found.mapInPandas(counted, "book string, total_pages int, status string, error string")


def read_texts(spark: SparkSession, path: str, max_pages: int | None = None, parse: Callable[[bytes], list[str]] = parse_pages) -> DataFrame:
    """(book, page_index, text, total_pages, status, error): a row for each page; a file
    that fails is one row with status ``error``. ``max_pages`` of 0 or None reads all."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    texts = parse(content)
                    kept = texts[:max_pages] if max_pages else texts
                    yield pd.DataFrame({"book": at, "page_index": range(len(kept)), "text": kept, "total_pages": len(texts), "status": "ok", "error": None})
                except Exception as why:  # one bad file mustn't end the scan; it is reported
                    yield pd.DataFrame({"book": [at], "page_index": [None], "text": [None], "total_pages": [0], "status": ["error"], "error": [str(why)]})

    find_us(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return found.mapInPandas(pages, "book string, page_index int, text string, total_pages int, status string, error string")
