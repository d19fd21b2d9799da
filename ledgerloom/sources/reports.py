"""Sources: report folders, pages, structured facts, rendered documents.

Pages come from Parquet where they have been extracted before, or from PDF files through an extractor.  The extractor is a
parameter, since the PDF library is an optional dependency; it runs on the executors, one file at a time.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions import kernels
from ledgerloom.functions.phrases import FLAGS, phrase

PAGES = "filing_id string, page_number int, text string, tables array<array<array<string>>>"
HINT = FLAGS + "(?:" + "|".join(map(phrase, ("total (assets | equity | liabilities | revenue)", "net (cash | income | loss)", "operating (activities | expenses | income)", "cash and cash equivalents", "balance sheets?", "statements? of (cash flows? | income | operations)"))) + ")"
#: (page text, ruled tables, tables found by text position) of each page of a file.
Extractor = Callable[[bytes], Iterator[tuple[str | None, list, Callable[[], list]]]]


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filing_id, content) of the PDF files directly in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("filing_id"), "content")


def pdf_extractor(content: bytes) -> Iterator[tuple[str | None, list, Callable[[], list]]]:
    """The extractor for the optional PDF library."""
    import pdfplumber

    by_text = {f"{way}_strategy": "text" for way in ("horizontal", "vertical")}
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            yield page.extract_text(), page.extract_tables() or [], lambda page=page: page.extract_tables(by_text) or []


def extract_pages(files: DataFrame, extractor: Extractor = pdf_extractor) -> DataFrame:
    """Pages of report files: text with overprinting undone, cells cleaned; tables by text position where a page that
    speaks of financial data has no ruled ones.  A file that can't be read gives one row with a null page number and the
    error as its text, so that one bad file doesn't stop the others."""
    hint = __import__("re").compile(HINT.removeprefix("(?iu)"), 2)

    def clean(tables: list) -> list:
        return [[[kernels.deinterleave(kernels.collapse_glyphs(c or "")) for c in row] for row in t] for t in tables]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["filing_id"], b["content"]):
                rows = []
                try:
                    for n, (text, ruled, by_text) in enumerate(extractor(content), 1):
                        text = "\n".join(map(kernels.collapse_glyphs, (text or "").split("\n")))
                        rows.append((name, n, text, clean(ruled or (by_text() if hint.search(text) else []))))
                except Exception as e:  # reported as data, for this file alone
                    rows = [(name, None, f"{type(e).__name__}: {e}", None)]
                yield pd.DataFrame(rows, columns=["filing_id", "page_number", "text", "tables"]).astype({"page_number": "Int32"})

    return files.select("filing_id", "content").mapInPandas(run, PAGES)


def split_failures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, (filing_id, error) of the files that couldn't be read)."""
    bad = pages.where("page_number is null").select("filing_id", F.col("text").alias("error"))
    return pages.where("page_number is not null"), bad


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that were extracted before, as Parquet."""
    return spark.read.schema(PAGES).parquet(path)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(filer, json) of landed JSON files; the filer is the digits of the file name.  Fetching them is left to ingestion."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("json"))
    return files.select(F.lpad(F.regexp_extract("name", "([0-9]+)", 1), 10, "0").alias("filer"), "json")


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(filing_id, content) of rendered documents."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return files.select(F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("filing_id"), F.col("value").alias("content"))


def release(*frames: DataFrame) -> None:
    """Give back what was persisted."""
    for f in frames:
        f.unpersist()
