"""Sinks: one markdown file for each document, and the report of the checks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def write_documents(documents: DataFrame, folder: str) -> DataFrame:
    """Write (filing_id, content) as <filing_id>.md into a folder all executors share; (filing_id, path) of what was written.

    A file is renamed into place, so that a task that runs again leaves one whole file.  Lazy: an action writes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            paths = []
            for name, content in zip(b["filing_id"], b["content"]):
                path = os.path.join(folder, f"{name}.md")
                with open(part := f"{path}.{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
                    f.write(content)
                os.replace(part, path)
                paths.append(path)
            yield pd.DataFrame({"filing_id": b["filing_id"], "path": paths})

    return documents.select("filing_id", "content").mapInPandas(run, "filing_id string, path string")


def report_text(markdown: DataFrame, totals: DataFrame) -> str:
    """The whole report of the checks, for a batch of documents that a person is to read."""
    parts = [r.markdown for r in markdown.orderBy("filing_id").toLocalIterator()]
    t = totals.first()
    return "\n".join(["# Quality Evaluation Report\n", *parts, f"---\n**Summary:** {t.passed} passed, {t.failed} failed\n"])


def single_text(df: DataFrame, col: str, path: str) -> None:
    """One column as text files."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)
