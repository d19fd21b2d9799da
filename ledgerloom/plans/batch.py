"""A batch from a folder of report files to a folder of documents, with a summary of how it went."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators import quality
from ledgerloom.plans.reports import Reports, process_reports
from ledgerloom.sources.reports import Extractor, extract_pages, markdown_documents, pdf_extractor, report_files, split_failures
from ledgerloom.sources.shared import written
from ledgerloom.sources.sinks import report_text, write_documents


@dataclass
class Summary:
    """What a batch did: numbers, and the files that failed."""

    succeeded: int
    with_facts: int
    failures: DataFrame
    failed: int
    reports: Reports | None = field(default=None, repr=False)

    def text(self, shown: int = 20) -> str:
        """For a person to read: all counts, and the first failures by name."""
        lines = [f"Done. {self.succeeded} succeeded, {self.failed} failed."]
        if self.succeeded:
            lines.append(f"  Sources: {self.with_facts} with structured data, {self.succeeded - self.with_facts} from pages only")
        if self.failed:
            lines += ["", "Failures:", *(f"  {r.filing_id}: {r.error}" for r in self.failures.orderBy("filing_id").limit(shown).collect())]
        return "\n".join(lines)


def process_folder(spark: SparkSession, folder: str, out: str, parsed_at: str, facts: DataFrame | None = None, submissions: DataFrame | None = None, generate=None, extractor: Extractor = pdf_extractor) -> Summary:
    """Every report file of a folder, as a markdown file in `out`; a file that fails doesn't stop the others.

    Each file is extracted once.  Files that can't be read and scanned ones count as failed.
    """
    pages, unread = split_failures(written(extract_pages(report_files(spark, folder), extractor)))
    run = process_reports(spark, pages, parsed_at, facts, submissions, generate)
    done = written(write_documents(run.documents, out))
    failures = written(unread.unionByName(run.rejected.select("filing_id", F.col("reason").alias("error"))))
    structured = run.scores.where(F.col("source").startswith("xbrl")).select("filing_id").distinct().join(done, "filing_id", "left_semi")
    return Summary(done.count(), structured.count(), failures, failures.count(), run)


def evaluate_folder(spark: SparkSession, folder: str) -> tuple[str, int]:
    """(report, failed checks) of the documents in a folder."""
    results = written(quality.evaluate(markdown_documents(spark, folder)))
    totals = quality.totals(results)
    return report_text(quality.report(results), totals), int(totals.first().failed)
