"""python -m ledgerloom: a folder of report files to documents, or a report on documents there are."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession


def arguments(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    p.add_argument("folder", help="folder of report files, or of documents with --eval-only")
    p.add_argument("-o", "--output", help="folder of the documents; 'output' in the folder if not given")
    p.add_argument("--facts", help="folder of landed company facts, one JSON file for each filer")
    p.add_argument("--submissions", help="folder of landed submissions, one JSON file for each filer")
    p.add_argument("--eval-only", action="store_true", help="check the documents that are in the folder")
    p.add_argument("--evaluate", action="store_true", help="check the documents after they were made")
    p.add_argument("--report", metavar="PATH", help="write the report of the checks into a file")
    return p.parse_args(args)


def main(args: list[str] | None = None, spark: SparkSession | None = None, **how) -> int:
    """0 if all went well, 1 if a file failed or there was nothing to do."""
    from ledgerloom.operators.facts import facts_long, submissions_long
    from ledgerloom.plans.batch import evaluate_folder, process_folder
    from ledgerloom.sources.reports import json_documents

    a = arguments(args)
    if "://" not in a.folder and not Path(a.folder).is_dir():
        print(f"Error: {a.folder} is not a directory", file=sys.stderr)
        return 1
    if "://" not in a.folder and not any(Path(a.folder).glob("*.md" if a.eval_only else "*.pdf")):
        print(f"Nothing to read in {a.folder}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("ledgerloom").getOrCreate()
    out, code = a.folder if a.eval_only else a.output or f"{a.folder}/output", 0
    if not a.eval_only:
        facts = facts_long(json_documents(spark, a.facts)) if a.facts else None
        submissions = submissions_long(json_documents(spark, a.submissions)) if a.submissions else None
        summary = process_folder(spark, a.folder, out, datetime.now(timezone.utc).isoformat(timespec="seconds"), facts, submissions, **how)
        print(summary.text(), file=sys.stderr)
        code = int(summary.failed > 0)
    if a.eval_only or a.evaluate:
        text, _ = evaluate_folder(spark, out)
        if a.report:
            Path(a.report).write_text(text, encoding="utf-8")
        else:
            print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
