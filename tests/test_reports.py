"""Whole runs on small reports, sources, sinks, streams and the driver's entry."""

import json
import subprocess
import sys
import time
import uuid
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.__main__ import main
from ledgerloom.functions.cover import cover_fields
from ledgerloom.operators import quality as Q
from ledgerloom.operators.facts import facts_long, submissions_long
from ledgerloom.plans.reports import process_reports
from ledgerloom.sources import fetch, notes, reports as R, sinks
from ledgerloom.sources.shared import written
from ledgerloom.streaming.reports import process_stream, stream_pages

ROOT = Path(__file__).resolve().parents[1]
COVER = """UNITED STATES
SECURITIES AND EXCHANGE COMMISSION
FORM 10-Q, unaudited
For the quarterly period ended June 30, 2024
Commission File Number: 001-54321
Acme Corp
(Exact name of registrant as its charter has it)
Central Index Key: 0007654321
1,000,000 shares of common stock
Trading Symbol: BRCH
Name of exchange on which registered: NYSE"""
SHEET = [["", "2024", ""], ["Total assets", "$", "1,000"], ["Total liabilities", "", "600"], ["Total stockholders' equity", "", "400"]]


def domestic(name):
    return [
        (name, 1, COVER, []), (name, 2, "CONSOLIDATED BALANCE SHEETS\n(in thousands)\nTotal assets $ 1,000\nTotal liabilities 600", [SHEET]),
        (name, 3, "NOTES TO CONSOLIDATED FINANCIAL STATEMENTS\nNote 1. Basis\nWe keep our books with great care and\nattention to detail.", []),
        (name, 4, "Item 4. CONTROLS AND PROCEDURES\nOur controls work as they should.", []),
    ]


@pytest.fixture(scope="module")
def pages(spark):
    rows = domestic("acme") + [("blank", 1, "", []), ("blank", 2, None, None), ("nordic", 1, "Statement of Financial Position\nprepared under IFRS, in DKK'000, with all that belongs to it and a good deal more than that besides", [[["Assets", "5"], ["Debt", "3"]]])]
    return spark.createDataFrame(rows, R.PAGES)


@pytest.fixture(scope="module")
def run(spark, pages):
    fact = lambda v: [{"end": "2024-06-30", "val": v, "accn": "1-24-7"}]
    facts = json.dumps({"facts": {"us-gaap": {c: {"units": {"USD": fact(v)}} for c, v in (("Assets", 1000), ("Liabilities", 590), ("StockholdersEquity", 300))}}})
    subs = json.dumps({"filings": {"recent": {"form": ["10-Q"], "reportDate": ["2024-06-30"], "accessionNumber": ["1-24-7"]}}})
    doc = lambda text: spark.createDataFrame([("0007654321", text)], "filer string, json string")
    got = process_reports(spark, pages, "2024-07-01", facts_long(doc(facts)), submissions_long(doc(subs)))
    return replace(got, documents=written(got.documents))


def test_cover():
    got = dict(cover_fields(COVER))
    assert {k: got[k] for k in ("Filing Type", "Company", "Period", "Ticker", "CIK", "Exchange")} == dict(zip(("Period", "Exchange", "Company", "CIK", "Ticker", "Filing Type"), ("June 30, 2024", "NYSE", "Acme Corp", "0007654321", "BRCH", "10-Q")))
    assert cover_fields("") == [] and cover_fields("Nothing relevant here") == []


def test_whole_run(run):
    assert [r.filing_id for r in run.rejected.collect()] == ["blank"]
    docs = {r.filing_id: r.content for r in run.documents.collect()}
    assert set(docs) == {"acme", "nordic"}
    acme = docs["acme"]
    for part in ("company: Acme Corp", "period_type: Q2", "filing_sequence: 2", "| Company | Acme Corp |", "We keep our books with great care and attention to detail.", "| BS Balance (Assets vs L+E) | PASS |", "*Section not found in filing.*"):
        assert part in acme
    assert "| Total Liabilities | 590 |" in acme and "balance_sheet: 0.8" in acme  # the structured facts are shown, and disagree
    assert docs["nordic"].startswith("# nordic") and "| Assets | 5 |" in docs["nordic"]
    score = run.scores.first()
    assert (score.source, score.errors) == ("xbrl", 1)


def test_evaluation_of_the_run(run):
    got = written(Q.evaluate(run.documents))
    assert got.count() == 9 * 2
    by = {(r.filing_id, r.check): r.passed for r in got.collect()}
    assert by["acme", "cover_page_fields"] and by["acme", "table_structure_valid"] and not by["acme", "section_completeness"]
    text = sinks.report_text(Q.report(got), Q.totals(got))
    assert "## acme" in text and "**Summary:**" in text


def test_empty_run(spark):
    got = process_reports(spark, spark.createDataFrame([], R.PAGES), "now")
    assert got.documents.count() == got.checks.count() == got.scores.count() == 0


def test_documents_out_and_in(spark, run, tmp_path):
    written = sinks.write_documents(run.documents, str(tmp_path / "md")).collect()
    assert len(written) == 2
    back = {r.filing_id: r.content for r in R.markdown_documents(spark, str(tmp_path / "md")).collect()}
    assert back == {r.filing_id: r.content for r in run.documents.collect()}


def test_pdf_folder_with_one_bad_file(spark, tmp_path):
    for name, data in (("a.pdf", b"good"), ("b.pdf", b"bad"), ("c.txt", b"good")):
        (tmp_path / name).write_bytes(data)

    def extractor(content):
        if content == b"bad":
            raise ValueError("no PDF")
        yield "TToottaall aasssseettss", [], lambda: [[["a", None]]]
        yield None, [[["x", "y"]]], lambda: []

    ok, failed = R.split_failures(R.extract_pages(R.report_files(spark, str(tmp_path)), extractor))
    assert {(r.filing_id, r.page_number): (r.text, r.tables) for r in ok.collect()} == {("a", 1): ("Total assets", [[["a", ""]]]), ("a", 2): ("", [[["x", "y"]]])}
    assert [(r.filing_id, r.error) for r in failed.collect()] == [("b", "ValueError: no PDF")]


def test_command_over_a_folder(spark, tmp_path, capsys):
    """Two good files, a scanned one and a broken one: documents, a summary, the exit code; each file is extracted once."""
    for name in ("acme", "beta", "blank", "broken"):
        (tmp_path / f"{name}.pdf").write_bytes(name.encode())
    calls = tmp_path / "calls"
    calls.mkdir()
    made = {name: domestic(name) for name in ("acme", "beta")} | {"blank": [("blank", 1, "", [])]}

    def extractor(content):
        name = content.decode()
        (calls / f"{name}-{uuid.uuid4().hex}").touch()
        if name == "broken":
            raise ValueError("no PDF")
        for _, _, text, tables in made[name]:
            yield text, tables, lambda: []

    assert main([str(tmp_path), "--evaluate", "--report", str(tmp_path / "report.md")], spark, extractor=extractor) == 1
    assert sorted(p.name for p in (tmp_path / "output").iterdir()) == ["acme.md", "beta.md"]
    said = capsys.readouterr().err
    assert "2 succeeded, 2 failed" in said and "0 with structured data, 2 from pages only" in said and "blank: scanned" in said and "broken: ValueError: no PDF" in said
    assert sorted(p.name.split("-")[0] for p in calls.iterdir()) == ["acme", "beta", "blank", "broken"]
    assert "## acme" in (tmp_path / "report.md").read_text() and main([str(tmp_path / "output"), "--eval-only"], spark) == 0
    assert main([str(tmp_path / "missing")], spark) == main([str(calls)], spark) == 1


def test_names_are_filled_across_the_filings_of_a_run(spark):
    open_sheet = [["", "2024", ""], ["Total assets", "$", "1,000"], ["Holdings of the second kind", "", "600"]]
    rows = domestic("one") + [r if r[1] != 2 else (r[0], 2, r[2], [open_sheet]) for r in domestic("two")]
    got = {(r.filing_id, r.label): r.canonical for r in process_reports(spark, spark.createDataFrame(rows, R.PAGES), "now").mappings.collect()}
    assert got["one", "Total assets"] == got["two", "Total assets"] == "Total Assets" and got["two", "Holdings of the second kind"] == ""


def test_fetch_keeps_its_distance_and_reports_failures(spark):
    FetchError = fetch.FetchError

    def transport(url):
        if "0000000002" in url:
            raise FetchError("404")
        return json.dumps({"url": url, "at": time.time()})

    filers = spark.createDataFrame([("1",), ("1",), (None,), ("2",), ("0000000003",)], "filer string")
    rows = {r.filer: r for r in fetch.fetch(filers, fetch.FACTS, transport, per_second=5).collect()}
    assert set(rows) == {"0000000001", "0000000002", "0000000003"} and rows["0000000002"].error == "FetchError: 404" and rows["0000000002"].json is None
    good = [json.loads(rows[k].json) for k in ("0000000001", "0000000003")]
    assert good[0]["url"].endswith("companyfacts/CIK0000000001.json") and abs(good[0]["at"] - good[1]["at"]) >= 0.19
    with pytest.raises(fetch.FetchError, match="mail address"):
        fetch.http("somebody")


def test_notes_by_a_model(spark):
    df = spark.createDataFrame([("a", "Note 1. One"), ("b", "refuse")], "filing_id string, text string")

    def model(prompt):
        if "refuse" in prompt:
            raise RuntimeError("no answer")
        return "answered"

    assert {r.filing_id: r.content for r in notes.structure_notes(df, model).collect()} == {"a": "answered", "b": "refuse"}


def test_stream_equals_batch(spark, pages, tmp_path):
    for name in ("one", "two"):
        spark.createDataFrame(domestic(name), R.PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    plan = lambda df: process_reports(df.sparkSession, df, "now").documents
    for _ in range(2):  # a second run finds nothing new
        q = process_stream(stream_pages(spark, str(tmp_path / "in"), 1), plan, str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.filing_id for r in out.collect()) == ["one", "two"]
    assert out.where(F.col("content").contains("company: Acme Corp")).count() == 2


def test_entry_without_the_subpackage(tmp_path):
    """The driver deletes the subpackage and its pipeline; everything else must still import."""
    code = f"""
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name == "corpus_pipeline" or name.startswith("ledgerloom.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
assert "balance_check" in e.queries() and "pipeline" not in e.queries() and not any(n.startswith("op") for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "ledgerloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "ledgerloom.llm" not in p.read_text(), p
