"""What a query does for a row is done once, on all cores."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog import reports
from ledgerloom.operators import lines, quality


@pytest.mark.parametrize("check", list(quality.CHECKS))
def test_a_check_cuts_a_text_into_lines_once(spark, sf_dir, check):
    made = quality.CHECKS[check](F.col("md"), F.col("s"), F.col("kind"))
    docs = spark.createDataFrame([], f"md string, s {quality.SECTIONS}, kind string")
    plan = docs.select(made.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 * len(quality.FINANCIAL)  # a text with rare line ends is cut by a pattern


def test_documents_of_a_small_table_are_made_on_all_cores(spark, sf_dir):
    assert reports.faulty(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_rare_line_ends_cut_lines(spark):
    texts = ["a\nb\n", "a\r\nb", "a b\n\nc", "\n", "", "x\x85y\r", " a b "]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(lines.split_lines(F.col("t")).alias("x")).collect()]
    assert got == [["a", "b"], ["a", "b"], ["a", "b", "", "c"], [""], [], ["x", "y"], [" a b "]]


def test_checks_of_a_filing_keep_their_order_whatever_the_keys(spark, tmp_path):
    lines = [(1, 1, 1, 900_000), (1, 1, 2, 5), (1, 1, 10_000_000, 1), (1, 2, 3, 1)]  # order, line, part, supplier
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    (got,) = reports.validation_markdown(spark, str(tmp_path)).collect()
    assert [x.split(" | ")[2].rstrip(" |") for x in got.markdown.split("\n")[2:]] == ["1", "2", "10000000", "3"]


def test_words_that_a_heading_needs_are_in_every_heading():
    import re

    from ledgerloom.functions.phrases import IFRS_SECTIONS, NEEDED, SEC_SECTIONS, heading

    shown = {
        "income_statement": ["Consolidated Statements of Operations", "condensed consolidated statement of earnings and comprehensive loss (loss)"], "comprehensive_income": ["Consolidated Statement of Comprehensive Loss"],
        "balance_sheet": ["Consolidated Balance Sheets", "CONSOLIDATED STATEMENT OF FINANCIAL CONDITION"], "cash_flow": ["Consolidated statements of cash flow"], "stockholders_equity": ["Consolidated Statements of Changes in Equity", "Consolidated statement of Shareholders’ Deficit"],
        "notes": ["Notes to Financial Statements"], "mda": ["Item 7. Managements Discussion and Analysis"], "market_risk": ["Quantitative and Qualitative Disclosure About Market Risk"], "controls": ["Controls and Procedures"], "legal_proceedings": ["Item 3. Legal Proceedings"],
        "risk_factors": ["Item 1A. Risk Factors"], "exhibits": ["Item 15. Exhibits"], "signatures": ["SIGNATURE"], "ifrs_income_statement": ["Statement of Profit or Loss"], "ifrs_equity_changes": ["Statement of Changes in Equity"], "ifrs_cash_flow": ["Interim Statement of Cash Flow"], "ifrs_notes": ["Notes to the Financial Statements"],
    }
    for s in (*SEC_SECTIONS, *IFRS_SECTIONS):
        for text in shown.get(s[0], []):
            assert re.search("(?i)" + heading(s), text) and all(w in text.lower() for w in NEEDED[s[0]])


def test_headings_in_odd_letters_are_found(spark):
    from ledgerloom.functions.phrases import SEC_SECTIONS
    from ledgerloom.operators import detect, sections

    odd = "CONſOLIDATED BALANCE ſHEETſ"  # letters that a pattern without case takes for s
    rows = spark.createDataFrame([("CONSOLIDATED BALANCE SHEETS",), (odd,), ("nothing",), (None,)], "t string").coalesce(1)
    got = rows.select(sections.headings(SEC_SECTIONS, True)("t").alias("h"), detect.is_contents_page(F.col("t")).alias("c")).collect()
    assert [(r.h, r.c) for r in got] == [([2], False), ([2], False), ([], False), ([], None)]


def test_sides_are_read_once_for_all_statements(spark, sf_dir):
    from ledgerloom.catalog import items

    plan = items.three_statements(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_the_type_of_a_report_is_found_once(spark, monkeypatch):
    from ledgerloom.plans import reports as plans

    seen = []
    keep = plans.written
    monkeypatch.setattr(plans, "written", lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df))[1])
    pages = spark.createDataFrame([("a", 1, "UNITED STATES SECURITIES AND EXCHANGE COMMISSION FORM 10-K and more words of no matter at all", None)], "filing_id string, page_number int, text string, tables array<array<array<string>>>")
    assert plans.process_reports(spark, pages, "2024-01-01T00:00:00").documents.count() == 1
    assert sum("Euronext" in p for p in seen) == 1
