import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import detect as D, lines as X, sections as S

PAGES = "filing_id string, page_number int, text string, tables array<array<array<string>>>"
COMMISSION = "UNITED STATES\nSECURITIES AND EXCHANGE COMMISSION\nWashington, D.C. 20549\nFORM 10-K\n"
STARTS = {
    "cover on 1": ([(1, COMMISSION), (2, "other")], 1),
    "cover later": ([(1, "Dear holders"), (2, "more"), (50, COMMISSION)], 50),
    "registrant": ([(1, "x"), (30, "Birch Ltd\n(Exact name of registrant)\n")], 30),
    "footer": ([(1, "x"), (83, "text\nJPMorgan Chase & Co./2024 Form 10-K 49\n")], 83),
    "none": ([(1, "plain"), (2, "text")], 1),
    "contents": ([(1, "TABLE OF CONTENTS\nFORM 10-K...... 5\nRisk.............. 9\nNotes............ 12\n" + COMMISSION), (5, COMMISSION)], 5),
    "footer on 1": ([(1, "Company Inc./2024 Form 10-K 1\nand"), (7, "x\nCompany Inc./2024 Form 10-K 7\n")], 1),
}


def pages(spark, rows):
    return spark.createDataFrame([(f, n, t, []) for f, n, t in rows], PAGES)


def test_filing_starts(spark):
    df = pages(spark, [(name, n, t) for name, (ps, _) in STARTS.items() for n, t in ps])
    got = {r.filing_id: r.start_page for r in D.filing_start(df).collect()}
    assert got == {name: want for name, (_, want) in STARTS.items()}


def test_report_type_ties_are_domestic(spark):
    df = pages(spark, [("a", 1, "FORM 10-K"), ("a", 2, "IFRS"), ("b", 1, "IFRS Euronext"), *[("c", k, "nothing") for k in range(1, 11)], ("c", 11, "IFRS")])
    assert {r.filing_id: r.report_type for r in D.report_type(df).collect()} == {"a": "sec", "b": "ifrs", "c": "sec"}


def test_scanned_guard_is_strict(spark):
    df = pages(spark, [("four of five", k, "x" * (60 if k == 5 else 1)) for k in range(1, 6)] + [("all", 1, None)])
    assert {r.filing_id: r.scanned for r in D.scanned_guard(df).collect()} == {"four of five": False, "all": True}


@pytest.mark.parametrize("line, want", [
    ("CONSOLIDATED BALANCE SHEETS", True), ("see CONSOLIDATED BALANCE SHEETS", False), ("Consolidated Balance Sheets 12", False), ("CONSOLIDATED BALANCE SHEETS (unaudited)", True),
    ("CONSOLIDATED BALANCE SHEETS as of June", False), ("x" * 130 + " CONSOLIDATED BALANCE SHEETS", False),
])
def test_headings(spark, line, want):
    df = spark.createDataFrame([("text\n" + line + "\nmore",)], "t string")
    hits = df.select(S.headings(S.SEC_SECTIONS, True)("t")).first()[0]
    assert (2 in hits) == want


def test_sections_lose_what_stands_above_their_heading(spark):
    df = pages(spark, [("f", 1, "cover"), ("f", 2, "CONSOLIDATED BALANCE SHEETS\nassets"), ("f", 3, "more assets"), ("f", 4, "lost line\nCONSOLIDATED STATEMENTS OF CASH FLOWS\nflows")])
    got = {r.key: (r.start_page, r.end_page, r.text) for r in S.split_sections(df).collect()}
    assert got == {"balance_sheet": (2, 3, "CONSOLIDATED BALANCE SHEETS\nassets\n\nmore assets"), "cash_flow": (4, 4, "CONSOLIDATED STATEMENTS OF CASH FLOWS\nflows")}
    assert S.cover_pages(df).first().text == "cover"


def test_statements_are_capped_and_ranges_are_in_order(spark):
    df = pages(spark, [("f", 1, "CONSOLIDATED BALANCE SHEETS")] + [("f", k, "page") for k in range(2, 30)] + [("f", 30, "SIGNATURES\nname")])
    got = {r.key: (r.start_page, r.end_page) for r in S.section_ranges(df).collect()}
    assert got == {"balance_sheet": (1, 5), "signatures": (30, 30)}


def test_no_pages_no_sections(spark):
    empty = pages(spark, [])
    assert S.split_sections(empty).count() == S.split_sections(empty, ifrs=True).count() == D.report_type(empty).count() == 0


def texts(spark, column, *inputs):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(inputs)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("t"))).collect()]


def test_split_lines_like_a_reader(spark):
    assert texts(spark, X.split_lines, "a\nb\n", "a\r\nb", "", "\n", None) == [["a", "b"], ["a", "b"], [], [""], None]


def test_clean_prose(spark):
    text = "Business Overview\nWe make things and\nsell them\n12\nItem 1. Business\nF-3\nAcme | 2024 Form 10-K | 3\nrest F-9\nHeader\nHeader\nHeader\n\n\n\nend"
    want = "### Business Overview\nWe make things and sell them\n### Item 1. Business\nrest\n\nend"
    assert texts(spark, X.clean_prose, text, "", None) == [want, "", None]


def test_appended_tables(spark):
    df = spark.createDataFrame([("One.", "| a |"), ("Two.", "none")], "t string, m string")
    assert sorted(r[0] for r in df.select(X.clean_prose(F.col("t"), F.col("m"))).collect()) == ["One.\n\n| a |", "Two."]


def test_exhibits(spark):
    assert texts(spark, X.format_exhibits, "10.1 Agreement\n4\n31.2 Certification", "10.1 Alone\nmore text") == ["- 10.1 Agreement\n- 31.2 Certification", "10.1 Alone more text"]
