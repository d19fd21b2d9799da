"""Report types, filing starts and sections, over pages made of the documents: a source is a filing, a document a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.catalog.registry import query, table
from ledgerloom.operators import detect as D, sections as S
from ledgerloom.sources.dimensions import section_dim


def pages(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """(filing_id, page_number, text, tables); each page has one table, which names the page."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    return d.selectExpr("coalesce(source, '') AS filing_id", "cast(doc_id AS int) AS page_number", f"{text} AS text", "array(array(array('page', cast(doc_id AS string)))) AS tables")


def duck_pages(text: str) -> str:
    return f"p AS (SELECT coalesce(source, '') AS filing_id, CAST(doc_id AS INTEGER) AS page_number, {text} AS text, text AS bare FROM documents WHERE doc_id IS NOT NULL)"


BODY = "coalesce(text, '')"
SPARSE = "avg(CASE WHEN length(regexp_replace({t}, '^\\s+|\\s+$', '', 'g')) < 50 THEN 1.0 ELSE 0.0 END)".format(t=BODY)


@query(f"""
WITH {duck_pages(BODY)}, g AS (SELECT filing_id, {SPARSE.replace(BODY, "text")} AS share FROM p GROUP BY filing_id)
SELECT filing_id, round(share, 6) AS sparse_share, share > 0.8 AS scanned FROM g""")
def scanned_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of next to empty pages of each filing."""
    return D.scanned_guard(pages(spark, sf_dir, BODY)).select("filing_id", F.round("sparse_share", 6).alias("sparse_share"), "scanned")


MARKS = """CASE doc_id % 7 WHEN 0 THEN 'ANNUAL REPORT ON FORM 10-K' WHEN 1 THEN 'prepared under IFRS as adopted' WHEN 2 THEN 'Statement of Financial Position' WHEN 3 THEN 'Central Index Key'
      WHEN 4 THEN 'listed on Euronext' WHEN 5 THEN 'Statement of Profit or Loss' ELSE 'SECURITIES AND EXCHANGE COMMISSION' END || chr(10) || coalesce(text, '')"""


@query(f"""
WITH {duck_pages(MARKS)}, f AS (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY page_number) AS n FROM p),
g AS (SELECT filing_id, count(DISTINCT page_number % 7) FILTER (page_number % 7 IN (0, 3, 6)) AS sec, count(DISTINCT page_number % 7) FILTER (page_number % 7 IN (1, 2, 4, 5)) AS ifrs FROM f WHERE n <= 10 GROUP BY filing_id)
SELECT filing_id, CAST(sec AS INTEGER) AS sec_marks, CAST(ifrs AS INTEGER) AS ifrs_marks, CASE WHEN ifrs > sec THEN 'ifrs' ELSE 'sec' END AS report_type FROM g""")
def report_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domestic or international, by the marks on the first ten pages."""
    return D.report_type(pages(spark, sf_dir, MARKS))


COVER = """CASE WHEN doc_id % 23 = 4 THEN 'TABLE OF CONTENTS' || chr(10) || 'FORM 10-K.......... 5' || chr(10) || 'UNITED STATES SECURITIES AND EXCHANGE COMMISSION...... 6' || chr(10) || 'Exhibits...... 7' || chr(10)
    WHEN doc_id % 23 = 9 AND source LIKE '%1%' THEN 'UNITED STATES' || chr(10) || 'SECURITIES AND EXCHANGE COMMISSION' || chr(10) || 'FORM 10-K' || chr(10)
    WHEN doc_id % 23 = 11 AND source LIKE '%2%' THEN 'Acme Inc.' || chr(10) || '(Exact name of registrant as specified in its charter)' || chr(10)
    WHEN doc_id % 23 = 13 THEN 'some page' || chr(10) || 'Acme & Co./2024 Form 10-K 49' || chr(10) ELSE '' END || coalesce(text, '')"""


@query(f"""
WITH {duck_pages(COVER)}, g AS (SELECT filing_id, min(page_number) FILTER ((page_number % 23 = 9 AND filing_id LIKE '%1%') OR (page_number % 23 = 11 AND filing_id LIKE '%2%')) AS cover, min(page_number) FILTER (page_number % 23 = 13) AS footer FROM p GROUP BY filing_id)
SELECT filing_id, CASE WHEN cover IS NOT NULL THEN cover WHEN footer > 1 THEN footer ELSE 1 END AS start_page FROM g""")
def filing_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the filing proper begins."""
    return D.filing_start(pages(spark, sf_dir, COVER))


@query(f"""
WITH {duck_pages(COVER)}, g AS (SELECT filing_id, min(page_number) FILTER ((page_number % 23 = 9 AND filing_id LIKE '%1%') OR (page_number % 23 = 11 AND filing_id LIKE '%2%')) AS cover, min(page_number) FILTER (page_number % 23 = 13) AS footer FROM p GROUP BY filing_id),
s AS (SELECT filing_id, CASE WHEN cover IS NOT NULL THEN cover WHEN footer > 1 THEN footer ELSE 1 END AS start_page FROM g)
SELECT filing_id, left(string_agg(text, chr(10) ORDER BY page_number), 5000) AS prefix_text FROM p JOIN s USING (filing_id) WHERE page_number < start_page GROUP BY filing_id""")
def filing_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the filing in a combined report."""
    return D.drop_prefix(pages(spark, sf_dir, COVER))[1]


CONTENTS = """CASE c_custkey % 8 WHEN 0 THEN 'Table of Contents' || chr(10) || 'Balance Sheets ..... 4' || chr(10) || 'Cash Flows ..... 5' || chr(10) || 'Notes ..... 6'
    WHEN 1 THEN 'TABLE OF CONTENTS' || chr(10) || '3 Overview' || chr(10) || '4 Results' || chr(10) || '5 Notes' || chr(10) || '6 Risk' || chr(10) || '7 Signatures'
    WHEN 2 THEN 'TABLE OF CONTENTS' || chr(10) || 'Sheets 4' || chr(10) || 'Flows 5' || chr(10) || 'Notes 6' || chr(10) || 'Total assets $ 1,000'
    WHEN 3 THEN 'CONSOLIDATED BALANCE SHEETS, CONSOLIDATED STATEMENTS OF CASH FLOWS, CONTROLS AND PROCEDURES, Item 1A. RISK FACTORS'
    WHEN 4 THEN 'CONSOLIDATED BALANCE SHEETS and CONTROLS AND PROCEDURES' WHEN 5 THEN 'TABLE OF CONTENTS' || chr(10) || 'one 1' WHEN 6 THEN 'Total current assets of 5' ELSE c_name END"""


@query("""
SELECT c_custkey, c_custkey % 8 = 0 AS listing, c_custkey % 8 IN (0, 1, 3) AS contents_page FROM customer""")
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents, as the two searches know them."""
    t = F.col("t")
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{CONTENTS} AS t")
    return c.select("c_custkey", D.is_contents_listing(t).alias("listing"), D.is_contents_page(t).alias("contents_page"))


HEADINGS = """CASE c_custkey % 9 WHEN 0 THEN 'intro' || chr(10) || 'CONSOLIDATED BALANCE SHEETS' WHEN 1 THEN 'see the CONSOLIDATED BALANCE SHEETS' WHEN 2 THEN 'Consolidated Balance Sheets, as above' WHEN 3 THEN 'CONSOLIDATED BALANCE SHEETS 41'
    WHEN 4 THEN '  CONDENSED CONSOLIDATED BALANCE SHEETS (unaudited)' WHEN 5 THEN 'Consolidated Balance Sheets at year end' WHEN 6 THEN 'The CONSOLIDATED BALANCE SHEETS' WHEN 7 THEN 'CONSOLIDATED BALANCE SHEETS DATA OVERVIEW' ELSE c_name END"""


@query("SELECT c_custkey, c_custkey % 9 IN (0, 4) AS heading FROM customer")
def heading_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page holds the balance sheet's heading, and not a mention of it."""
    hits = S.headings(S.SEC_SECTIONS, True)("t")
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{HEADINGS} AS t").select("c_custkey", F.array_contains(hits, 2).alias("heading"))


#: doc_id % 31 -> (place in the order of sections, key, heading, cap of pages)
HEADED = {
    3: (0, "income_statement", "CONSOLIDATED STATEMENTS OF INCOME", 5), 5: (2, "balance_sheet", "CONSOLIDATED BALANCE SHEETS", 5), 7: (3, "cash_flow", "CONSOLIDATED STATEMENTS OF CASH FLOWS", 5),
    11: (5, "notes", "NOTES TO CONSOLIDATED FINANCIAL STATEMENTS", None), 13: (6, "mda", "Item 2. MANAGEMENT''S DISCUSSION AND ANALYSIS", None), 17: (10, "risk_factors", "Item 1A. RISK FACTORS", 25),
    19: (8, "controls", "Item 4. CONTROLS AND PROCEDURES", None), 29: (12, "signatures", "SIGNATURES", None),
}
HEADED_PAGE = "'top of page' || chr(10) || CASE doc_id % 31 " + " ".join(f"WHEN {m} THEN '{h}' || chr(10)" for m, (_, _, h, _) in HEADED.items()) + " ELSE '' END || coalesce(text, '')"
DIM = "k(m, ord, key, cap) AS (VALUES " + ", ".join(f"({m}, {o}, '{k}', {c or 'NULL'})" for m, (o, k, _, c) in HEADED.items()) + ")"
STARTS = f"""{duck_pages(HEADED_PAGE)}, {DIM},
h AS (SELECT filing_id, key, ord, cap, page_number FROM p JOIN k ON page_number % 31 = m),
a AS (SELECT filing_id, key, ord, cap, min(page_number) AS start_page FROM h GROUP BY ALL),
l AS (SELECT filing_id, max(page_number) AS last_page FROM p GROUP BY filing_id),
b AS (SELECT a.*, last_page, coalesce(lead(start_page) OVER (PARTITION BY a.filing_id ORDER BY start_page, ord), last_page + 1) AS next_page FROM a JOIN l USING (filing_id)),
c AS (SELECT *, CASE WHEN key = 'mda' AND next_page - start_page <= 1 THEN (SELECT min(h.page_number) FROM h WHERE h.filing_id = b.filing_id AND h.key = 'mda' AND h.page_number > b.start_page) END AS later FROM b),
s AS (SELECT filing_id, key, cap, last_page, CASE WHEN later IS NULL THEN ord ELSE -1 END AS ord, coalesce(later, start_page) AS start_page FROM c)"""
RANGES = f"""{STARTS},
o AS (SELECT *, row_number() OVER w - 1 AS i, lead(start_page) OVER w AS next_start FROM s WINDOW w AS (PARTITION BY filing_id ORDER BY start_page, ord)),
e AS (SELECT *, CASE WHEN next_start IS NULL THEN last_page ELSE greatest(start_page, next_start - 1) END AS raw_end FROM o),
r AS (SELECT filing_id, key, i, start_page, CASE WHEN raw_end - start_page >= cap THEN start_page + cap - 1 ELSE raw_end END AS end_page FROM e)"""


@query(f"WITH {STARTS} SELECT filing_id, key, CAST(start_page AS INTEGER) AS start_page FROM s")
def section_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of every section of every filing."""
    return S.section_starts(pages(spark, sf_dir, HEADED_PAGE)).select("filing_id", "key", "start_page")


@query(f"WITH {RANGES} SELECT filing_id, key, CAST(i AS INTEGER) AS i, CAST(start_page AS INTEGER) AS start_page, CAST(end_page AS INTEGER) AS end_page FROM r")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of every section."""
    return S.section_ranges(pages(spark, sf_dir, HEADED_PAGE)).select("filing_id", "key", "i", "start_page", "end_page")


@query(f"""
WITH {RANGES},
t AS (SELECT r.filing_id, key, r.start_page, end_page, page_number, CASE WHEN page_number = r.start_page AND i > 0 THEN text[length('top of page') + 2:] ELSE text END AS part
  FROM r JOIN p ON p.filing_id = r.filing_id AND page_number BETWEEN r.start_page AND end_page)
SELECT filing_id, key, CAST(start_page AS INTEGER) AS start_page, CAST(end_page AS INTEGER) AS end_page, string_agg(part, chr(10) || chr(10) ORDER BY page_number) AS text, count(*) AS n_tables
FROM t GROUP BY filing_id, key, start_page, end_page""")
def section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text and the tables of every section."""
    return S.split_sections(pages(spark, sf_dir, HEADED_PAGE)).select("filing_id", "key", "start_page", "end_page", "text", F.size("tables").cast("bigint").alias("n_tables"))


@query(f"""
WITH {STARTS}, f AS (SELECT filing_id, min(start_page) AS first_page FROM s GROUP BY filing_id)
SELECT filing_id, CAST(min(page_number) AS INTEGER) AS start_page, CAST(any_value(first_page) - 1 AS INTEGER) AS end_page, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text
FROM p JOIN f USING (filing_id) WHERE page_number < first_page GROUP BY filing_id""")
def cover_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before a filing's first section."""
    return S.cover_pages(pages(spark, sf_dir, HEADED_PAGE)).select("filing_id", "start_page", "end_page", "text")


ABROAD = {3: (0, "ifrs_income_statement", "Consolidated Statement of Profit or Loss"), 7: (1, "ifrs_balance_sheet", "Interim Condensed Consolidated Balance Sheet"), 11: (2, "ifrs_equity_changes", "Statement of Changes in Equity"), 13: (3, "ifrs_cash_flow", "Consolidated Statement of Cash Flows"), 17: (4, "ifrs_notes", "Notes to the Consolidated Financial Statements")}
ABROAD_PAGE = "CASE WHEN doc_id % 37 = 29 THEN 'Parent Company' || chr(10) ELSE '' END || CASE doc_id % 31 " + " ".join(f"WHEN {m} THEN '{h}' || chr(10)" for m, (_, _, h) in ABROAD.items()) + " ELSE '' END || coalesce(text, '')"
ABROAD_DIM = "k(m, ord, key) AS (VALUES " + ", ".join(f"({m}, {o}, '{k}')" for m, (o, k, _) in ABROAD.items()) + ")"
ABROAD_RANGES = f"""{duck_pages(ABROAD_PAGE)}, {ABROAD_DIM},
q AS (SELECT *, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 100 AS divider FROM p),
a AS (SELECT filing_id, key, ord, min(page_number) AS start_page FROM q JOIN k ON page_number % 31 = m WHERE NOT divider AND page_number % 37 <> 29 GROUP BY ALL),
l AS (SELECT filing_id, max(page_number) AS last_page FROM p GROUP BY filing_id),
o AS (SELECT a.*, last_page, lead(start_page) OVER w AS next_start FROM a JOIN l USING (filing_id) WINDOW w AS (PARTITION BY a.filing_id ORDER BY start_page, ord)),
r AS (SELECT filing_id, key, start_page, CASE WHEN next_start IS NOT NULL THEN greatest(start_page, next_start - 1)
  ELSE coalesce((SELECT min(p.page_number) - 1 FROM p WHERE p.filing_id = o.filing_id AND p.page_number % 37 = 29 AND p.page_number > o.start_page), last_page) END AS end_page FROM o)"""


@query(f"""
WITH {ABROAD_RANGES}
SELECT r.filing_id, key, CAST(start_page AS INTEGER) AS start_page, CAST(end_page AS INTEGER) AS end_page, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text
FROM r JOIN q ON q.filing_id = r.filing_id AND page_number BETWEEN start_page AND end_page AND (page_number = start_page OR NOT divider)
GROUP BY r.filing_id, key, start_page, end_page""")
def ifrs_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of international reports: no caps, divider pages skipped, ended by the parent company's pages."""
    return S.split_sections(pages(spark, sf_dir, ABROAD_PAGE), ifrs=True).select("filing_id", "key", "start_page", "end_page", "text")


@query("""
SELECT * FROM (VALUES ('sec', 14, 5, 6, 14), ('ifrs', 5, 5, 0, 5)) AS t(report_type, n_sections, n_required, n_capped, last_place)""")
def section_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered sections of each type of report."""
    n = lambda c: F.count_if(c).cast("int")
    return section_dim(spark).groupBy("report_type").agg(F.count("*").cast("int").alias("n_sections"), n(F.col("required")).alias("n_required"), n(F.col("cap").isNotNull()).alias("n_capped"), F.max("out_ord").alias("last_place"))
