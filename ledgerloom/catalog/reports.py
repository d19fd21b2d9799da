"""Cover fields, front matter, documents and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.catalog.items import with_sides
from ledgerloom.catalog.registry import iso_date, query, spread, table, words_date
from ledgerloom.operators import metadata as M, quality as Q, render as R, validate as V
from ledgerloom.plans.reports import process_reports
from ledgerloom.sources.dimensions import section_dim

NL = "chr(10)"


def cover(duck: bool = False) -> str:
    """The cover of each order's filing; some lack a line."""
    date = words_date("o_orderdate", duck)
    year = "CAST(year(o_orderdate) AS varchar(10))"
    return f"""'UNITED STATES' || {NL} || 'SECURITIES AND EXCHANGE COMMISSION' || {NL} || 'FORM ' || CASE o_orderkey % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-k/a' ELSE '10-Q' END || {NL}
      || CASE WHEN o_orderkey % 3 = 2 THEN 'For the quarterly period ended ' ELSE 'For the fiscal year ended ' END || {date} || {NL} || 'Commission File Number: 001-' || lpad(CAST(o_custkey AS varchar(20)), 5, '0') || {NL}
      || 'Holdings ' || CAST(o_custkey AS varchar(20)) || ' Corp' || {NL} || '(Exact name of registrant as specified in its charter)' || {NL}
      || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Central Index Key: ' || lpad(CAST(o_custkey AS varchar(20)), 10, '0') || {NL} END
      || CASE WHEN o_orderkey % 2 = 0 THEN 'Trading Symbol: ACME' || {NL} ELSE '' END || '1,' || lpad(CAST(o_custkey % 1000 AS varchar(10)), 3, '0') || ' shares of common stock' || {NL} || 'in ' || {year}"""


FIELDS = f"""c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN '10-Q' WHEN o_orderkey % 3 = 0 THEN '10-K' ELSE '10-K/A' END AS form, 'Holdings ' || o_custkey || ' Corp' AS company, {words_date('o_orderdate', True)} AS period,
  '001-' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS commission, CASE WHEN o_orderkey % 5 <> 0 THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS cik, '1,' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS shares,
  CASE WHEN o_orderkey % 2 = 0 THEN 'ACME' END AS ticker, month(o_orderdate) AS m, year(o_orderdate) AS y, {iso_date('o_orderdate', True)} AS iso FROM orders)"""


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").selectExpr("o_orderkey", f"{cover()} AS t")


@query(f"""
WITH {FIELDS} SELECT o_orderkey, 'Filing Type=' || form || ';Company=' || company || ';Period=' || period || ';Commission File Number=' || commission || CASE WHEN cik IS NULL THEN '' ELSE ';CIK=' || cik END || ';Shares Outstanding=' || shares || CASE WHEN ticker IS NULL THEN '' ELSE ';Ticker=' || ticker END AS fields FROM c""")
def cover_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of every cover, in their order."""
    pairs = F.transform(M.cover_fields("t"), lambda f: F.concat(f["label"], F.lit("="), f["value"]))
    return covers(spark, sf_dir).select("o_orderkey", F.array_join(pairs, ";").alias("fields"))


@query(f"""
WITH {FIELDS} SELECT o_orderkey, '| Field | Value |' || {NL} || '|' || repeat('-------|', 2) || {NL} || concat_ws({NL}, '| Filing Type | ' || form || ' |', '| Company | ' || company || ' |', '| Period | ' || period || ' |', '| Commission File Number | ' || commission || ' |',
  '| CIK | ' || cik || ' |', '| Shares Outstanding | ' || shares || ' |', '| Ticker | ' || ticker || ' |') AS markdown FROM c""")
def cover_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers(spark, sf_dir).select("o_orderkey", M.cover_table(M.cover_fields("t"), F.col("t")).alias("markdown"))


def metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.when(F.col("o_orderkey") % 4 == 0, "(in thousands)").when(F.col("o_orderkey") % 4 == 1, "in millions")
    f = covers(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("filing_id"), M.cover_fields("t").alias("fields"), hint.alias("scale_hint"), F.col("t").alias("cover_text"), F.concat(F.col("o_orderkey"), F.lit(".pdf")).alias("source_pdf"))
    return M.metadata(f, "2024-01-01T00:00:00")


#: The cover names the end of the fiscal year, which is the period's own month, or (of a quarter) doesn't.
METAS = f"""{FIELDS}, m AS (SELECT CAST(o_orderkey AS VARCHAR) AS filing_id, *, CASE WHEN form = '10-Q' THEN CASE m WHEN 3 THEN 'Q1' WHEN 6 THEN 'Q2' WHEN 9 THEN 'Q3' ELSE 'Q?' END ELSE 'FY' END AS period_type,
  CASE o_orderkey % 4 WHEN 0 THEN 'thousands' WHEN 1 THEN 'millions' ELSE 'units' END AS scale FROM c)"""


@query(f"""WITH {METAS} SELECT filing_id, company, coalesce(ticker, '') AS ticker, coalesce(cik, '') AS cik, form AS filing_type, iso AS period_end, period_type, CAST(y AS INTEGER) AS fiscal_year, scale, form <> '10-Q' AS audited FROM m""")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front matter of every filing as columns."""
    return metas(spark, sf_dir).select("filing_id", *[f"meta.{k}" for k in ("company", "ticker", "cik", "filing_type", "period_end", "period_type", "fiscal_year", "scale", "audited")])


@query(f"""WITH {METAS} SELECT filing_id, '---' || {NL} || concat_ws({NL}, 'company: ' || company, 'ticker: ' || coalesce(ticker, ''), 'cik: ' || coalesce(cik, ''), 'commission_file_number: ' || commission, 'filing_type: ' || form, 'period_end: ' || iso,
  'period_type: ' || CASE WHEN period_type = 'Q?' THEN '"Q?"' ELSE period_type END, 'fiscal_year: ' || y, 'scale: ' || scale, 'currency: USD', 'audited: ' || CASE WHEN form <> '10-Q' THEN 'true' ELSE 'false' END, 'source_pdf: ' || filing_id || '.pdf',
  'parsed_at: "2024-01-01T00:00:00"', 'filing_sequence: ' || length(filing_id), 'confidence:' || {NL} || '  balance_sheet: 0.7') || {NL} || '---' || {NL} AS yaml FROM m""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front matter of every filing as YAML."""
    nested = {"data_sources": F.create_map().cast("map<string,string>"), "confidence": F.create_map(F.lit("balance_sheet"), F.lit("0.7"))}
    return metas(spark, sf_dir).select("filing_id", M.front_matter(F.col("meta"), F.length("filing_id"), nested).alias("yaml"))


@query(f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '---' || {NL} || 'company: x' || {NL} || 'filing_sequence: 7' || {NL} || '---' || {NL} || c_name WHEN 1 THEN '---' || {NL} || 'company: x' || {NL} || 'filing_sequence: 7' || {NL} || 'scale: units' || {NL} || '---' || {NL} || c_name ELSE c_name END AS content FROM customer""")
def update_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered documents given their place in the sequence: added, replaced, and left alone without front matter."""
    t = f"CASE c_custkey % 3 WHEN 0 THEN '---' || {NL} || 'company: x' || {NL} || '---' || {NL} || c_name WHEN 1 THEN '---' || {NL} || 'company: x' || {NL} || 'filing_sequence: 3' || {NL} || 'scale: units' || {NL} || '---' || {NL} || c_name ELSE c_name END AS t"
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", t).select("c_custkey", M.update_sequence(F.col("t"), F.lit(7)).alias("content"))


@query(f"""
WITH p AS (SELECT *, row_number() OVER () AS one FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT n_name AS filing_id, 'YAML' || {NL} || '# ' || n_name || {NL} || {NL} || '## Consolidated Balance Sheets' || {NL} || {NL} || CASE WHEN n_nationkey % 2 = 0 THEN '| ' || r_name || ' |' ELSE '*Section not found in filing.*' END || {NL} || {NL}
  || '## Consolidated Statements of Income' || {NL} || {NL} || 'body of ' || n_name || {NL} || {NL} || '## Consolidated Statements of Cash Flows' || {NL} || {NL} || '*Section not found in filing.*' || {NL} || {NL}
  || '## Consolidated Statements of Stockholders'' Equity' || {NL} || {NL} || '*Section not found in filing.*' || {NL} || {NL} || '## Notes to Financial Statements' || {NL} || {NL} || '*Section not found in filing.*' || {NL}
  || CASE WHEN n_nationkey % 3 = 0 THEN {NL} || '## Validation' || {NL} || {NL} || 'all fine' || {NL} ELSE '' END || {NL} AS content FROM p""")
def assemble_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from their sections: a repeated title goes, a required section that is missing shows a placeholder."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.expr("r_regionkey = n_regionkey"))
    filings = n.selectExpr("n_name AS filing_id", "'sec' AS report_type", "n_name AS stem", "'YAML' AS front_matter", "CASE WHEN n_nationkey % 3 = 0 THEN 'all fine' END AS validation", "cast(null AS string) AS confidence")
    sheets = n.where("n_nationkey % 2 = 0").selectExpr("n_name AS filing_id", "'balance_sheet' AS key", "'## Consolidated Balance Sheets\n\n| ' || r_name || ' |' AS content")
    income = n.selectExpr("n_name AS filing_id", "'income_statement' AS key", "'body of ' || n_name AS content")
    return R.assemble(filings, sheets.union(income), section_dim(spark))


CHECK_RULE = "|" + "|".join(":" + "-" * n for n in (6, 7, 7)) + "|"


@query(f"""
SELECT CAST(l_orderkey AS VARCHAR) AS filing_id, '| Check | Status | Detail |' || chr(10) || '{CHECK_RULE}' || chr(10) || string_agg('| Check ' || l_linenumber || ' | PASS | ' || l_partkey || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS markdown
FROM lineitem GROUP BY l_orderkey""")
def validation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check results as tables."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey AS string) AS filing_id", "struct(l_linenumber, l_partkey, l_suppkey) AS pos", "'Check ' || l_linenumber AS check", "'PASS' AS status", "cast(l_partkey AS string) AS detail")
    return V.render_checks(rows)


# checks of documents: a rendered document for each order, with faults that depend on its key

TABLE = "'| | 2024 |' || chr(10) || '| :--- | ---: |' || chr(10) || '| a | 1 |' || chr(10) || '| b | 2 |' || chr(10) || '| c | 3 |' || chr(10) || CASE WHEN k % 4 = 0 THEN '' ELSE '| d | 4 |' || chr(10) || '| e | 5 |' || chr(10) END"
TITLES = tuple(f"Consolidated {x}" for x in ("Balance Sheets", *(f"Statements of {y}" for y in ("Income", "Cash Flows", "Stockholders'' Equity"))))
LONG = "'" + "words that go on for quite a while " * 7 + "'"
FAULTY = f"""'# doc' || chr(10) || '## Cover Page' || chr(10) || '| Filing Type | ' || CASE WHEN k % 2 = 0 THEN '10-K' ELSE '10-Q' END || ' |' || chr(10) || CASE WHEN k % 3 = 0 THEN '' ELSE '| Company | x |' || chr(10) END || '| Period | June |' || chr(10)
  || '## {TITLES[0]}' || chr(10) || {TABLE} || '## {TITLES[1]}' || chr(10) || CASE WHEN k % 5 = 0 THEN 'no table in here at all' || chr(10) ELSE {TABLE} END || CASE WHEN k % 7 = 0 THEN '' ELSE '## {TITLES[2]}' || chr(10) || {TABLE} END
  || '## {TITLES[3]}' || chr(10) || {TABLE} || CASE WHEN k % 11 = 0 THEN '| too | many | bars |' || chr(10) ELSE '' END || '## Notes to Financial Statements' || chr(10) || CASE WHEN k % 13 = 0 THEN {LONG} ELSE '### One' || chr(10) || {LONG} END || chr(10)
  || '## Management''s Discussion and Analysis' || chr(10) || CASE WHEN k % 6 = 0 THEN 'short' ELSE '### Two' || chr(10) || {LONG} END || chr(10) || CASE WHEN k % 8 = 0 THEN ' 12 ' || chr(10) || '345' || chr(10) ELSE '' END
  || '## Risk Factors' || chr(10) || 'Not Applicable' || chr(10) || CASE WHEN k % 9 = 0 THEN 'table of contents Table of Contents TABLE OF CONTENTS' ELSE 'F-1 F-2 Form F-3 F-4' END"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").selectExpr("o_orderkey AS k").selectExpr("cast(k AS string) AS filing_id", f"{FAULTY} AS content")


def one_check(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.evaluate(faulty(spark, sf_dir), checks=[name]).select("filing_id", "passed", "message")

    run.__name__ = f"q_{name}"
    run.__doc__ = f"The check {name} on a document for each order."
    return run


K = "WITH d AS (SELECT o_orderkey AS k FROM orders) SELECT CAST(k AS VARCHAR) AS filing_id, {passed} AS passed, {message} AS message FROM d"
ROWS = "(CASE WHEN k % 4 = 0 THEN 4 - CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END - CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END - CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END ELSE 0 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END)"
N_EXPECTED = "(CASE WHEN k % 2 = 0 THEN 8 ELSE 7 END)"
EXPECT = {
    "section_completeness": ("k % 7 <> 0", f"({N_EXPECTED} - CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) || '/' || {N_EXPECTED} || ' expected sections found'"),
    "financial_tables_formatted": ("k % 5 <> 0", "CASE WHEN k % 5 <> 0 THEN 'All present financial sections have markdown tables' ELSE '1 section(s) lack tables' END"),
    "no_stray_page_numbers": ("k % 8 <> 0", "CASE WHEN k % 8 <> 0 THEN 'No stray page numbers' ELSE '2 stray page number(s)' END"),
    "table_structure_valid": ("k % 11 <> 0", "CASE WHEN k % 11 <> 0 THEN 'All tables have consistent column counts' ELSE '1 column count mismatch(es)' END"),
    "no_empty_sections": ("k % 6 <> 0", "CASE WHEN k % 6 <> 0 THEN 'All sections have content' ELSE '1 empty section(s)' END"),
    "prose_quality": ("k % 13 <> 0", "CASE WHEN k % 13 <> 0 THEN 'Prose sections have good structure' ELSE '1 prose quality issue(s)' END"),
    "cover_page_fields": ("k % 3 <> 0", "CASE WHEN k % 3 <> 0 THEN 'Cover Page has all required fields' ELSE 'Missing: Company' END"),
    "table_density": (f"{ROWS} = 0", f"CASE WHEN {ROWS} = 0 THEN 'Financial sections have sufficient data rows' ELSE {ROWS} || ' sparse section(s)' END"),
    "no_pdf_artifacts": ("k % 9 <> 0", "CASE WHEN k % 9 <> 0 THEN 'No PDF artifacts detected' ELSE '1 artifact type(s) found' END"),
}
for _name, (_passed, _message) in EXPECT.items():
    query(K.format(passed=_passed, message=_message))(one_check(_name))


@query("""
WITH d AS (SELECT conv_id, '# c' || chr(10) || string_agg('## ' || role || CASE WHEN turn > 2 THEN ' again' ELSE '' END || chr(10) || replace(coalesce(text, ''), '#', ''), chr(10) ORDER BY turn, role, text) AS md FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, role || CASE WHEN turn > 2 THEN ' again' ELSE '' END AS title, arg_max(replace(coalesce(text, ''), '#', ''), turn) AS content FROM conversations GROUP BY ALL)
SELECT conv_id, title, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content FROM t""")
def split_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, taken apart into sections; of equal titles the last content counts."""
    part = "'## ' || role || CASE WHEN turn > 2 THEN ' again' ELSE '' END || chr(10) || replace(coalesce(text, ''), '#', '') AS part"
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", f"struct(turn, role, text, {part}) AS s")
    md = c.groupBy("conv_id").agg(F.concat(F.lit("# c\n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["part"]), "\n")).alias("md"))
    return md.select("conv_id", F.explode(Q.sections(F.col("md"))).alias("s")).select("conv_id", "s.title", "s.content")


@query("WITH d AS (SELECT o_orderkey AS k FROM orders) SELECT CAST(count(*) FILTER (k % 8 <> 0) AS BIGINT) AS passed, CAST(count(*) FILTER (k % 8 = 0) AS BIGINT) AS failed FROM d")
def q_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents pass a check."""
    return Q.totals(Q.evaluate(faulty(spark, sf_dir), checks=["no_stray_page_numbers"]))


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each order: a cover, a balance sheet (a side that it lacks is a dash), notes, and a page of prose; every
    ninth is international."""
    sides = with_sides(spark, sf_dir).join(covers(spark, sf_dir), "o_orderkey")
    amount = "coalesce(format_number({}, 2), '—')".format
    both = amount("coalesce(liabilities + equity, liabilities, equity)")
    grid = f"array(array('', '2024'), array('Total assets', '$', {both}), array('Total liabilities', '', {amount('liabilities')}), array('Total stockholders\\' equity', '', {amount('equity')}))"
    sheet = f"'CONSOLIDATED BALANCE SHEETS\n(in thousands)\nTotal assets $ ' || {both} || '\nTotal liabilities ' || {amount('liabilities')} || '\nTotal stockholders\\' equity ' || {amount('equity')}"
    abroad = f"'Statement of Financial Position\nprepared under IFRS\nTotal assets ' || {both} || repeat(' and what they are', 6)"
    none = "cast(array() AS array<array<array<string>>>)"
    listed = f"""array(struct(1 AS page_number, t || '\nand more words of no matter at all' AS text, {none} AS tables), struct(2 AS page_number, {sheet} AS text, array({grid}) AS tables),
      struct(3 AS page_number, 'NOTES TO CONSOLIDATED FINANCIAL STATEMENTS\nNote 1. General\nThe company sells what it can and keeps\nthe rest of it in a warehouse.' AS text, {none} AS tables),
      struct(4 AS page_number, 'Item 4. CONTROLS AND PROCEDURES\nOur controls work as they should, and we have looked at them.' AS text, {none} AS tables))"""
    other = f"array(struct(1 AS page_number, {abroad} AS text, array({grid}) AS tables), struct(2 AS page_number, 'Notes to the Consolidated Financial Statements\n' || repeat('basis of preparation ', 8) AS text, {none} AS tables))"
    rows = sides.selectExpr("cast(o_orderkey AS string) AS filing_id", f"inline(CASE WHEN o_orderkey % 9 = 0 THEN {other} ELSE {listed} END)")
    return rows.select("filing_id", "page_number", "text", "tables")


@query()
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way for a report for each order: pages to documents."""
    return process_reports(spark, report_pages(spark, sf_dir), "2024-01-01T00:00:00").documents


@query(f"""
WITH {FIELDS} SELECT o_orderkey, CASE WHEN ticker IS NULL THEN 'Company=Own;Ticker=X;Period=' || period ELSE 'Company=Own;Ticker=ACME' END AS fields FROM c""")
def cover_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the pages before a filing fill in labels that its cover lacks, if company or ticker is among them."""
    o = covers(spark, sf_dir).withColumn("all", M.cover_fields("t"))
    ticker, period = M.field(F.col("all"), "Ticker"), M.field(F.col("all"), "Period")
    item = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    own = F.when(ticker == "", F.array(item("Company", F.lit("Own")))).otherwise(F.array(item("Company", F.lit("Own")), item("Ticker", ticker)))
    more = F.array(item("Ticker", F.lit("X")), item("Company", F.lit("Other")), item("Period", period), item("Ticker", F.lit("Y")))
    pairs = o.select("o_orderkey", own.alias("own"), more.alias("more")).select("o_orderkey", M.supplement(F.col("own"), F.col("more")).alias("f"))
    return pairs.select("o_orderkey", F.array_join(F.transform("f", lambda f: F.concat(f["label"], F.lit("="), f["value"])), ";").alias("fields"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS filing_id, '## ' || o_orderkey || chr(10) || chr(10) || CASE WHEN o_orderkey % 3 <> 0 THEN '- **PASS** `cover_page_fields`: Cover Page has all required fields' ELSE '- **FAIL** `cover_page_fields`: Missing: Company' || chr(10) || '  - Missing field: Company' END || chr(10) AS markdown FROM orders""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of each document as a list."""
    return Q.report(Q.evaluate(faulty(spark, sf_dir), checks=["cover_page_fields"]))
