"""Numbers, dates, periods, scales and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.catalog.registry import iso_date, money, query, spread, table, words_date
from ledgerloom.functions import labels as L, numbers as N


def shown(duck: bool = False) -> str:
    """Amounts of line items in the ways in which reports print them."""
    m = money("l_extendedprice", duck)
    return f"""CASE l_linenumber % 7 WHEN 0 THEN '—' WHEN 1 THEN '$ ' || {m} WHEN 2 THEN '$ (' || {m} || ')'
      WHEN 3 THEN '(' || {m} || ')' WHEN 4 THEN ' ' || {m} || ' ' WHEN 5 THEN '€' || {m} ELSE cast(cast(l_quantity AS int) AS varchar(20)) || '%' END"""


@query(f"""
WITH s AS (SELECT l_orderkey, l_linenumber, {shown(True)} AS shown FROM lineitem),
b AS (SELECT *, trim(regexp_replace(trim(shown), '[$€£]', '', 'g')) AS bare FROM s),
c AS (SELECT *, bare LIKE '(%)' AS minus, replace(replace(trim(bare, '()'), ',', ''), ' ', '') AS digits FROM b)
SELECT l_orderkey, l_linenumber, shown,
  CASE WHEN minus THEN -1 ELSE 1 END * CASE WHEN regexp_full_match(digits, '[0-9]+(\\.[0-9]*)?') THEN CAST(digits AS DOUBLE) END AS amount
FROM c""")
def parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed amounts of all line items, read back."""
    rows = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").selectExpr("l_orderkey", "l_linenumber", f"{shown()} AS shown")
    return rows.select("l_orderkey", "l_linenumber", "shown", N.parse_numeric(F.col("shown")).alias("amount"))


@query("""
WITH c AS (SELECT p_partkey, unnest([p_name, CAST(p_retailprice AS VARCHAR), '$ ' || CAST(p_size AS VARCHAR), '(' || CAST(p_size AS VARCHAR) || ')', '—', '']) AS cell FROM part),
b AS (SELECT *, trim(regexp_replace(cell, '[$, ]', '', 'g')) AS bare FROM c)
SELECT p_partkey, cell, bare IN ('', '—', '–', '-') OR regexp_full_match(trim(bare, '()'), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') AS numeric_cell FROM b""")
def is_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether cells made of names, prices and sizes can stand in a value column."""
    cells = "explode(array(p_name, cast(p_retailprice AS string), '$ ' || p_size, '(' || p_size || ')', '—', '')) AS cell"
    return table(spark, sf_dir, "part").selectExpr("p_partkey", cells).select("p_partkey", "cell", N.is_numeric(F.col("cell")).alias("numeric_cell"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN floor(l_extendedprice) ELSE l_extendedprice END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN v IS NULL THEN '—' WHEN v = floor(v) THEN format('{:,}', CAST(v AS BIGINT)) ELSE format('{:,.2f}', v) END AS printed FROM v""")
def format_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as printed."""
    v = "CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN cast(floor(l_extendedprice) AS double) ELSE l_extendedprice END AS v"
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", v).select("l_orderkey", "l_linenumber", N.format_amount(F.col("v")).alias("printed"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 6 = 0 THEN 0.0 ELSE l_extendedprice END AS a, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE l_quantity * 1000 END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN a = 0 AND b = 0 THEN 0.0 WHEN a <> 0 THEN abs(a - b) / abs(a) ELSE abs(a - b) / abs(b) END, 6) AS difference FROM v""")
def relative_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relative difference of two amounts, either of which may be zero."""
    a, b = "CASE WHEN l_linenumber % 6 = 0 THEN 0.0D ELSE l_extendedprice END AS a", "CASE WHEN l_linenumber % 3 = 0 THEN 0.0D ELSE l_quantity * 1000 END AS b"
    v = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", a, b)
    return v.select("l_orderkey", "l_linenumber", F.round(N.relative_difference(F.col("a"), F.col("b")), 6).alias("difference"))


def period(duck: bool = False) -> str:
    w = words_date("o_orderdate", duck)
    year = "CAST(year(o_orderdate) AS varchar(10))"
    return f"CASE o_orderkey % 4 WHEN 0 THEN {w} WHEN 1 THEN replace({w}, ',', '') WHEN 2 THEN upper({w}) ELSE 'fiscal ' || {year} END"


@query(f"""
SELECT o_orderkey, {period(True)} AS period, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE {iso_date("o_orderdate", True)} END AS period_end, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year
FROM orders""")
def period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in words, with and without a comma, read back."""
    p = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{period()} AS period")
    return p.select("o_orderkey", "period", L.period_date(F.col("period")).alias("period_end"), L.period_year(F.col("period")).alias("fiscal_year"))


FORMS = "CASE o_orderkey % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '10-K/A' ELSE '10-Q' END"
#: (month in which a fiscal year ends) by customer; every seventh customer doesn't say.
COVERS = """CASE o_custkey % 7 WHEN 0 THEN 'no such words' WHEN 1 THEN 'For the fiscal year ended March 31, 2024' WHEN 2 THEN 'for the year ended June 30, 2023'
      WHEN 3 THEN 'For the fiscal year ended September 28, 2024' ELSE 'FISCAL YEAR ENDED DECEMBER 31, 2024' END"""
YEAR_END = "CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 9 ELSE 12 END"


@query(f"""
WITH v AS (SELECT o_orderkey, {FORMS} AS form, month(o_orderdate) AS m, year(o_orderdate) AS y, {YEAR_END} AS fye FROM orders)
SELECT o_orderkey, CAST(fye AS INTEGER) AS year_end,
  CASE WHEN form LIKE '10-K%' THEN 'FY' WHEN fye IS NOT NULL THEN 'Q' || CAST((m - (fye % 12 + 1) + 12) % 12 // 3 + 1 AS VARCHAR)
    WHEN m = 3 THEN 'Q1' WHEN m = 6 THEN 'Q2' WHEN m = 9 THEN 'Q3' ELSE 'Q?' END AS period_type,
  CAST(CASE WHEN fye IS NULL OR fye = 12 OR m <= fye THEN y ELSE y + 1 END AS INTEGER) AS fiscal_year
FROM v""")
def period_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal quarter and year of every order date, by the year end that a cover names."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{FORMS} AS form", f"{words_date('o_orderdate')} AS period", f"{COVERS} AS cover")
    fye, p = L.fiscal_year_end(F.col("cover")), F.col("period")
    month = L.month_number(L.first_word(p))
    return o.select("o_orderkey", fye.alias("year_end"), L.period_type(F.col("form"), p, fye).alias("period_type"), L.fiscal_year(L.period_year(p), month, fye).alias("fiscal_year"))


HINTS = """CASE p_partkey % 9 WHEN 0 THEN '(in thousands, except share amounts)' WHEN 1 THEN 'All figures in USD millions unless noted' WHEN 2 THEN 'amounts in billions'
      WHEN 3 THEN '(Millions of dollars)' WHEN 4 THEN '(in millions, except shares in thousands)' WHEN 5 THEN 'tabular amounts in thousands of something' WHEN 6 THEN '(in whole dollars)'
      WHEN 7 THEN 'page one (in U.S. thousands)' ELSE '' END"""


@query(f"""
WITH h AS (SELECT p_partkey, {HINTS} AS hint FROM part)
SELECT p_partkey, hint, CASE WHEN p_partkey % 9 IN (1, 3, 4) THEN 'millions' WHEN p_partkey % 9 = 2 THEN 'billions' WHEN p_partkey % 9 IN (0, 5, 7) THEN 'thousands' ELSE 'units' END AS scale FROM h""")
def scale_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{HINTS} AS hint")
    return h.select("p_partkey", "hint", L.scale(F.col("hint")).alias("scale"))


@query("""
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '(in thousands, except share amounts)' WHEN 1 THEN 'in USD millions' WHEN 2 THEN 'in billions' WHEN 3 THEN '(Millions of dollars)'
  WHEN 4 THEN '(in millions, except shares in thousands)' WHEN 5 THEN 'in thousands' END AS hint
FROM part""")
def scale_hint_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a statement that announce its scale."""
    h = table(spark, sf_dir, "part").selectExpr("p_partkey", f"p_name || chr(10) || {HINTS} || chr(10) || p_type AS body")
    return h.select("p_partkey", L.scale_hint(F.col("body")).alias("hint"))


@query("""
WITH v AS (SELECT c_custkey, ' ' || CAST(c_custkey * 977 AS VARCHAR) || ' ' AS cik, lpad(CAST(c_custkey AS VARCHAR), 10, '0') || '-24-' || lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS accession,
  CASE c_custkey % 4 WHEN 0 THEN '10-K/A' WHEN 1 THEN '10-q' WHEN 2 THEN '20-F' ELSE '10-KA' END AS form FROM customer)
SELECT c_custkey, CASE WHEN length(trim(cik)) < 10 THEN lpad(trim(cik), 10, '0') ELSE trim(cik) END AS cik, replace(accession, '-', '') AS prefix, rtrim(upper(form), '/A') AS base FROM v""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filer numbers padded, accession numbers without dashes, forms without the mark of an amendment."""
    v = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "' ' || (c_custkey * 977) || ' ' AS cik", "lpad(c_custkey, 10, '0') || '-24-' || lpad(c_nationkey, 6, '0') AS accession",
        "CASE c_custkey % 4 WHEN 0 THEN '10-K/A' WHEN 1 THEN '10-q' WHEN 2 THEN '20-F' ELSE '10-KA' END AS form",
    )
    return v.select("c_custkey", L.pad_cik(F.col("cik")).alias("cik"), L.accession_prefix(F.col("accession")).alias("prefix"), L.form_base(F.col("form")).alias("base"))


SCALARS = r"""CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ': ' || p_brand WHEN 2 THEN 'say "' || p_name || '"' WHEN 3 THEN p_type || ' & co' WHEN 4 THEN p_type || '|' || p_name ELSE '' END"""


@query(f"""
WITH v AS (SELECT p_partkey, {SCALARS} AS v FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(v, '[:#{{}}\\[\\],&*?|>''"%@`]') THEN '"' || replace(v, '"', chr(92) || '"') || '"' ELSE v END AS yaml FROM v""")
def yaml_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{SCALARS} AS v")
    return v.select("p_partkey", L.yaml_value(F.col("v")).alias("yaml"))
