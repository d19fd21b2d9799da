"""Line items, statements, checks, scores and structured facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.catalog.registry import iso_date, money, query, spread, table
from ledgerloom.operators import confidence as C, facts as X, normalize as N, validate as V
from ledgerloom.sources.dimensions import alias_dim, aliases, concept_dim, read_tsv


def quoted(*values: str | int) -> str:
    return "(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + ")"


#: The alias dimension as a DuckDB table, and labels that stand for its rows.
ALIASES = "aliases(ord, alias, canonical) AS (VALUES " + ", ".join(quoted(k, a, c) for k, (a, c) in enumerate(aliases())) + ")"
N_ALIASES = len(aliases())
CONCEPTS = "concepts(ord, statement, concept_ord, concept, canonical) AS (VALUES " + ", ".join(quoted(k, r["statement"], int(r["ord"]), r["concept"], r["canonical"]) for k, r in enumerate(read_tsv("concepts.tsv"))) + ")"
N_CONCEPTS = len(read_tsv("concepts.tsv"))


def with_alias(df: DataFrame, key: str) -> DataFrame:
    """df with the alias (and its canonical name) that a number stands for."""
    d = alias_dim(df.sparkSession).select(F.col("ord"), F.col("alias").alias("the_alias"), F.col("canonical").alias("the_name"))
    return df.join(F.broadcast(d), F.expr(f"{key} % {N_ALIASES} = ord")).drop("ord")


@query(f"""
WITH {ALIASES}, l AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(alias) WHEN 1 THEN '  ' || alias || ' ' ELSE p_name END AS label FROM part JOIN aliases ON p_partkey % {N_ALIASES} = ord)
SELECT p_partkey, label, canonical FROM l LEFT JOIN aliases ON lower(trim(label)) = alias""")
def taxonomy_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are aliases in other dress, and names that aren't."""
    p = with_alias(table(spark, sf_dir, "part"), "p_partkey")
    p = p.selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN upper(the_alias) WHEN 1 THEN '  ' || the_alias || ' ' ELSE p_name END AS label")
    return N.match_exact(p, "label", alias_dim(spark))


@query()
def taxonomy_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with slips of the pen: the most similar alias, if it is similar enough."""
    p = with_alias(table(spark, sf_dir, "part"), "p_partkey")
    p = p.selectExpr("CASE p_partkey % 4 WHEN 0 THEN the_alias || ', net' WHEN 1 THEN replace(the_alias, 's', '') WHEN 2 THEN p_name ELSE 'total ' || the_alias END AS label")
    return N.match_labels(p).withColumn("confidence", F.round("confidence", 6))


CONTEXT_LABELS = "CASE l_linenumber WHEN 1 THEN 'Current assets:' WHEN 3 THEN 'Non-current assets' WHEN 5 THEN 'Total current liabilities' WHEN 6 THEN '1,234' ELSE 'Marketable securities' END"
ROW_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query(f"""
WITH l AS (SELECT *, {CONTEXT_LABELS} AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ROW_ORDER}) AS i FROM lineitem),
c AS (SELECT *, CASE l_linenumber WHEN 1 THEN 'current' WHEN 3 THEN 'non-current' WHEN 5 THEN 'current' END AS named FROM l)
SELECT l_orderkey, CAST(i AS INTEGER) AS row_ix, label, last_value(named IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY i) AS context FROM c""")
def context_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current or non-current, as the labels above a row have it."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ROW_ORDER}) AS int) AS row_ix", f"{CONTEXT_LABELS} AS label")
    return N.with_context(rows, F.col("label"), ["l_orderkey"], ["row_ix"]).select("l_orderkey", "row_ix", "label", "context")


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a statement for each order: an alias, an amount, a dash and a percentage; some are sub-headers or numbers."""
    rows = with_alias(spread(table(spark, sf_dir, "lineitem"), "l_orderkey"), "l_partkey")
    label = "CASE WHEN l_linenumber = 7 THEN the_alias || ':' WHEN l_linenumber = 6 THEN '1,234' ELSE upper(the_alias) END"
    order = f"cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ROW_ORDER}) AS int)"
    return rows.selectExpr("cast(l_orderkey AS string) AS filing_id", "'balance_sheet' AS key", "0 AS table_ix", f"{order} AS row_ix", f"array({label}, {money('l_extendedprice')}, '—', '(' || {money('l_quantity')} || ')', '5%') AS row")


STATEMENT_ROWS = f"""{ALIASES}, l AS (SELECT CAST(l_orderkey AS VARCHAR) AS filing_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ROW_ORDER}) AS row_ix, l_linenumber, alias, canonical, l_extendedprice, l_quantity
  FROM lineitem JOIN aliases ON l_partkey % {N_ALIASES} = ord),
n AS (SELECT *, CASE WHEN l_linenumber = 7 THEN alias || ':' WHEN l_linenumber = 6 THEN '1,234' ELSE upper(alias) END AS label, CASE WHEN l_linenumber IN (6, 7) THEN '' ELSE canonical END AS name,
  CASE WHEN lower(alias) ~ '(non|long)[- ]?(current|term)\\s+(assets|liabilities)' AND l_linenumber <> 6 THEN 'non-current' WHEN lower(alias) ~ '\\bcurrent\\s+(assets|liabilities)' AND l_linenumber <> 6 THEN 'current' END AS named FROM l),
c AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY filing_id ORDER BY row_ix) AS context FROM n),
d AS (SELECT * REPLACE (CASE WHEN name = '' THEN '' WHEN lower(label) = 'marketable securities' AND context = 'current' THEN 'Short-Term Investments' WHEN lower(label) = 'marketable securities' AND context = 'non-current' THEN 'Long-Term Investments'
  WHEN lower(label) = 'other current liabilities' AND context = 'current' THEN 'Other Current Liabilities' WHEN lower(label) = 'other non-current liabilities' AND context = 'non-current' THEN 'Other Non-Current Liabilities' ELSE name END AS name) FROM c)"""


@query(f"WITH {STATEMENT_ROWS} SELECT filing_id, CAST(row_ix AS INTEGER) AS row_ix, label, name AS canonical FROM d")
def normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical name of every row of every statement."""
    return N.normalize_rows(statement_rows(spark, sf_dir)).select("filing_id", "row_ix", "label", "canonical")


@query(f"WITH {STATEMENT_ROWS} SELECT filing_id, CAST(row_ix AS INTEGER) AS row_ix, label FROM d WHERE name = ''")
def unmapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.unmapped(N.normalize_rows(statement_rows(spark, sf_dir))).select("filing_id", "row_ix", "label")


@query(f"""WITH {STATEMENT_ROWS}
SELECT filing_id, name AS canonical, round(arg_max(l_extendedprice, row_ix), 2) AS first_amount, round(arg_max(-l_quantity, row_ix), 2) AS last_amount, 2 AS n_amounts FROM d WHERE name <> '' GROUP BY filing_id, name""")
def statement_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as data: dashes and percentages drop out, the last row of an item counts."""
    data = N.statement_data(N.normalize_rows(statement_rows(spark, sf_dir)))
    return data.select("filing_id", "canonical", F.col("amounts")[0].alias("first_amount"), F.element_at("amounts", -1).alias("last_amount"), F.size("amounts").alias("n_amounts"))


@query("""
WITH m AS (SELECT p_partkey, p_type AS label, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS canonical FROM part),
k AS (SELECT label, arg_min(canonical, p_partkey) AS known FROM m WHERE canonical <> '' GROUP BY label)
SELECT p_partkey AS filing_ord, label, coalesce(nullif(canonical, ''), known, '') AS canonical FROM m LEFT JOIN k USING (label)""")
def mapping_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty names filled from the first filing that has one for the label."""
    m = table(spark, sf_dir, "part").selectExpr("p_partkey AS filing_ord", "p_type AS label", "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS canonical")
    return N.consistent_mappings(m)


PERIOD_END = "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE {iso} END"


@query(f"""
WITH f AS (SELECT o_custkey, o_orderkey AS filing_ord, {PERIOD_END.format(iso=iso_date("o_orderdate", True))} AS period_end FROM orders)
SELECT o_custkey, filing_ord, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY period_end, filing_ord) AS INTEGER) AS filing_sequence FROM f""")
def filing_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings of each customer by period, undated ones first."""
    f = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey AS filing_ord", f"{PERIOD_END.format(iso=iso_date('o_orderdate'))} AS period_end")
    return N.filing_sequence(f, ["o_custkey"]).select("o_custkey", "filing_ord", "filing_sequence")


@query(f"""
WITH f AS (SELECT o_orderkey AS filing_ord, {PERIOD_END.format(iso=iso_date("o_orderdate", True))} AS period_end FROM orders)
SELECT filing_ord, CAST(row_number() OVER (ORDER BY period_end, filing_ord) AS INTEGER) AS filing_sequence FROM f""")
def filing_sequence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sequence over all filings."""
    f = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS filing_ord", f"{PERIOD_END.format(iso=iso_date('o_orderdate'))} AS period_end")
    return N.filing_sequence(f).select("filing_ord", "filing_sequence")


# checks: an order is a balance sheet, its total the assets, its lines the two sides

#: Products of two-place numbers are summed exactly, so that half cents round alike everywhere.
NET = "cast(sum(cast(l_extendedprice AS decimal(15, 2)) * (1 - cast(l_discount AS decimal(4, 2)))) AS decimal(18, 2))"
SIDES = """SELECT l_orderkey, round(sum(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END), 2) AS liabilities, round(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END), 2) AS equity,
  cast({net} AS double) AS net FROM {lineitem} GROUP BY l_orderkey"""


def with_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum(F.expr("CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END")), 2).alias("liabilities"), F.round(F.sum(F.expr("CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END")), 2).alias("equity"),
        F.expr(f"cast({NET} AS double)").alias("net"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("total"))
    return orders.join(sides, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


#: Assets: the sum of both sides for some orders, off by half a percent for others, the order's own total for the rest.
ASSETS = "CASE o_orderkey % 4 WHEN 0 THEN round(coalesce(liabilities, 0.0) + coalesce(equity, 0.0), 2) WHEN 1 THEN round(coalesce(liabilities, 0.0) + coalesce(equity, 0.0) + floor((coalesce(liabilities, 0.0) + coalesce(equity, 0.0)) / 200), 2) WHEN 2 THEN total END"
DUCK_SIDES = f"s AS ({SIDES.format(lineitem='lineitem', net=NET)}), o AS (SELECT o_orderkey, round(o_totalprice, 2) AS total, liabilities, equity, net FROM orders LEFT JOIN s ON o_orderkey = l_orderkey)"


def off(expected: str, actual: str) -> str:
    """DuckDB: the relative difference."""
    return f"CASE WHEN {expected} = 0 AND {actual} = 0 THEN 0.0 WHEN {expected} <> 0 THEN abs({expected} - {actual}) / abs({expected}) ELSE abs({expected} - {actual}) / abs({actual}) END"


def status(expected: str, actual: str) -> str:
    return f"CASE WHEN {expected} IS NULL OR {actual} IS NULL THEN NULL WHEN {expected} = {actual} THEN 'PASS' WHEN {off(expected, actual)} <= 0.01 THEN 'WARN' ELSE 'FAIL' END"


def detail(expected: str, actual: str) -> str:
    return f"'Expected ' || {money(expected, True)} || ', got ' || {money(actual, True)} || CASE WHEN {expected} = {actual} THEN '' ELSE ' (off by ' || {money('100 * ' + '(' + off(expected, actual) + ')', True)} || '%)' END"


@query(f"WITH {DUCK_SIDES} SELECT o_orderkey, {status('total', 'net')} AS status FROM o")
def check_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's total against the net of its lines."""
    return with_sides(spark, sf_dir).select("o_orderkey", V.status_of(F.col("total"), F.col("net")).alias("status"))


BOTH = "round(coalesce(liabilities, 0.0) + coalesce(equity, 0.0), 2)"


def statements_of(df: DataFrame, id_col: str, statements: dict[str, dict[str, str]]) -> DataFrame:
    """(filing_id, key, canonical, amounts) of statements by key, from a wide row; items that are null are absent."""
    pairs = F.expr("array(" + ", ".join(f"struct('{key}' AS key, '{c}' AS canonical, cast({e} AS double) AS amount)" for key, items in statements.items() for c, e in items.items()) + ")")
    long = df.select(F.col(id_col).cast("string").alias("filing_id"), F.explode(pairs).alias("p"))
    return long.where("p.amount is not null").select("filing_id", "p.key", "p.canonical", F.array("p.amount").alias("amounts"))


@query(f"""
WITH {DUCK_SIDES}, v AS (SELECT o_orderkey, {ASSETS} AS assets, liabilities, equity, CASE WHEN liabilities IS NOT NULL OR equity IS NOT NULL THEN coalesce(liabilities, 0.0) + coalesce(equity, 0.0) END AS other FROM o)
SELECT CAST(o_orderkey AS VARCHAR) AS filing_id, 'BS Balance (Assets vs L+E)' AS check, CASE WHEN assets IS NULL OR other IS NULL THEN 'SKIP' ELSE {status('assets', 'other')} END AS status,
  CASE WHEN assets IS NULL OR other IS NULL THEN 'Missing key items for balance sheet check' ELSE {detail('assets', 'other')} END AS detail
FROM v WHERE assets IS NOT NULL OR liabilities IS NOT NULL OR equity IS NOT NULL""")
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance of every order read as a two-sided statement: the minimal path from facts to a verdict."""
    data = statements_of(with_sides(spark, sf_dir), "o_orderkey", {"balance_sheet": {"Total Assets": ASSETS, "Total Liabilities": "liabilities", "Total Stockholders'' Equity".replace("''", "\\'"): "equity"}})
    return V.run_checks(data).select("filing_id", "check", "status", "detail")


#: An order as an income statement and a cash flow statement, parts of which some orders lack.
INCOME = {"Revenue": "total", "Cost of Revenue": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE -liabilities END", "Gross Profit": "CASE o_orderkey % 3 WHEN 0 THEN total - abs(liabilities) ELSE equity END", "Net Income": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE net END"}
CASH = {
    "Beginning Cash": "liabilities", "Net Change in Cash": "equity", "Ending Cash": "CASE o_orderkey % 3 WHEN 0 THEN total ELSE liabilities + equity END", "Net Income": "CASE o_orderkey % 4 WHEN 0 THEN net WHEN 1 THEN net + 0.5 ELSE total END",
    "Net Cash from Operations": "net", "Net Cash from Investing": "CASE WHEN o_orderkey % 2 = 0 THEN net END", "Net Cash from Financing": "CASE WHEN o_orderkey % 3 = 0 THEN net END",
}
SHEET = {"Cash & Cash Equivalents": "CASE o_orderkey % 3 WHEN 0 THEN total ELSE liabilities END", "Restricted Cash": "CASE WHEN o_orderkey % 2 = 0 THEN equity END"}


def three_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = with_sides(spark, sf_dir)  # orders that lack a side, or both, lack the items that rest on it
    return statements_of(o, "o_orderkey", {"income_statement": INCOME, "cash_flow": CASH, "balance_sheet": SHEET})  # one pass over the orders


W = ", ".join(f"{e} AS {n}" for n, e in dict(
    revenue=INCOME["Revenue"], cost=INCOME["Cost of Revenue"], gross=INCOME["Gross Profit"], ni=INCOME["Net Income"], begin_=CASH["Beginning Cash"], change=CASH["Net Change in Cash"], end_=CASH["Ending Cash"],
    ni2=CASH["Net Income"], inv=CASH["Net Cash from Investing"], fin=CASH["Net Cash from Financing"], ops=CASH["Net Cash from Operations"], cash=SHEET["Cash & Cash Equivalents"], restricted=SHEET["Restricted Cash"],
).items())
WIDE = f"{DUCK_SIDES}, w AS (SELECT CAST(o_orderkey AS VARCHAR) AS filing_id, {W} FROM o)"
HAS_FLOWS, HAS_SHEET = "coalesce(begin_, change, end_, ni2, ops, inv, fin) IS NOT NULL", "coalesce(cash, restricted) IS NOT NULL"


def one_check(name: str, skip: str, why: str, expected: str, actual: str) -> str:
    return f"SELECT filing_id, '{name}' AS check, CASE WHEN {skip} THEN 'SKIP' ELSE {status(expected, actual)} END AS status, CASE WHEN {skip} THEN '{why}' ELSE {detail(expected, actual)} END AS detail FROM w"


@query(f"""WITH {WIDE} {one_check("IS Gross Profit Check", "cost IS NULL OR gross IS NULL", "Missing Revenue, Cost of Revenue, or Gross Profit", "(revenue - abs(cost))", "gross")}
UNION ALL SELECT filing_id, 'IS Net Income Present', CASE WHEN ni IS NULL THEN 'SKIP' ELSE 'PASS' END, CASE WHEN ni IS NULL THEN 'Net Income not found' ELSE 'Net Income = ' || {money('ni', True)} END FROM w""")
def income_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross profit and net income of every order read as an income statement."""
    return V.run_checks(three_statements(spark, sf_dir)).where("check like 'IS %'").select("filing_id", "check", "status", "detail")


@query(f"""WITH {WIDE} {one_check("CF Cash Reconciliation", "begin_ IS NULL OR change IS NULL OR end_ IS NULL", "Missing Beginning Cash, Net Change, or Ending Cash", "(begin_ + change)", "end_")} WHERE {HAS_FLOWS}
UNION ALL SELECT filing_id, 'CF Activity Sections', CASE (ops IS NULL)::INT + (inv IS NULL)::INT + (fin IS NULL)::INT WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END,
  CASE WHEN ops IS NOT NULL AND inv IS NOT NULL AND fin IS NOT NULL THEN 'All 3 activity sections present'
    ELSE 'Missing: ' || concat_ws(', ', CASE WHEN ops IS NULL THEN 'Net Cash from Operations' END, CASE WHEN inv IS NULL THEN 'Net Cash from Investing' END, CASE WHEN fin IS NULL THEN 'Net Cash from Financing' END) END FROM w WHERE {HAS_FLOWS}""")
def cash_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciliation and sections of every order read as a cash flow statement."""
    return V.run_checks(three_statements(spark, sf_dir)).where("check like 'CF %'").select("filing_id", "check", "status", "detail")


@query(f"""WITH {WIDE}, x AS (SELECT *, {status('end_', 'cash')} AS plain, {status('end_', '(cash + restricted)')} AS more FROM w)
SELECT filing_id, 'Cross: Net Income (IS vs CF)' AS check, CASE WHEN ni IS NULL OR ni2 IS NULL THEN 'SKIP' WHEN abs(ni - ni2) <= greatest(1.0, abs(ni) * 0.01) THEN 'PASS' ELSE {status('ni', 'ni2')} END AS status,
  CASE WHEN ni IS NULL OR ni2 IS NULL THEN 'Net Income not available in both IS and CF' WHEN abs(ni - ni2) <= greatest(1.0, abs(ni) * 0.01) THEN 'IS values [' || ni || '] match CF values [' || ni2 || ']' ELSE {detail('ni', 'ni2')} END AS detail
FROM x WHERE {HAS_FLOWS} OR {HAS_SHEET}
UNION ALL SELECT filing_id, 'Cross: Cash (CF Ending vs BS)', CASE WHEN plain IS NULL THEN 'SKIP' WHEN plain = 'FAIL' AND more IN ('PASS', 'WARN') THEN more ELSE plain END,
  CASE WHEN plain IS NULL THEN 'Ending Cash or BS Cash not available' WHEN plain = 'FAIL' AND more IN ('PASS', 'WARN') THEN {detail('end_', '(cash + restricted)')} || ' (includes restricted cash)' ELSE {detail('end_', 'cash')} END
FROM x WHERE {HAS_FLOWS} OR {HAS_SHEET}""")
def cross_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net income and cash across statements."""
    return V.run_checks(three_statements(spark, sf_dir)).where("check like 'Cross%'").select("filing_id", "check", "status", "detail")


# two sources of one statement: the lines' own amounts, and the same less discount

LESS = "cast(cast(max(cast(l_extendedprice AS decimal(15, 2)) * (1 - cast(l_discount AS decimal(4, 2)) * cast(l_tax AS decimal(4, 2)) * 4)) AS decimal(18, 2)) AS double)"
SOURCES = """a AS (SELECT CAST(l_orderkey AS VARCHAR) AS filing_id, CASE l_linenumber % 3 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' ELSE 'cash_flow' END AS key, 'Item ' || l_linenumber AS canonical, round(max(l_extendedprice), 2) AS v,
  {w} AS w FROM {t} GROUP BY ALL)"""
LEFT, RIGHT = "canonical <> 'Item 7'", "canonical <> 'Item 1' AND v > 5000"
COMPARED = f"""{SOURCES.format(t='lineitem', w=LESS)}, d AS (SELECT filing_id, key, canonical, v, w, abs(v - w) AS difference, {off('v', 'w')} AS pct FROM a WHERE {LEFT} AND {RIGHT}),
e AS (SELECT *, CASE WHEN pct <= 0.01 THEN 'info' WHEN pct <= 0.05 THEN 'warn' ELSE 'error' END AS severity FROM d)"""


def two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = "CASE l_linenumber % 3 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' ELSE 'cash_flow' END AS key"
    l = table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey AS string) AS filing_id", key, "'Item ' || l_linenumber AS canonical", "l_extendedprice", "l_discount", "l_tax")
    a = l.groupBy("filing_id", "key", "canonical").agg(F.round(F.max("l_extendedprice"), 2).alias("v"), F.expr(LESS).alias("w"))
    structured = a.where(LEFT).select("filing_id", "key", "canonical", F.array(F.lit(None), "v").alias("amounts"))
    return structured, a.where(RIGHT).select("filing_id", "key", "canonical", F.array("w").alias("amounts"))


@query(f"WITH {COMPARED} SELECT filing_id, key, canonical, round(difference, 2) AS difference, round(pct, 6) AS pct_difference, severity FROM e")
def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two sources of the same items are apart."""
    found = C.cross_validate(*two_sources(spark, sf_dir), ["filing_id", "key"])
    return found.select("filing_id", "key", "canonical", F.round("difference", 2).alias("difference"), F.round("pct_difference", 6).alias("pct_difference"), "severity")


CHECKED = "CASE {id} % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' WHEN 2 THEN 'FAIL' ELSE 'SKIP' END"
SCORED = f"""{COMPARED}, s AS (SELECT DISTINCT filing_id, key FROM a), x AS (SELECT filing_id, key, count(*) AS n_a FROM a WHERE {LEFT} GROUP BY ALL), y AS (SELECT filing_id, key, count(*) AS n_b FROM a WHERE {RIGHT} GROUP BY ALL),
z AS (SELECT filing_id, key, count(*) AS n, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warns FROM e GROUP BY ALL),
j AS (SELECT s.*, n_a, n_b, coalesce(n, 0) AS discrepancies, coalesce(errors, 0) AS errors, coalesce(warns, 0) AS warns, CASE WHEN key <> 'income_statement' THEN {CHECKED.format(id="CAST(filing_id AS BIGINT)")} END AS st
  FROM s LEFT JOIN x USING (filing_id, key) LEFT JOIN y USING (filing_id, key) LEFT JOIN z USING (filing_id, key)),
score AS (SELECT filing_id, key, discrepancies, errors, warns, CASE WHEN n_a IS NOT NULL AND n_b IS NOT NULL THEN CASE WHEN errors = 0 THEN 'xbrl+pdf' ELSE 'xbrl' END WHEN n_a IS NOT NULL THEN 'xbrl' WHEN n_b IS NOT NULL THEN 'pdf' ELSE 'none' END AS source,
  CAST(CASE WHEN n_a IS NOT NULL AND n_b IS NOT NULL THEN CASE WHEN errors > 0 THEN 0.8 WHEN warns > 0 THEN 0.95 ELSE 1.0 END WHEN n_a IS NOT NULL THEN 0.9 WHEN n_b IS NULL THEN 0.0
    WHEN key = 'income_statement' THEN 0.6 WHEN st IN ('PASS', 'SKIP') THEN 0.7 WHEN st = 'WARN' THEN 0.5 ELSE 0.3 END AS DOUBLE) AS confidence FROM j)"""


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    structured, printed = two_sources(spark, sf_dir)
    keys = ["filing_id", "key"]
    found = C.cross_validate(structured, printed, keys)
    names = F.expr("explode(array('BS Balance (Assets vs L+E)', 'CF Cash Reconciliation', 'IS Gross Profit Check')) AS check")
    checks = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey").distinct().select(F.col("l_orderkey").cast("string").alias("filing_id"), names, F.expr(CHECKED.format(id="l_orderkey")).alias("status"))
    statements = table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey AS string) AS filing_id", "CASE l_linenumber % 3 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' ELSE 'cash_flow' END AS key")
    return C.confidence(statements, structured, printed, found, C.validation_status(checks), keys), found


@query(f"WITH {SCORED} SELECT filing_id, key, source, confidence, discrepancies, errors, warns FROM score")
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source and the trust of every statement."""
    return scored(spark, sf_dir)[0]


SCORE_RULE = "|" + "|".join(":" + "-" * n for n in (10, 7, 11, 14)) + "|"


@query(f"""WITH {SCORED}, t AS (SELECT *, CASE key WHEN 'income_statement' THEN 1 WHEN 'balance_sheet' THEN 2 ELSE 3 END AS o, CASE WHEN errors > 0 THEN discrepancies || ' (' || errors || ' ERROR, ' || warns || ' WARN)' WHEN warns > 0 THEN discrepancies || ' (' || warns || ' WARN)'
  WHEN discrepancies = 0 THEN 'None' ELSE discrepancies || ' found' END AS words FROM score)
SELECT filing_id, '| Statement | Source | Confidence | Discrepancies |' || chr(10) || '{SCORE_RULE}' || chr(10) || string_agg('| ' || key || ' | ' || source || ' | ' || {money('confidence', True, 1)} || ' | ' || words || ' |', chr(10) ORDER BY o) AS top FROM t GROUP BY filing_id""")
def confidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of each filing as markdown, without the table of single discrepancies."""
    scores, found = scored(spark, sf_dir)
    order = F.array_position(F.array(*map(F.lit, ("income_statement", "balance_sheet", "cash_flow"))), F.col("key"))
    return C.render_confidence(scores, found, order).select("filing_id", F.substring_index("markdown", "\n\n### ", 1).alias("top"))


# structured facts: a user is a filer, an event a fact

CONCEPT_OF, UNIT_OF = f"(event_id * 7 + user_id) % {N_CONCEPTS}", "CASE event_id % 5 WHEN 0 THEN 'USD/shares' WHEN 1 THEN 'shares' ELSE 'USD' END"
EVENTS = f"""{CONCEPTS}, f AS (SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS filer, concept, {UNIT_OF} AS unit, event_id, {iso_date('ts', True)} AS end_, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '2020-01-0' || (event_id % 2 + 1) END AS start_, round(value, 2) AS val,
  '0000-' || (event_id % 2) AS accn, CASE WHEN event_id % 13 = 0 THEN 'part' END AS segment FROM events JOIN concepts ON {CONCEPT_OF} = ord)"""


def fact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filer, json): the facts of each filer as one nested document."""
    dim = concept_dim(spark).withColumn("ord", F.expr("0"))
    rows = [(k, r["concept"]) for k, r in enumerate(read_tsv("concepts.tsv"))]
    dim = spark.createDataFrame(rows, "ord int, concept string")
    e = table(spark, sf_dir, "events").join(F.broadcast(dim), F.expr(f"{CONCEPT_OF} = ord"))
    fact = f"struct({iso_date('ts')} AS end, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '2020-01-0' || (event_id % 2 + 1) END AS start, round(value, 2) AS val, '0000-' || (event_id % 2) AS accn, CASE WHEN event_id % 13 = 0 THEN 'part' END AS segment) AS fact"
    e = e.selectExpr("lpad(user_id, 10, '0') AS filer", "concept", f"{UNIT_OF} AS unit", "event_id", fact)
    lists = e.groupBy("filer", "concept", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "fact"))), lambda x: x["fact"]).alias("list"))
    units = lists.groupBy("filer", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "list"))).alias("units"))
    filers = units.groupBy("filer").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units").alias("c")))).alias("concepts"))
    return filers.select("filer", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), "concepts").alias("facts"))).alias("json"))


@query(f"WITH {EVENTS} SELECT filer, concept, unit, CAST(row_number() OVER (PARTITION BY filer, concept, unit ORDER BY event_id) - 1 AS INTEGER) AS pos, end_ AS end, start_ AS start, val, accn, segment FROM f")
def facts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts out of nested documents, one row each."""
    return X.facts_long(fact_documents(spark, sf_dir))


STATED = f"""{EVENTS}, g AS (SELECT f.filer, c.statement, c.canonical, c.concept_ord, CASE unit WHEN 'USD' THEN 1 WHEN 'USD/shares' THEN 2 WHEN 'shares' THEN 3 END AS u, event_id, end_, coalesce(start_, '') AS start_, val
  FROM f JOIN concepts c USING (concept) WHERE accn = '0000-1' AND segment IS NULL AND val IS NOT NULL),
l AS (SELECT *, min(concept_ord) OVER (PARTITION BY filer, statement, canonical) AS first_ FROM g),
m AS (SELECT *, min(CASE WHEN concept_ord = first_ THEN u END) OVER (PARTITION BY filer, statement, canonical) AS first_u FROM l),
v AS (SELECT filer, statement, canonical, end_, start_, arg_max(val, (concept_ord, event_id)) AS value FROM m WHERE (concept_ord = first_ AND u = first_u) OR (concept_ord > first_ AND u = 1) GROUP BY ALL),
n AS (SELECT filer, statement FROM v GROUP BY ALL HAVING count(DISTINCT canonical) >= 3),
r AS (SELECT v.*, dense_rank() OVER (PARTITION BY filer, statement ORDER BY end_ DESC) <= 4 AS late, coalesce(min(nullif(start_, '')) OVER (PARTITION BY filer, statement, end_), '') AS chosen FROM v JOIN n USING (filer, statement)),
q AS (SELECT DISTINCT filer, statement, end_ FROM r WHERE late), i AS (SELECT DISTINCT filer, statement, canonical FROM r)
SELECT i.filer, i.statement, i.canonical, q.end_ AS period_end, r.value FROM i JOIN q USING (filer, statement) LEFT JOIN r ON r.filer = i.filer AND r.statement = i.statement AND r.canonical = i.canonical AND r.end_ = q.end_ AND r.start_ = r.chosen"""


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = X.facts_long(fact_documents(spark, sf_dir))
    filings = facts.select("filer").distinct().withColumn("accession", F.lit("0000-1"))
    return X.statement_facts(facts, filings, concept_dim(spark))


@query(f"WITH {STATED}")
def facts_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of one filing for each filer: four latest period ends, longest durations."""
    return stated(spark, sf_dir).select("filer", "statement", "canonical", "period_end", "value")


@query()
def facts_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statements as markdown."""
    return X.render_statements(stated(spark, sf_dir))


@query(f"""
WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS filer, CASE o_orderkey % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-K/A' ELSE '10-Q' END AS form, strftime(o_orderdate, '%Y') AS y, o_orderkey FROM orders),
g AS (SELECT filer, rtrim(form, '/A') AS base, y, min(o_orderkey) AS o FROM s GROUP BY ALL), w AS (SELECT DISTINCT filer, form, y FROM s UNION SELECT DISTINCT filer, '20-F', y FROM s)
SELECT w.filer, w.form AS filing_type, w.y AS period_end, lpad(CAST(o AS VARCHAR), 10, '0') || '-24' AS accession FROM w LEFT JOIN g ON g.filer = w.filer AND g.y = w.y AND g.base = rtrim(w.form, '/A')""")
def find_accession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submission that a filing is, from parallel arrays; the first listed of a form and a period counts."""
    o = table(spark, sf_dir, "orders").selectExpr("cast(o_custkey AS string) AS filer", "struct(o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-K/A' ELSE '10-Q' END AS form, date_format(o_orderdate, 'yyyy') AS y) AS s")
    by = o.groupBy("filer").agg(F.array_sort(F.collect_list("s")).alias("s"))
    recent = F.expr("struct(transform(s, x -> lpad(x.o_orderkey, 10, '0') || '-24') AS accessionNumber, transform(s, x -> x.form) AS form, transform(s, x -> x.y) AS reportDate)")
    subs = X.submissions_long(by.select("filer", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json")))
    wanted = subs.select("filer", F.col("form").alias("filing_type"), F.col("report_date").alias("period_end"))
    return X.find_accession(subs, wanted.union(wanted.withColumn("filing_type", F.lit("20-F"))).distinct())


