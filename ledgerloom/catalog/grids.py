"""Table repair, on grids made of the lines of orders: an order is a table, a line a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.catalog.registry import money, query, spread, table
from ledgerloom.operators import render as R, repair as T

#: What orders the rows of a table; line numbers recur within an order.
KEY = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


#: The line below the header of a table of three columns, as SQL.
RULE = "'| " + " | ".join([":---"] + 2 * ["---:"]) + " |'"


def one(duck: bool = False) -> str:
    return money("l_extendedprice", duck)


def two(duck: bool = False) -> str:
    return money("l_quantity * 100", duck)


def shown(rows: Column) -> Column:
    """A table on one line."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), ";")


def tables(spark: SparkSession, sf_dir: str, row: str) -> DataFrame:
    """(l_orderkey, t): a table for each order, its rows made by `row`."""
    rows = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").selectExpr("l_orderkey", f"struct({KEY}, {row} AS r) AS x")
    return rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("t"))


def rows_sql(line: str, where: str = "true") -> str:
    """DuckDB: the lines of an order as one string."""
    return f"coalesce(string_agg({line}, ';' ORDER BY {KEY}) FILTER ({where}), '')"


@query(f"""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'Net income of ' || l_partkey WHEN 1 THEN 'Net Sales of ' || l_partkey ELSE 'Part ' || l_partkey END || '|$ ' || {one(True)} || '|$ (' || {two(True)} || ')|' || CAST(l_linenumber AS VARCHAR) || '%' AS cells
FROM lineitem""")
def collapse_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse rows as label and values, with labels that the grid cut."""
    head = "CASE l_linenumber % 3 WHEN 0 THEN array('Net in', 'come of ' || l_partkey) WHEN 1 THEN array('Net', '', 'Sales of ' || l_partkey) ELSE array('Part ' || l_partkey) END"
    row = f"concat({head}, array('', '$', '', {one()}, '', null, '$', '(' || {two()}, ')', '', cast(l_linenumber AS string), '%'))"
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").selectExpr("l_orderkey", "l_linenumber", f"{row} AS r").select("l_orderkey", "l_linenumber", F.array_join(T.collapse_row("r"), "|").alias("cells"))


@query(f"""
SELECT l_orderkey, CASE WHEN count(*) FILTER (l_linenumber % 3 <> 0) = 0 THEN {rows_sql(f"'Part ' || l_partkey || '|$ ' || {one(True)}")}
  ELSE {rows_sql(f"'Part ' || l_partkey || '|$ ' || {one(True)} || '|' || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '$ ' || {two(True)} END")} END AS cells
FROM lineitem GROUP BY l_orderkey""")
def collapse_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide tables in which some rows lack a value: values stay in their columns."""
    second = f"CASE WHEN l_linenumber % 3 = 0 THEN array('', '') ELSE array('$', {two()}) END"
    row = f"concat(array('Part ' || l_partkey, '', '', '$', {one()}, '', ''), {second}, array('', ''))"
    return tables(spark, sf_dir, row).select("l_orderkey", shown(T.collapse_table("t")).alias("cells"))


@query(f"""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'As of June 05, 2024|' || {one(True)} || '|—' WHEN 1 THEN 'Sales of kind ' || chr(CAST(65 + l_partkey % 26 AS INTEGER)) || '|$ ' || {one(True)} || '|(' || {two(True)} || ')|12%'
  ELSE 'nothing but words' END AS cells
FROM lineitem""")
def split_single_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came as one string."""
    t = f"""CASE l_linenumber % 3 WHEN 0 THEN 'As of June 05, 2024 ' || {one()} || ' —' WHEN 1 THEN 'Sales of kind ' || chr(65 + l_partkey % 26) || ' $ ' || {one()} || ' (' || {two()} || ') 12%'
      ELSE 'nothing but words' END AS t"""
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").selectExpr("l_orderkey", "l_linenumber", t).select("l_orderkey", "l_linenumber", F.array_join(T.split_line("t"), "|").alias("cells"))


@query(f"""
SELECT l_orderkey, CASE WHEN count(*) >= 3 THEN {rows_sql(f"'Part ' || l_partkey || '|' || {one(True)} || '|' || {two(True)}")}
  ELSE {rows_sql(f"'Part ' || l_partkey || '|' || l_linenumber || '|' || {one(True)} || '|' || {two(True)}")} END AS cells
FROM lineitem GROUP BY l_orderkey""")
def note_ref_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with a column of note numbers."""
    row = f"array('Part ' || l_partkey, cast(l_linenumber AS string), {one()}, {two()})"
    return tables(spark, sf_dir, row).select("l_orderkey", shown(T.strip_note_refs("t")).alias("cells"))


@query(f"""
SELECT l_orderkey, {rows_sql(f"'Part ' || l_partkey || '|' || {one(True)}")} || ';Total liabilities and stockholders|' || chr(39) || ' equity|5' || CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE ';after|1' END AS cells
FROM lineitem GROUP BY l_orderkey""".replace("stockholders|' || chr(39) || ' equity|5'", "stockholders' || CASE WHEN l_orderkey % 2 = 0 THEN '''' ELSE '' END || ' equity|' || CASE WHEN l_orderkey % 2 = 0 THEN '5' ELSE 'n/a' END"))
def grand_total_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that go on after their grand total; a total row without an amount ends nothing."""
    row = f"array('Part ' || l_partkey, {one()})"
    even = F.col("l_orderkey") % 2 == 0
    total = F.array(F.concat(F.lit("Total liabilities and stockholders"), F.when(even, "'").otherwise(""), F.lit(" equity")), F.when(even, "5").otherwise("n/a"))
    full = F.concat("t", F.array(total, F.array(F.lit("after"), F.lit("1"))))
    return tables(spark, sf_dir, row).select("l_orderkey", shown(T.cut_after_total(full)).alias("cells"))


@query(f"""SELECT l_orderkey, 'June 30, 2024|June 30, 2023;' || {rows_sql(f"'Part ' || l_partkey || '|' || {one(True)}")} || ';Other|1' AS cells FROM lineitem GROUP BY l_orderkey""")
def inner_header_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with a scale line and a repeated row of dates inside."""
    dates = F.array(F.lit("June 30, 2024"), F.lit("June 30, 2023"))
    full = F.concat(F.array(dates), F.col("t"), F.array(F.array(F.lit("(in thousands)"), F.lit("")), dates, F.array(F.lit("Other"), F.lit("1"))))
    return tables(spark, sf_dir, f"array('Part ' || l_partkey, {one()})").select("l_orderkey", shown(T.strip_inner_headers(full)).alias("cells"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 17 WHEN 1 THEN 16 ELSE NULL END AS merged_rows, CASE WHEN c_custkey % 4 IN (0, 1) THEN 1 ELSE 2 END AS n_tables FROM customer""")
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and their continuation: joined, joined without the repeated row, titled, and both small."""
    long = "transform(sequence(1, 15), i -> array('Item ' || i, cast(i AS string)))"
    t = f"""CASE c_custkey % 4 WHEN 0 THEN array({long}, array(array('More', '1'), array('Rest', '2'))) WHEN 1 THEN array({long}, array(array('Item 1', '1'), array('Rest', '2')))
      WHEN 2 THEN array({long}, array(array('A title of its own', ''), array('Rest', '2'))) ELSE array(slice({long}, 1, 5), array(array('More', '1'))) END AS t"""
    c = spread(table(spark, sf_dir, "customer"), "c_custkey").selectExpr("c_custkey", t).select("c_custkey", T.merge_pages("t").alias("m"))
    return c.select("c_custkey", F.when(F.size("m") == 1, F.size(F.col("m")[0])).alias("merged_rows"), F.size("m").alias("n_tables"))


@query("""SELECT c_custkey, c_custkey % 5 IN (0, 3) AS prose, c_custkey % 5 = 4 AS paragraph FROM customer""")
def prose_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running text that was taken for a table: long, in many columns, or a paragraph."""
    words = "array('word', 'word', 'word', 'word')"
    t = f"""CASE c_custkey % 5 WHEN 0 THEN transform(sequence(1, 51), i -> {words}) WHEN 1 THEN transform(sequence(1, 50), i -> {words}) WHEN 2 THEN transform(sequence(1, 60), i -> array('Line', '1,234', '5,678', '9,012'))
      WHEN 3 THEN transform(sequence(1, 6), i -> array('the company may', 'from time to time', 'be party to a', 'claim that it', 'did not expect', 'to be in'))
      ELSE array(array('{"a long paragraph that goes on and on " * 3}', ''), array('{"and another one that is as long as that " * 2}', '')) END AS t"""
    return spread(table(spark, sf_dir, "customer"), "c_custkey").selectExpr("c_custkey", t).select("c_custkey", T.prose_like("t").alias("prose"), T.paragraph_like("t").alias("paragraph"))


@query(f"""
SELECT l_orderkey, CASE WHEN count(*) >= 2 THEN '|  | 2024 | 2023 |' || chr(10) || {RULE} || chr(10) || '| Total | 2024 | 2023 |' || chr(10) ||
  string_agg('| Sales of ' || p || ' | ' || {one(True)} || ' | ' || {two(True)} || ' |', chr(10) ORDER BY {KEY}) END AS markdown
FROM (SELECT *, chr(CAST(65 + l_partkey % 26 AS INTEGER)) AS p FROM lineitem) GROUP BY l_orderkey""")
def text_as_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that exist only as lines of text, with a note number after each label; the line of years counts as data."""
    line = f"concat('Sales of ', chr(65 + l_partkey % 26), ' 7 ', {one()}, ' ', {two()})"
    texts = tables(spark, sf_dir, line).select("l_orderkey", F.concat(F.lit("Statement\n2024 2023\n"), F.array_join("t", "\n")).alias("text"))
    return texts.select("l_orderkey", T.text_table("text").alias("markdown"))


HEADS = """CASE c_custkey % 5 WHEN 0 THEN 'Three Months Ended June 30, Six Months Ended June 30,' || chr(10) || '2024 2023 2024 2023' WHEN 1 THEN 'Year Ended December 31,' || chr(10) || '2024 2023'
    WHEN 2 THEN 'June 30, December 31,' || chr(10) || '2024 2023' WHEN 3 THEN c_name || chr(10) || '2024 2023 2022' ELSE c_name END"""


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '|Three Months Ended June 30, 2024|Three Months Ended June 30, 2023|Six Months Ended June 30, 2024|Six Months Ended June 30, 2023' WHEN 1 THEN '|Year Ended December 31, 2024|Year Ended December 31, 2023'
  WHEN 2 THEN '|June 30, 2024|December 31, 2023' WHEN 3 THEN '|2024|2023|2022' ELSE '' END AS header FROM customer""")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows from the periods and years that a statement's text announces."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{HEADS} AS t", "CASE c_custkey % 5 WHEN 0 THEN 5 WHEN 3 THEN 4 ELSE 3 END AS width")
    h = c.select("c_custkey", "width", T.column_headers("t").alias("h"))
    return h.select("c_custkey", shown(T.header_rows("h.periods", "h.years", "width")).alias("header"))


@query(f"""
SELECT l_orderkey, 'Deferred items|$ 12|$ 13;' || {rows_sql(f"'Part ' || l_partkey || '|' || {one(True)} || '|' || {two(True)}")} AS cells FROM lineitem GROUP BY l_orderkey""")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stand in the text above a table only."""
    t = tables(spark, sf_dir, f"array('Part ' || l_partkey, {one()}, {two()})")
    text = F.concat(F.lit("(in thousands)\n2024 2023\nDeferred items\n$ 12 $ 13\n"), F.col("t")[0][0], F.lit(" 5 6\nlater $ 7 $ 8"))
    return t.select("l_orderkey", shown(F.concat(T.orphan_rows(text, "t"), F.col("t"))).alias("cells"))


@query(f"""
SELECT l_orderkey, '|  | 2024 | 2023 |' || chr(10) || {RULE} || chr(10) || string_agg('| Part ' || l_partkey || ' | $ ' || {one(True)} || ' | $ (' || {two(True)} || ') |', chr(10) ORDER BY {KEY}) AS markdown
FROM lineitem GROUP BY l_orderkey""")
def repaired_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repairs of a statement in turn, rendered: sparse cells, split brackets, a header from the text."""
    row = f"array('Part ' || l_partkey, '', '$', {one()}, '', '$', '(' || {two()}, ')')"
    t = tables(spark, sf_dir, row).select("l_orderkey", T.repair_tables(F.lit("A statement\n2024 2023\n"), F.array("t")).alias("fixed"))
    x = F.col("fixed.tables")[0]
    return t.select("l_orderkey", R.markdown_table(x["header"], x["rows"], x["width"]).alias("markdown"))


@query(f"""
SELECT n_nationkey, '|  | Region | Key |' || chr(10) || {RULE} || chr(10) || '| ' || n_name || ' | ' || r_name || ' | ' || n_nationkey || ' |' || chr(10) || '| too few |  |  |' AS markdown
FROM nation JOIN region ON r_regionkey = n_regionkey""")
def render_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of a table with a short and a long row."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.expr("r_regionkey = n_regionkey"))
    rows = F.expr("array(array(n_name, '  ' || r_name || '\n', cast(n_nationkey AS string), 'too many'), array('too few'))")
    head = F.array(F.array(F.lit(""), F.lit("Region"), F.lit("Key")))
    return n.select("n_nationkey", R.markdown_table(head, rows, F.lit(3)).alias("markdown"))


@query(f"""
SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN '| Item 2024 | June 30, 2023 | June 30, |' ELSE '| Item | June 30, | December 31, |' END || chr(10) || {RULE} || chr(10)
  || string_agg('| Part ' || l_partkey || ' | ' || {one(True)} || ' | ' || CASE WHEN l_linenumber = 2 AND n > 1 THEN '—' ELSE {two(True)} END || ' |', chr(10) ORDER BY {KEY}) AS markdown
FROM (SELECT *, CASE WHEN count(*) FILTER (l_linenumber = 2) OVER (PARTITION BY l_orderkey) = 1 THEN count(*) OVER (PARTITION BY l_orderkey) END AS n FROM lineitem) GROUP BY l_orderkey""")
def own_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that bring their header, in one row or in two with years in the second; short rows end in a dash.

    Blank cells are gone by then, so years join the titles from the left.
    """
    n = "CASE WHEN count_if(l_linenumber = 2) OVER (PARTITION BY l_orderkey) = 1 THEN count(*) OVER (PARTITION BY l_orderkey) END AS n"
    rows = table(spark, sf_dir, "lineitem").selectExpr("*", n)
    row = f"CASE WHEN l_linenumber = 2 AND n > 1 THEN array('Part ' || l_partkey, {one()}) ELSE array('Part ' || l_partkey, {one()}, {two()}) END"
    t = rows.selectExpr("l_orderkey", f"struct({KEY}, {row} AS r) AS x").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("t"))
    heads = F.when(F.col("l_orderkey") % 2 == 0, F.expr("array(array('Item', 'June 30,', 'June 30,'), array('', '2024', '2023'))")).otherwise(F.expr("array(array('Item', 'June 30,', 'December 31,'))"))
    fixed = t.select("l_orderkey", T.repair_tables(F.lit("A statement"), F.array(F.concat(heads, "t"))).alias("fixed"))
    x = F.col("fixed.tables")[0]
    return fixed.select("l_orderkey", R.markdown_table(x["header"], x["rows"], x["width"]).alias("markdown"))
