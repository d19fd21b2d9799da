"""Lines of texts: cleaning, headings, exhibits, chunks, glyphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.catalog.registry import query, table
from ledgerloom.operators import lines as X, repair

#: Every document in the dress of a report: page numbers, footers, a heading and an item around its text.
DRESSED = """'Overview of Business Results' || chr(10) || text || chr(10) || '  ' || (doc_id % 300) || ' ' || chr(10) || 'Acme Corp | 2024 Form 10-K | ' || (doc_id % 90) || chr(10)
   || 'F-' || (doc_id % 80) || chr(10) || 'See accompanying Notes to the statements' || chr(10) || 'Item 1A. Risk Factors' || chr(10) || (doc_id % 50) || ' Acme Corp Form 10-K' || chr(10)
   || 'and so it goes on' || chr(10) || chr(10) || 'Running Header Line' || chr(10) || 'some words F-12' || chr(10) || 'Running Header Line' || chr(10) || 'in the end' || chr(10) || 'Running Header Line'"""
LINES = f"SELECT doc_id, string_split({DRESSED}, chr(10)) AS x FROM documents WHERE text IS NOT NULL"
NUMBER, FOOTER, F_PAGE = "^ *[0-9]{1,3} *$", "(?i)^ *.{3,50} *[|] *[0-9]{4} +form +10-[kq](/a)? *[|] *[0-9]{1,3} *$", "^ *F-[0-9]{1,3} *$"
NOTES, NUMBERED = "(?i)^ *(see|the) +(accompanying +)?(notes? +to|the +notes)", "(?i)^ *[0-9]{1,3} +.{3,40} +(form +10-[kq]|annual +report)"


def dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", f"{DRESSED} AS dressed")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> ''),
k AS (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS x FROM l)
SELECT doc_id, CAST(generate_subscripts(x, 1) AS INTEGER) AS line_no, unnest(x) AS line FROM k""")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document."""
    return X.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT doc_id, line, count(*) AS times FROM l WHERE line <> '' GROUP BY ALL HAVING count(*) >= 3 AND length(line) < 120""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines that recur in one document."""
    return X.repeated_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
WITH l AS ({LINES}),
f AS (SELECT doc_id, list_filter(x, lambda s: NOT (regexp_matches(s, '{NUMBER}') OR regexp_matches(s, '{FOOTER}') OR regexp_matches(s, '{F_PAGE}') OR regexp_matches(s, '{NOTES}') OR regexp_matches(s, '{NUMBERED}'))) AS x FROM l)
SELECT doc_id, array_to_string(x, chr(10)) AS cleaned FROM f""")
def clean_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dressed documents without page furniture."""
    return dressed(spark, sf_dir).select("doc_id", X.clean_raw_text(F.col("dressed")).alias("cleaned"))


SUBHEADING = """(len(w(s)) BETWEEN 2 AND 10 AND length(s) < 80 AND NOT regexp_matches(s, '([,;:]|and|or)$') AND regexp_matches(s, '^\\p{Lu}')
  AND len(list_filter(w(s), lambda y: regexp_matches(y, '^\\p{Lu}'))) / greatest(len(w(s)), 1) >= 0.6 AND NOT regexp_matches(s, '^[A-Z][\\p{L}\\p{N}_]+ +[a-z].*[a-z] +[a-z]'))"""
SUBHEADING = SUBHEADING.replace("w(s)", "list_filter(regexp_split_to_array(s, '\\s+'), lambda y: y <> '')")


@query(f"""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS s FROM documents WHERE text <> '')
SELECT doc_id, s AS line FROM l WHERE {SUBHEADING}""")
def subheading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that read like sub-headings."""
    lines = X.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", X.squash(F.col("line")).alias("line"))
    return lines.where(X.is_subheading(F.col("line")))


@query(f"""
WITH l AS ({LINES}),
f AS (SELECT doc_id, list_transform(list_filter(x, lambda s: NOT (regexp_matches(s, '{NUMBER}') OR regexp_matches(s, '{FOOTER}') OR regexp_matches(s, '{F_PAGE}'))),
  lambda s: CASE WHEN s LIKE '|%' THEN s ELSE regexp_replace(s, '\\s+F-[0-9]{{1,3}}[.]?\\s*$', '') END) AS x FROM l),
t AS (SELECT doc_id, trim(unnest(x)) AS s, generate_subscripts(x, 1) AS i FROM f),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS times FROM t),
h AS (SELECT doc_id, i, CASE WHEN regexp_matches(s, '(?i)^item\\s+[0-9]+[a-z]?[.]\\s+.') OR {SUBHEADING} THEN '### ' || s ELSE s END AS s FROM n WHERE s = '' OR times < 3 OR length(s) >= 120),
p AS (SELECT *, lag(s, 1, '') OVER (PARTITION BY doc_id ORDER BY i) AS before FROM h),
j AS (SELECT doc_id, string_agg(CASE WHEN regexp_matches(s, '^[\\p{{Ll}}ªº]') AND before <> '' AND NOT starts_with(before, '#') THEN ' ' ELSE chr(10) END || s, '' ORDER BY i) AS s FROM p GROUP BY doc_id)
SELECT doc_id, trim(regexp_replace(s[2:], '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS prose FROM j""")
def clean_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dressed documents as markdown prose."""
    return dressed(spark, sf_dir).select("doc_id", X.clean_prose(F.col("dressed")).alias("prose"))


@query("""
SELECT l_orderkey, CASE WHEN count(*) >= 2 THEN string_agg('- ' || l_linenumber || '.' || (l_partkey % 40) || ' Agreement No ' || l_suppkey, chr(10) ORDER BY l_linenumber, l_partkey % 40 || ' ' || l_suppkey)
  ELSE string_agg(l_linenumber || '.' || (l_partkey % 40) || ' Agreement No ' || l_suppkey, chr(10)) END AS exhibits
FROM lineitem GROUP BY l_orderkey""")
def exhibit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exhibit for each line of an order, with page numbers in between."""
    line = "l_linenumber || '.' || (l_partkey % 40) || ' Agreement No ' || l_suppkey || chr(10) || '  ' || l_linenumber"
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"struct(l_linenumber AS n, l_partkey % 40 || ' ' || l_suppkey AS k, {line} AS t) AS r")
    texts = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "\n").alias("t"))
    return texts.select("l_orderkey", X.format_exhibits(F.col("t")).alias("exhibits"))


@query()
def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind a first note, packed into requests of 2,000 characters."""
    d = table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", "regexp_replace(text, '\n', '\nNote 7. ') AS t")
    return d.select("doc_id", F.posexplode(X.note_chunks(F.col("t"), 2000)).alias("pos", "chunk"))


@query()
def prose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a blank line before each line, packed into requests of 2,000 characters."""
    d = table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", "replace(text, '\n', '\n\n') AS t")
    return d.select("doc_id", F.posexplode(X.prose_chunks(F.col("t"), 2000)).alias("pos", "chunk"))


@query("SELECT p_partkey, CASE WHEN length(p_name) < 3 THEN regexp_replace(p_name, '(.)', '\\1\\1', 'g') ELSE p_name END AS name FROM part")
def glyph_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that were overprinted, each character twice."""
    twice = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", "(.)", "$1$1").alias("t"))
    return twice.select("p_partkey", repair.collapse_glyphs("t").alias("name"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'capital / surplus' WHEN 1 THEN 'treasury / retained' ELSE c_name END AS header FROM customer""")
def deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotated headers whose characters came out in turns, and names that stay as they are."""
    turns = lambda a, b: "".join(x + y for x, y in zip(a, b))
    mixed = F.when(F.col("c_custkey") % 3 == 0, turns("capital", "surplus")).when(F.col("c_custkey") % 3 == 1, turns("treasury", "retained")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", repair.deinterleave(mixed).alias("header"))


@query(r"""
WITH t AS (SELECT [[c_name, CAST(c_nationkey AS VARCHAR)], ['', c_mktsegment]] AS t, c_custkey FROM customer)
SELECT c_custkey, 'Table 1:' || chr(10) || t[1][1] || ' | ' || t[1][2] || chr(10) || ' | ' || t[2][2] AS prompt FROM t""")
def tables_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as text for a prompt, with missing cells."""
    t = "array(array(array(c_name, cast(c_nationkey AS string)), array(cast(null AS string), c_mktsegment))) AS t"
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", t).select("c_custkey", X.tables_prompt(X.fill_cells(F.col("t"))).alias("prompt"))


@query(r"""SELECT page_id, regexp_replace(trim(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g')), '\s+', ' ', 'g') AS body FROM pages""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the article element of a page, tags out: text extraction without a model."""
    tagless = F.regexp_replace(F.regexp_extract("html", r"(?s)<article[^>]*>(.*?)</article>", 1), "<[^>]+>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.trim(tagless), r"\s+", " ").alias("body"))
