"""Checks of rendered documents: rows (doc, check, passed, message, details).

Most checks are expressions on the text or on its sections as an array, so that evaluating documents is one map without
a shuffle.  CHECKS is where further ones are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.numbers import let, squash
from ledgerloom.operators.lines import split_lines

FINANCIAL = tuple(f"Consolidated {x}" for x in ("Balance Sheets", *(f"Statements of {y}" for y in ("Income", "Cash Flows", "Stockholders' Equity"))))
PROSE = ("Notes to Financial Statements", "Management's Discussion and Analysis")
EXPECTED = {"10-Q": ("Cover Page", *FINANCIAL, *PROSE), "10-K": ("Cover Page", *FINANCIAL, *PROSE, "Risk Factors")}
MAY_BE_EMPTY = r"(?i)Reserved|Mine Safety|None\.?|Not Applicable"
LEAST_CHARS, LEAST_ROWS, SHOWN = 20, 5, 10
SECTIONS = "array<struct<title:string,content:string>>"


def filing_type(md: Column) -> Column:
    found = F.regexp_extract(md, r"[|]\s*Filing Type\s*[|]\s*(10-[KQ](?:/A)?)\s*[|]", 1)
    return F.when(found == "", "10-Q").otherwise(found)


def sections(md: Column) -> Column:
    """Titles and contents of the second-level headings; of equal titles the last content counts, at the first's place."""
    parts = F.split(F.concat(F.lit("\n"), F.array_join(split_lines(md), "\n")), r"\n(?=## .)")
    heads = F.filter(parts, lambda p: p.startswith("## "))
    made = F.transform(heads, lambda p: F.struct(squash(F.substring(F.substring_index(p, "\n", 1), 4, 100000)).alias("title"), squash(F.when(p.contains("\n"), F.substr(p, F.instr(p, "\n") + 1)).otherwise("")).alias("content")))

    def last_of_each(m: Column) -> Column:
        titles = F.array_distinct(F.transform(m, lambda s: s["title"]))
        last = lambda t: F.struct(t.alias("title"), F.element_at(F.filter(m, lambda s: s["title"] == t), -1)["content"].alias("content"))
        return let(titles, lambda ts: F.when(F.size(ts) == F.size(m), m).otherwise(F.transform(ts, last)))

    return let(made, last_of_each)


def section_like(s: Column, name: str) -> Column:
    """The first section whose title contains a name, or null."""
    return F.try_element_at(F.filter(s, lambda x: F.lower(x["title"]).contains(name.lower())), F.lit(1))


def compact(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def verdict(details: Column, good: str | Callable[[Column], Column], bad: Callable[[Column], Column], shown: int | None = None) -> Column:
    """Passed without details; the messages are made from the details, which are found once."""

    def made(d: Column) -> Column:
        fine = F.lit(good) if isinstance(good, str) else good(d)
        listed = F.slice(d, 1, shown) if shown else d
        return F.struct((F.size(d) == 0).alias("passed"), F.when(F.size(d) == 0, fine).otherwise(bad(d)).alias("message"), listed.alias("details"))

    return let(details, made)


def counted(words: str) -> Callable[[Column], Column]:
    return lambda d: text(F.size(d), words)


def section_completeness(md: Column, s: Column, kind: Column) -> Column:
    out = None
    for name in ("10-Q", "10-K"):
        missing = compact([F.when(section_like(s, e).isNull(), text("Missing: ", e)) for e in EXPECTED[name]])
        message = lambda d, n=len(EXPECTED[name]): text(F.lit(n) - F.size(d), f"/{n} expected sections found")
        one = verdict(missing, message, message)
        out = one if out is None else F.when(kind == name, one).otherwise(out)
    return out


def tables_formatted(md: Column, s: Column, kind: Column) -> Column:
    bad = compact([let(section_like(s, f), lambda one: F.when(~one["content"].contains("|"), text(one["title"], ": no pipe-delimited table found"))) for f in FINANCIAL])
    return verdict(bad, "All present financial sections have markdown tables", counted(" section(s) lack tables"))


def no_stray_page_numbers(md: Column, s: Column, kind: Column) -> Column:
    named = F.transform(split_lines(md), lambda x, i: F.when(x.rlike(r"(?U)^\s*[0-9]{1,3}\s*$"), text("Line ", i + 1, ": '", squash(x), "'")))
    details = F.filter(named, lambda x: x.isNotNull())
    return verdict(details, "No stray page numbers", counted(" stray page number(s)"), SHOWN)


def pipes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def table_structure(md: Column, s: Column, kind: Column) -> Column:
    """Every run of lines that start with a bar has as many bars as its first line, which a fold carries along.

    The fold sees the number of bars of each line, 0 where a line doesn't start with one.
    """
    start = F.struct(F.lit(0).alias("first"), F.array().cast("array<string>").alias("bad"))
    bars = F.transform(split_lines(md), lambda x, i: F.struct((i + 1).alias("n"), F.when(x.rlike(r"(?U)^\s*\|"), pipes(x)).otherwise(0).alias("bars")))

    def step(acc: Column, x: Column) -> Column:
        off = (x["bars"] > 0) & (acc["first"] > 0) & (x["bars"] != acc["first"])
        bad = F.when(off, F.array_append(acc["bad"], text("Line ", x["n"], ": expected ", acc["first"], " pipes, got ", x["bars"]))).otherwise(acc["bad"])
        return F.struct(F.when((x["bars"] > 0) & (acc["first"] > 0), acc["first"]).otherwise(x["bars"]).alias("first"), bad.alias("bad"))

    bad = F.aggregate(bars, start, step, lambda acc: acc["bad"])
    return verdict(bad, "All tables have consistent column counts", counted(" column count mismatch(es)"), SHOWN)


def no_empty_sections(md: Column, s: Column, kind: Column) -> Column:
    short = F.filter(s, lambda x: (F.length(x["content"]) <= LEAST_CHARS) & ~x["content"].rlike(MAY_BE_EMPTY) & ~x["title"].rlike(MAY_BE_EMPTY))
    details = F.transform(short, lambda x: text(x["title"], ": only ", F.length(x["content"]), " chars"))
    return verdict(details, "All sections have content", counted(" empty section(s)"))


def prose_quality(md: Column, s: Column, kind: Column) -> Column:
    items = []
    for name in PROSE:
        flat = lambda one: ~one["content"].contains("### ") & (F.length(one["content"]) > 200)
        items.append(let(section_like(s, name), lambda one, flat=flat: F.array(F.when(flat(one), text(one["title"], ": no ### subheadings found")), F.when(one["content"].contains("\n\n\n\n"), text(one["title"], ": has 4+ consecutive blank lines")))))
    bad = F.filter(F.concat(*items), lambda x: x.isNotNull())
    return verdict(bad, "Prose sections have good structure", counted(" prose quality issue(s)"))


def cover_page_fields(md: Column, s: Column, kind: Column) -> Column:
    cover = F.coalesce(section_like(s, "cover page")["content"], F.lit(""))
    names = compact([F.when(~cover.contains(f), F.lit(f)) for f in ("Filing Type", "Company", "Period")])
    details = F.transform(names, lambda n: text("Missing field: ", n))
    made = verdict(details, "Cover Page has all required fields", lambda d: text("Missing: ", F.array_join(F.transform(d, lambda x: F.replace(x, F.lit("Missing field: "), F.lit(""))), ", ")))
    none = F.struct(F.lit(False).alias("passed"), F.lit("No Cover Page section found").alias("message"), F.array().cast("array<string>").alias("details"))
    return F.when(cover == "", none).otherwise(made)


def table_density(md: Column, s: Column, kind: Column) -> Column:
    items = []
    rows = lambda one: F.size(F.filter(F.transform(split_lines(one["content"]), squash), lambda x: x.startswith("|") & ~x.rlike(r"(?U)^\|[-\s:|]+\|$")))
    few = lambda one: let(rows(one), lambda n: F.when(one.isNotNull() & (n < LEAST_ROWS), text(one["title"], ": only ", n, " table row(s)")))
    for name in FINANCIAL:
        items.append(let(section_like(s, name), few))
    bad = compact(items)
    return verdict(bad, "Financial sections have sufficient data rows", counted(" sparse section(s)"))


def no_artifacts(md: Column, s: Column, kind: Column) -> Column:
    contents = F.regexp_count(F.lower(md), F.lit("table of contents"))
    odd = F.regexp_count(md, F.lit("�"))
    refs = F.regexp_count(md, F.lit(r"(?U)(?<!Form )\bF-\d+\b"))
    bad = compact([
        F.when(contents > 2, text("'Table of Contents' appears ", contents, " times")),
        F.when(odd > 0, text("Unicode replacement character appears ", odd, " time(s)")),
        F.when(refs > 3, text("F-N page references found: ", refs, " occurrences")),
    ])
    return verdict(bad, "No PDF artifacts detected", counted(" artifact type(s) found"))


#: name -> check(text, sections, filing type); append to add one.
CHECKS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "section_completeness": section_completeness,
    "financial_tables_formatted": tables_formatted,
    "no_stray_page_numbers": no_stray_page_numbers,
    "table_structure_valid": table_structure,
    "no_empty_sections": no_empty_sections,
    "prose_quality": prose_quality,
    "cover_page_fields": cover_page_fields,
    "table_density": table_density,
    "no_pdf_artifacts": no_artifacts,
}


def evaluate(documents: DataFrame, id_col: str = "filing_id", content_col: str = "content", checks: list[str] | None = None) -> DataFrame:
    """(filing_id, pos, check, passed, message, details) of every check on every document."""
    d = documents.select(F.col(id_col).alias("filing_id"), F.col(content_col).alias("md"))
    d = d.withColumn("s", sections(F.col("md"))).withColumn("kind", filing_type(F.col("md")))
    names = checks or list(CHECKS)
    made = [F.struct(F.lit(k).alias("pos"), F.lit(n).alias("check"), CHECKS[n](F.col("md"), F.col("s"), F.col("kind")).alias("r")) for k, n in enumerate(names)]
    return d.select("filing_id", F.explode(F.array(*made)).alias("c")).select("filing_id", "c.pos", "c.check", "c.r.passed", "c.r.message", "c.r.details")


def report(results: DataFrame) -> DataFrame:
    """(filing_id, markdown): the checks of each document as a list."""
    mark = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    line = F.concat(F.lit("- **"), mark, F.lit("** `"), F.col("check"), F.lit("`: "), F.col("message"))
    full = F.when(F.col("passed"), line).otherwise(F.concat(line, F.array_join(F.transform("details", lambda d: F.concat(F.lit("\n  - "), d)), "")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", full.alias("l")))), lambda x: x["l"]), "\n")
    return results.groupBy("filing_id").agg(F.concat(F.lit("## "), F.col("filing_id"), F.lit("\n\n"), body, F.lit("\n")).alias("markdown"))


def totals(results: DataFrame) -> DataFrame:
    """(passed, failed) over all documents."""
    return results.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
