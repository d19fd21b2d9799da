"""The whole way from pages to documents, as one plan of DataFrames.

pages -> report type -> sections -> repaired tables -> line items -> checks and scores -> documents.  Markdown is only
made at the end; everything before it stays in rows keyed by filing_id, so that any step can be queried by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions.labels import scale_hint
from ledgerloom.operators import confidence as C, detect, facts as X, lines, metadata as M, normalize as N, quality, render as R, repair, sections as S, validate as V
from ledgerloom.sources.dimensions import concept_dim, section_dim
from ledgerloom.sources.notes import structure_notes
from ledgerloom.sources.shared import written

STATEMENT_KEYS = ("income_statement", "balance_sheet", "cash_flow")
HINT_ORDER = ("income_statement", "comprehensive_income", "balance_sheet", "cash_flow", "stockholders_equity")


@dataclass
class Reports:
    """What a run gives.  The sections, the line items and the rendered parts have been written once; the rest is lazy."""

    documents: DataFrame
    sections: DataFrame
    normalized: DataFrame
    metadata: DataFrame
    checks: DataFrame
    scores: DataFrame
    rejected: DataFrame
    #: (filing_id, label, canonical): names of labels, those that a filing left open filled from the first that has one.
    mappings: DataFrame


def table_markdown(sections: DataFrame, names: DataFrame | None) -> DataFrame:
    """(filing_id, key, content) of statement sections: repaired tables, with canonical names where `names` has them."""
    fixed = sections.select("filing_id", "key", "text", repair.repair_tables("text", "tables").alias("fixed"))
    shown = F.when(F.col("fixed.instead") == "raw", F.col("text")).when(F.col("fixed.instead") == "clean", lines.clean_raw_text(F.col("text")))
    tables = fixed.select("filing_id", "key", F.posexplode("fixed.tables").alias("table_ix", "t"))
    if names is not None:
        by_table = names.groupBy("filing_id", "key", "table_ix").agg(F.array_sort(F.collect_list(F.struct("row_ix", "label", "canonical", "values"))).alias("rows"))
        tables = tables.join(by_table, ["filing_id", "key", "table_ix"], "left")
        rows = F.transform(F.coalesce("rows", F.array().cast("array<struct<row_ix:int,label:string,canonical:string,values:array<string>>>")), lambda r: F.concat(F.array(r["label"], r["canonical"]), r["values"]))
        head = F.transform(F.col("t.header"), lambda h: F.concat(F.slice(h, 1, 1), F.array(F.lit("Canonical")), F.slice(h, 2, F.greatest(F.size(h), F.lit(1)))))
        md = R.markdown_table(head, rows, F.col("t.width") + 1, 2)
    else:
        md = R.markdown_table(F.col("t.header"), F.col("t.rows"), F.col("t.width"))
    made = tables.select("filing_id", "key", "table_ix", md.alias("md")).groupBy("filing_id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_ix", "md"))), lambda x: x["md"]), "\n\n").alias("md"))
    joined = fixed.select("filing_id", "key", "text", shown.alias("shown")).join(made, ["filing_id", "key"], "left")
    content = F.coalesce("md", "shown", F.lit(""))
    return joined.select("filing_id", "key", F.when(content.contains("|"), content).otherwise(F.coalesce(repair.text_table("text"), content)).alias("content"))


def process_reports(spark: SparkSession, pages: DataFrame, parsed_at: str, facts: DataFrame | None = None, submissions: DataFrame | None = None, generate=None) -> Reports:
    """Documents and everything they rest on, from pages(filing_id, page_number, text, tables).

    facts and submissions are the long forms of structured data by filer; without them statements rest on the pages.
    Scanned reports are rejected as rows, not as an error.
    """
    pages = written(pages)  # whatever extracted them runs once
    guard = detect.scanned_guard(pages)
    rejected = guard.where("scanned").select("filing_id", F.lit("scanned").alias("reason"))
    usable = pages.join(rejected.select("filing_id"), "filing_id", "left_anti")
    kind = written(detect.report_type(usable).select("filing_id", "report_type"))  # five steps ask for it
    typed = written(usable.join(kind, "filing_id"))
    own, prefix = detect.drop_prefix(typed.where("report_type = 'sec'").drop("report_type"))
    abroad = typed.where("report_type = 'ifrs'").drop("report_type")
    own = written(own)
    starts = written(S.section_starts(own))  # headings are looked for once, for covers and for sections
    cover = S.cover_pages(own, starts)
    domestic, ifrs = S.split_sections(own, starts=starts), S.split_sections(abroad, ifrs=True)
    dim = section_dim(spark)
    kinds = F.broadcast(dim.select("key", F.col("kind").alias("section_kind")))
    found = written(domestic.unionByName(ifrs).join(kinds, "key"))

    # line items of the domestic statements
    statements = found.where("section_kind = 'statement' and key not like 'ifrs%'")
    normalized = written(N.normalize_rows(repair.repaired_rows(statements.where(F.size("tables") > 0))))
    data = written(N.statement_data(normalized).where(F.col("key").isin(*STATEMENT_KEYS)))

    # cover and front matter
    filings = kind.join(cover.select("filing_id", F.col("text").alias("cover_text")), "filing_id", "left").join(prefix, "filing_id", "left")
    # columns of their own: no Python function may stand inside a lambda
    filings = filings.withColumns({"own_fields": M.cover_fields(F.coalesce("cover_text", F.lit(""))), "prefix_fields": M.cover_fields(F.coalesce("prefix_text", F.lit("")))})
    fields = M.supplement(F.col("own_fields"), F.col("prefix_fields"))
    hint_ord = F.array_position(F.array(*map(F.lit, HINT_ORDER)), F.col("key"))
    hints = statements.withColumn("h", scale_hint(F.col("text"))).where("h is not null").groupBy("filing_id").agg(F.min_by("h", hint_ord).alias("scale_hint"))
    filings = filings.withColumn("fields", fields).join(hints, "filing_id", "left").withColumn("source_pdf", F.concat("filing_id", F.lit(".pdf")))
    filings = written(filings)
    meta = M.metadata(filings.where("report_type = 'sec'"), parsed_at)

    # structured facts of the same filing, where there are any
    structured = spark.createDataFrame([], "filing_id string, key string, canonical string, amounts array<double>")
    rendered = spark.createDataFrame([], "filing_id string, key string, content string")
    if facts is not None and submissions is not None:
        from ledgerloom.functions.labels import pad_cik

        wanted = meta.select("filing_id", pad_cik(F.col("meta.cik")).alias("filer"), F.col("meta.filing_type").alias("filing_type"), F.col("meta.period_end").alias("period_end")).where("filing_type <> '' and period_end <> ''")
        found_acc = X.find_accession(submissions, wanted.select("filer", "filing_type", "period_end").distinct()).where("accession is not null")
        mine = wanted.join(found_acc, ["filer", "filing_type", "period_end"])
        # filings of one filer are kept apart by a key of filer and filing
        keyed = facts.join(mine.select("filer", "filing_id", "accession"), "filer").withColumn("filer", F.col("filing_id"))
        long = X.statement_facts(keyed.drop("filing_id", "accession"), mine.select(F.col("filing_id").alias("filer"), "accession"), concept_dim(spark))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("period_ord", "value"))), lambda x: x["value"])
        structured = long.groupBy(F.col("filer").alias("filing_id"), F.col("statement").alias("key"), "canonical").agg(ordered.alias("amounts"))
        rendered = X.render_statements(long).select(F.col("filer").alias("filing_id"), F.col("statement").alias("key"), F.col("markdown").alias("content"))

    checks = written(V.run_checks(data))
    stated = statements.select("filing_id", "key").where(F.col("key").isin(*STATEMENT_KEYS)).union(structured.select("filing_id", "key").where(F.col("key").isin(*STATEMENT_KEYS)))
    structured = structured.where(F.col("key").isin(*STATEMENT_KEYS))
    differences = C.cross_validate(structured, data, ["filing_id", "key"])
    scores = C.confidence(stated, structured, data, differences, C.validation_status(checks), ["filing_id", "key"])

    # content of every section
    from_tables = table_markdown(statements, normalized).join(rendered.select("filing_id", "key"), ["filing_id", "key"], "left_anti")
    plain_tables = table_markdown(found.where("section_kind = 'statement' and key like 'ifrs%'"), None)
    notes = found.where("section_kind = 'notes'")
    noted = structure_notes(notes.where("key = 'notes'"), generate).withColumn("key", F.lit("notes")).unionByName(structure_notes(notes.where("key = 'ifrs_notes'"), generate, fallback_raw=True).withColumn("key", F.lit("ifrs_notes")))
    listed = found.where("section_kind = 'list'").select("filing_id", "key", lines.format_exhibits(F.col("text")).alias("content"))
    prose_in = found.where("section_kind = 'prose'")
    prose_tables = table_markdown(prose_in.where(F.size("tables") > 0), None).withColumnRenamed("content", "tables_md")
    prose = prose_in.join(prose_tables, ["filing_id", "key"], "left").select("filing_id", "key", lines.clean_prose(F.col("text"), F.coalesce("tables_md", F.lit(""))).alias("content"))
    covers = filings.where("cover_text is not null").select("filing_id", F.lit("cover_page").alias("key"), M.cover_table(F.col("fields"), F.col("cover_text")).alias("content"))
    processed = from_tables.unionByName(rendered).unionByName(plain_tables).unionByName(noted).unionByName(listed).unionByName(prose).unionByName(covers)
    processed = written(processed)

    # documents
    ordered = N.filing_sequence(kind.join(meta, "filing_id", "left").select("filing_id", F.col("filing_id").alias("filing_ord"), F.col("meta.period_end").alias("period_end")))
    several = F.lit(len(ordered.take(2)) > 1)
    seq = ordered.select("filing_id", F.when(several, F.col("filing_sequence")).alias("filing_sequence"))
    by = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("confidence").cast("string").alias("v")))))
    trust = scores.groupBy("filing_id").agg(by.alias("confidence_map"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "source")))).alias("source_map"))
    order = F.array_position(F.array(*map(F.lit, STATEMENT_KEYS)), F.col("key"))
    heads = kind.withColumn("stem", F.col("filing_id")).join(meta, "filing_id", "left").join(seq, "filing_id").join(trust, "filing_id", "left")
    matter = F.when(F.col("meta").isNotNull(), M.front_matter(F.col("meta"), F.col("filing_sequence"), {"data_sources": F.col("source_map"), "confidence": F.col("confidence_map")}))
    heads = heads.withColumn("front_matter", matter).join(V.render_checks(checks).withColumnRenamed("markdown", "validation"), "filing_id", "left").join(C.render_confidence(scores, differences, order).withColumnRenamed("markdown", "confidence"), "filing_id", "left")
    documents = R.assemble(heads.select("filing_id", "report_type", "stem", "front_matter", "validation", "confidence"), processed, dim)
    named = normalized.where("trim(label) <> ''").groupBy("filing_id", "label").agg(F.max_by("canonical", F.struct("key", "table_ix", "row_ix")).alias("canonical"))
    mappings = N.consistent_mappings(named.withColumnRenamed("filing_id", "filing_ord")).withColumnRenamed("filing_ord", "filing_id")
    return Reports(documents, found.drop("section_kind"), normalized, meta, checks, scores, rejected, mappings)


def evaluate_documents(documents: DataFrame) -> DataFrame:
    """The quality checks of rendered documents."""
    return quality.evaluate(documents)
