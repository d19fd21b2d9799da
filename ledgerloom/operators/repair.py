"""Arrow operators on texts, rows and tables: kernels of :mod:`ledgerloom.functions.kernels`, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.arrow import arrow_udf, native_udf
from ledgerloom.functions import kernels as k

ROW, TABLE, TABLES = "array<string>", "array<array<string>>", "array<array<array<string>>>"


def list_of(kind: pa.DataType) -> pa.DataType:
    return pa.list_(pa.field("element", kind))


A_ROW = list_of(pa.string())
A_TABLE = list_of(A_ROW)
ARROW = {"string": pa.string(), "boolean": pa.bool_(), ROW: A_ROW, TABLE: A_TABLE, TABLES: list_of(A_TABLE)}


def plain(x, depth: int):
    """Nested lists with empty strings for missing cells and empty lists for missing rows."""
    if x is None:
        return [] if depth else ""
    if depth == 0:
        return x
    if depth == 1:
        return ["" if c is None else c for c in x]
    return [plain(y, depth - 1) for y in x]


def arrow(fn: Callable, returns: str, depth: int = 0) -> Callable[[Column], Column]:
    """A Column function from a kernel on strings (0), rows (1), tables (2) or lists of tables (3); null stays null."""

    @native_udf(returns, ARROW[returns])
    def run(given: list) -> list:
        return [None if x is None else fn(plain(x, depth)) for x in given]

    return run


collapse_glyphs = arrow(lambda t: "\n".join(map(k.collapse_glyphs, t.split("\n"))), "string")
deinterleave = arrow(k.deinterleave, "string")
clean_cells = arrow(lambda ts: [[[k.deinterleave(k.collapse_glyphs(c)) for c in r] for r in t] for t in ts], TABLES, 3)
collapse_row = arrow(k.collapse_row, ROW, 1)
collapse_table = arrow(k.collapse_table, TABLE, 2)
split_line = arrow(k.split_line, ROW)
strip_note_refs = arrow(k.strip_note_refs, TABLE, 2)
cut_after_total = arrow(k.cut_after_total, TABLE, 2)
strip_inner_headers = arrow(k.strip_inner_headers, TABLE, 2)
merge_pages = arrow(k.merge_pages, TABLES, 3)
prose_like = arrow(k.prose_like, "boolean", 2)
paragraph_like = arrow(k.paragraph_like, "boolean", 2)
text_table = arrow(lambda t: k.text_table(t, *k.column_headers(t)), "string")


@arrow_udf("struct<periods:array<string>,years:array<string>>")
def column_headers(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([k.column_headers(t or "") for t in texts], columns=["periods", "years"])


@native_udf(TABLE, A_TABLE)
def orphan_rows(text: list, table: list) -> list:
    return [None if t is None or b is None else k.orphan_rows(t, plain(b, 2)) for t, b in zip(text, table)]


@native_udf(TABLE, A_TABLE)
def header_rows(periods: list, years: list, width: list) -> list:
    return [k.header_rows(plain(p, 1), plain(y, 1), int(w)) for p, y, w in zip(periods, years, width)]


@native_udf(
    "struct<instead:string,tables:array<struct<header:array<array<string>>,rows:array<array<string>>,width:int>>>",
    pa.struct([("instead", pa.string()), ("tables", list_of(pa.struct([("header", A_TABLE), ("rows", A_TABLE), ("width", pa.int32())])))]),
)
def repair_tables(text: list, tables: list) -> list:
    """All repairs of a section's tables; `instead` names the text to show where no table is left."""
    out = (k.repair_tables(t or "", plain(b, 3)) for t, b in zip(text, tables))
    return [{"instead": i, "tables": [{"header": h, "rows": r, "width": w} for h, r, w in ts]} for i, ts in out]


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two strings, in this order."""

    @arrow_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else k.similarity(p, q) for p, q in zip(x, y)], dtype=float)

    return run(a, b)


def repaired_rows(sections: DataFrame) -> DataFrame:
    """(filing_id, key, table_ix, row_ix, row) of every repaired table row of `sections(filing_id, key, text, tables)`."""
    fixed = sections.select("filing_id", "key", repair_tables("text", "tables").alias("fixed"))
    tables = fixed.select("filing_id", "key", F.posexplode("fixed.tables").alias("table_ix", "t"))
    return tables.select("filing_id", "key", "table_ix", F.posexplode("t.rows").alias("row_ix", "row"))
