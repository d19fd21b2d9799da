"""Registered queries: each operator of the document engine applied to whole driver tables, with the same in DuckDB SQL.

The tables hold no reports, so inputs are rendered from their columns (amounts as printed, dates as words, pages with
headings) by the same expression in both dialects, and the operator works on what was rendered.
"""
