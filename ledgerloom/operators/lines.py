"""Operators on the lines of a page or section text.

Short, per-document work stays inside one row as higher-order functions over the array of lines, so that cleaning a
text needs no shuffle; :func:`explode_lines` gives the long form where lines are the unit of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.numbers import let, squash
from ledgerloom.functions.phrases import phrase

LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
#: The ends that are rare; without one of them a text is cut at a plain character, which needs no pattern.
RARE_ENDS = r"[\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
NUMBER = r"\d\d?\d?"
PAGE_NUMBER = rf"(?U)^\s*{NUMBER}\s*$"
FORM = r"Form\s+10-[KQ]"
PAGED_FOOTER = rf"(?iU)^\s*.{{3,50}}\s*\|\s*\d{{4}}\s+{FORM}(/A)?\s*\|\s*\d{{1,3}}\s*$"
F_PAGE = rf"(?U)^\s*F-{NUMBER}\s*$"
SEE_NOTES = r"(?iU)^\s*(See|The)\s+(accompanying\s+)?(Notes?\s+to|The\s+Notes)"
NUMBERED_FOOTER = rf"(?iU)^\s*\d{{1,3}}\s+.{{3,40}}\s+({FORM}|Annual\s+Report)"
CONTENTS_HEADER = "(?iU)^\\s*" + phrase("[Financial] Table of Contents") + r"\b"
TRAILING_F_PAGE = rf"(?U)\s+F-{NUMBER}[.]?\s*$"
ITEM = r"(?iU)^Item\s+[0-9]+[a-z]?[.]\s+."
LOW = "[a-z]"
SENTENCE_LIKE = rf"(?U)^[A-Z]\w+\s+{LOW}.*{LOW}\s+{LOW}"
EXHIBIT = r"(?U)^\d{1,3}(\.\d{1,3})?(\.\w+)?\s"
REPEATS, REPEAT_CHARS = 3, 120


def split_lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end opens no further line."""
    cut = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(let(F.when(text.rlike(RARE_ENDS), F.split(text, LINE_ENDS, -1)).otherwise(F.split(text, "\n", -1)), cut))


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def without(lines: Column, *patterns: str) -> Column:
    """Lines that match none of the patterns."""
    for p in patterns:
        lines = F.filter(lines, unlike(p))
    return lines


def unlike(pattern: str):
    return lambda x: ~x.rlike(pattern)


def explode_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 1, line), one row for each line."""
    return df.select(id_col, F.posexplode(split_lines(F.col(text_col))).alias("pos", "line")).select(id_col, (F.col("pos") + 1).alias("line_no"), "line")


def clean_raw_text(text: Column) -> Column:
    """Text without page numbers, footers and references to the notes."""
    return join_lines(without(split_lines(text), PAGE_NUMBER, PAGED_FOOTER, F_PAGE, SEE_NOTES, NUMBERED_FOOTER))


def is_subheading(s: Column) -> Column:
    """A short line in title case that isn't a sentence."""

    def title_case(words: Column) -> Column:
        upper = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        return F.size(words).between(2, 10) & (upper / F.greatest(F.size(words), F.lit(1)) >= 0.6)

    shape = (F.length(s) < 80) & s.rlike(r"^\p{Lu}") & ~s.rlike("([,;:]|and|or)$") & ~s.rlike(SENTENCE_LIKE)
    return shape & let(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""), title_case)


def repeated_lines(df: DataFrame, id_col: str, text_col: str, least: int = REPEATS, chars: int = REPEAT_CHARS) -> DataFrame:
    """(id, line, times): running headers, that is short lines that recur in one text."""
    lines = explode_lines(df, id_col, text_col).select(id_col, squash(F.col("line")).alias("line")).where("line <> ''")
    return lines.groupBy(id_col, "line").agg(F.count("*").alias("times")).where((F.col("times") >= least) & (F.length("line") < chars))


def drop_repeated(lines: Column) -> Column:
    """The array form of the same: an array of distinct recurring lines, found by sorting, is looked up."""

    def recurring(ordered: Column) -> Column:
        ahead = F.slice(ordered, REPEATS, F.greatest(F.size(ordered), F.lit(1)))
        pairs = F.zip_with(ordered, ahead, lambda a, b: F.when((a == b) & (F.length(a) < REPEAT_CHARS), a))
        return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))

    def drop(given: Column) -> Column:
        again = let(F.array_sort(F.filter(F.transform(given, squash), lambda x: x != "")), recurring)
        return let(again, lambda a: F.when(F.size(a) == 0, given).otherwise(F.filter(given, lambda x: ~F.array_contains(a, squash(x)))))

    return let(lines, drop)


def mark_headings(lines: Column) -> Column:
    """Stripped lines, items and sub-headings as third-level headings."""
    mark = lambda x: F.when(x.rlike(ITEM) | is_subheading(x), F.concat(F.lit("### "), x)).otherwise(x)
    return F.transform(F.transform(lines, squash), mark)


def rejoin(lines: Column) -> Column:
    """Join lines that go on in lower case to the line before them.

    Whether a line breaks off depends on it and its predecessor alone (a joined line begins in lower case and can't be
    empty or a heading), so the separators can be chosen pairwise and no fold is needed.
    """
    goes_on = lambda p, x: x.rlike(r"^[\p{Ll}ªº]") & (p != "") & ~p.startswith("#")

    def join(given: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.slice(given, 1, F.greatest(F.size(given) - 1, F.lit(0))))
        parts = F.zip_with(before, given, lambda p, x: F.concat(F.when(goes_on(p, x), F.lit(" ")).otherwise(F.lit("\n")), x))
        return F.substring(F.array_join(parts, ""), 2, 2147483647)

    return let(lines, join)


def squeeze(text: Column) -> Column:
    return squash(F.regexp_replace(text, "\n{3,}", "\n\n"))


def clean_prose(text: Column, tables_md: Column | None = None) -> Column:
    """A prose section as markdown: page furniture out, headings marked, broken lines joined, tables appended."""
    lines = without(split_lines(text), PAGE_NUMBER, PAGED_FOOTER, CONTENTS_HEADER, F_PAGE)
    lines = F.transform(lines, lambda x: F.when(x.rlike(r"(?U)^\s*\|"), x).otherwise(F.regexp_replace(x, TRAILING_F_PAGE, "")))
    out = squeeze(rejoin(mark_headings(drop_repeated(lines))))
    if tables_md is None:
        return out
    return F.when(tables_md.contains("|"), F.concat(out, F.lit("\n\n"), tables_md)).otherwise(out)


def format_exhibits(text: Column) -> Column:
    """Exhibits as a list; with fewer than two of them, prose."""

    def listed(lines: Column) -> Column:
        marked = F.transform(lines, lambda x: F.when(x.rlike(EXHIBIT), F.concat(F.lit("- "), x)).otherwise(x))
        return F.when(F.size(F.filter(lines, lambda x: x.rlike(EXHIBIT))) >= 2, squeeze(join_lines(marked)))

    return F.coalesce(let(without(F.transform(split_lines(text), squash), PAGE_NUMBER), listed), clean_prose(text))


def split_chunks(text: Column, limit: int, boundary: str) -> Column:
    """Pieces of at most `limit` characters, cut before boundaries and packed greedily; one piece may exceed it alone."""
    parts = F.filter(F.split(text, boundary), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, part: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(part) > limit)
        done = F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, part).otherwise(F.concat(acc["open"], part)).alias("open"))

    folded = F.aggregate(parts, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(folded)


def note_chunks(text: Column, limit: int = 100_000) -> Column:
    """Notes for one request each: cut before notes, or before headings where no note begins a line."""
    note, head = r"(?iU)(?=\n\s*Note\s+\d+[-\s.:—])", r"(?U)(?=\n\s*##?#?\s)"
    return F.when(F.size(F.split(text, note)) > 1, split_chunks(text, limit, note)).otherwise(split_chunks(text, limit, head))


def prose_chunks(text: Column, limit: int = 100_000) -> Column:
    """Prose for one request each: cut before items, headings and blank lines."""
    return split_chunks(text, limit, r"(?i)(?=\nItem\s+\d+)|(?=\n#{1,3} )|(?=\n\n)")


def tables_prompt(tables: Column) -> Column:
    """Tables as plain text for a prompt: cells by bars, rows by lines, tables by their number."""
    rows = lambda t: F.array_join(F.transform(t, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")
    return F.array_join(F.transform(tables, lambda t, i: F.concat(F.lit("Table "), (i + 1).cast("string"), F.lit(":\n"), rows(t))), "\n\n")


def fill_cells(tables: Column) -> Column:
    """Empty strings for missing cells."""
    return F.transform(tables, lambda t: F.transform(t, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))))
