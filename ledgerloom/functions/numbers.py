"""Numbers as financial reports print them, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: What a cell may hold once marks are taken off; Spark's own cast would also take '12d'.
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DASHES = ("—", "–", "-")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it.

    Higher-order functions are interpreted, without the elimination of common parts that generated code has; an array
    of one element binds the value to a lambda variable.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]


#: What (?U)\s stands for in a pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def squash(c: Column) -> Column:
    """Strip white space of any kind from both ends; a pattern would be tried again at every gap between words."""
    return F.btrim(c, F.lit(WHITE))


def to_double(c: Column) -> Column:
    """A plain decimal literal as double, anything else null."""
    return F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double"))


def parse_numeric(c: Column) -> Column:
    """A displayed amount as double: currency signs and thousands marks go, brackets mean minus.

    Null for dashes, blanks, percentages and words.
    """
    return printed(squash(F.translate(c, "$€£", "")), lambda value, body: body(value))


def parse_numeric_inside(c: Column) -> Column:
    """parse_numeric for lambdas, where what is named repeatedly is not computed once unless it is bound."""
    return let(squash(F.translate(c, "$€£", "")), lambda bare: printed(bare, let))


def printed(bare: Column, bind: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    """A stripped amount without currency signs as double."""
    bracketed = bare.startswith("(") & bare.endswith(")") & (F.length(bare) > 2) & ~bare.rlike("[\n\r\x85\u2028\u2029]")
    digits = F.translate(squash(F.when(bracketed, F.substring(bare, 2, F.length(bare) - 2)).otherwise(bare)), ", ", "")
    value = bind(bind(digits, to_double), lambda v: F.when(bare.startswith("("), -v).otherwise(v))
    return F.when(bare.isin("", *DASHES), None).otherwise(value)


def is_numeric(c: Column) -> Column:
    """Whether a cell can stand in a value column; blanks and dashes can."""
    bare = squash(F.translate(F.coalesce(c, F.lit("")), "$, ", ""))
    digits = F.btrim(bare, F.lit("()"))
    return bare.isin("", *DASHES) | digits.rlike(PLAIN_NUMBER)


def format_amount(c: Column) -> Column:
    """A fact as printed: a long dash for none, whole numbers without decimals, others with two."""
    return F.when(c.isNull(), "—").when(c == F.floor(c), F.format_number(c, 0)).otherwise(F.format_number(c, 2))


def relative_difference(expected: Column, actual: Column) -> Column:
    """|expected - actual| over |expected|, over |actual| where nothing is expected; 0 where both are 0."""
    base = F.when(expected != 0, F.abs(expected)).otherwise(F.abs(actual))
    return F.when(base == 0, 0.0).otherwise(F.abs(expected - actual) / F.nullif(base, F.lit(0.0)))


def first_value(c: Column) -> Column:
    """The first element of an array that isn't null, or null."""
    return F.try_element_at(F.filter(c, lambda v: v.isNotNull()), F.lit(1))
