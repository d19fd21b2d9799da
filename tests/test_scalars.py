import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import labels as L, numbers as N


def values(spark, column, inputs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("v"))).collect()]


def test_parse_numeric(spark):
    cases = {"1,234": 1234.0, "(500)": -500.0, "$1,234": 1234.0, "$ (1,234)": -1234.0, "1,234.56": 1234.56, "€500": 500.0, "—": None, "-": None, "–": None, "": None, "  ": None, "12%": None, "12d": None, "words": None, "1e5": 1e5, "5.": 5.0}
    assert values(spark, N.parse_numeric, cases) == list(cases.values())
    assert values(spark, N.parse_numeric, [None]) == [None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-10**12, 10**12), min_size=20, max_size=50))
def test_printed_amounts_read_back(spark, cents):
    amounts = [c / 100 for c in cents]
    shown = [f"$ ({-a:,.2f})" if a < 0 else f"{a:,.2f}" for a in amounts]
    assert values(spark, N.parse_numeric, shown) == amounts


def test_is_numeric(spark):
    assert values(spark, N.is_numeric, ["$ 1,000", "(5)", "", "—", "12%", "Total", "3.5", None]) == [True, True, True, True, False, False, True, True]


@pytest.mark.parametrize("period, want", [("June 30, 2024", "2024-06-30"), ("june 3 2024", "2024-06-03"), ("June 30,2024", "2024-06-30"), ("Jun 30, 2024", ""), ("June 31, 2024", ""), ("2024", "")])
def test_period_date(spark, period, want):
    assert values(spark, L.period_date, [period]) == [want]


def test_period_types(spark):
    rows = [("10-Q", "June 30, 2024", None, "Q2"), ("10-Q", "December 31, 2024", None, "Q?"), ("10-K", "December 31, 2024", None, "FY"), ("10-K/A", "x", 3, "FY"), ("10-Q", "June 30, 2024", 9, "Q3"), ("10-Q", "no date", 9, "Q?"), ("10-Q", "December 28, 2024", 9, "Q1")]
    df = spark.createDataFrame(rows, "f string, p string, e int, want string")
    for r in df.select("want", L.period_type(F.col("f"), F.col("p"), F.col("e")).alias("got")).collect():
        assert r.got == r.want


def test_scale(spark):
    assert values(spark, L.scale, ["(in thousands)", "millions, shares in thousands", "in billions", "", None]) == ["thousands", "millions", "billions", "units", "units"]


def test_identifiers(spark):
    assert values(spark, L.pad_cik, ["320193", " 1 ", "12345678901"]) == ["0000320193", "0000000001", "12345678901"]
    assert values(spark, L.form_base, ["10-K/A", "10-q", "A"]) == ["10-K", "10-Q", ""]
    assert values(spark, L.yaml_value, ["plain", "a: b", 'say "x"']) == ["plain", '"a: b"', '"say \\"x\\""']
