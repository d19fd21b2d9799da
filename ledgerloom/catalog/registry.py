"""The registry, and the few expressions that the two SQL dialects spell differently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; without SQL it is tested against a brute-force version."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that a task of a scan reads, and tasks for each core where rows are dealt out.
SPLIT_BYTES, TASKS = 128 << 20, 4


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table, dealt out by a key where the table's files are too small to keep every core busy.

    A scan makes no more tasks than there are row groups, and one of a million short rows may be a minute's work of what
    follows.  Tables that a scan cuts into enough tasks by their bytes stay as they are.  What groups by the key afterwards
    finds its rows together.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= cores * SPLIT_BYTES:
        return df
    return df.repartition(TASKS * cores, key)


def money(x: str, duck: bool = False, places: int = 2) -> str:
    """SQL for a number with thousands marks."""
    return f"format('{{:,.{places}f}}', {x})" if duck else f"format_number({x}, {places})"


def words_date(x: str, duck: bool = False) -> str:
    """SQL for a date as 'June 05, 2024'."""
    return f"strftime({x}, '%B %d, %Y')" if duck else f"date_format({x}, 'MMMM dd, yyyy')"


def iso_date(x: str, duck: bool = False) -> str:
    return f"strftime({x}, '%Y-%m-%d')" if duck else f"date_format({x}, 'yyyy-MM-dd')"
