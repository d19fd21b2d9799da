"""Arrow UDFs that can be declared before there is a session (their types are parsed on first use)."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F


def arrow_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def declare(fn: Callable) -> Callable[..., Column]:
        @functools.wraps(fn)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(fn, returns)(*columns)

        return call

    return declare


def native_udf(returns: str, like) -> Callable[[Callable], Callable[..., Column]]:
    """As arrow_udf, for functions from lists to a list, without pandas: it makes an array object of every nested row.

    like: the Arrow type of the result.
    """

    def declare(fn: Callable) -> Callable[..., Column]:
        def run(*arrays: pa.Array) -> pa.Array:
            return pa.array(fn(*[a.to_pylist() for a in arrays]), like)

        @functools.wraps(fn)
        def call(*columns: Column | str) -> Column:
            return F.arrow_udf(run, returns)(*columns)

        return call

    return declare
