"""The registered queries of the document engine and their SQL."""

from __future__ import annotations

from ledgerloom.catalog import grids, items, reports, scalars, segments, texts  # noqa: F401  (modules register themselves)
from ledgerloom.catalog.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
