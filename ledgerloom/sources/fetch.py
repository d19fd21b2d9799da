"""Structured data over HTTP: company facts and submissions, one document for each filer.

Filers are made distinct first, so that each is asked for once, and are spread over a fixed number of tasks that keep
their own distance between requests; together they stay below the rate that the service allows.  The transport is a
parameter: tests and archives bring their own.  A request that fails becomes a row with its error, for this filer alone.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.labels import pad_cik

#: Where the documents of a filer lie; the filer is padded to ten digits.
FACTS = "https://data.sec.gov/api/xbrl/companyfacts/CIK{filer}.json"
SUBMISSIONS = "https://data.sec.gov/submissions/CIK{filer}.json"
PER_SECOND, TIMEOUT = 10.0, 30.0
FETCHED = "filer string, json string, error string"
Transport = Callable[[str], str]


class FetchError(Exception):
    """A request that gave no document."""


def http(agent: str, timeout: float = TIMEOUT) -> Transport:
    """GET over HTTP.  The service asks for an agent that names whom it can write to."""
    if "@" not in agent:
        raise FetchError("the agent must hold a mail address")

    def get(url: str) -> str:
        asked = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": "application/json"})
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as answer:
                return answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            raise FetchError(f"{url} answered {e.code}: {e.reason}") from e
        except urllib.error.URLError as e:
            raise FetchError(f"{url} can't be reached: {e.reason}") from e

    return get


def fetch(filers: DataFrame, url: str, transport: Transport, per_second: float = PER_SECOND, tasks: int = 1) -> DataFrame:
    """(filer, json, error) of every distinct filer of filers(filer); null filers are left out.

    Lazy, and asks again whenever it is computed again: write the result before using it twice.  A task that is repeated
    after a loss asks again for its filers.
    """
    gap = tasks / per_second

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = -gap
        for b in batches:
            rows = []
            for filer in b["filer"]:
                time.sleep(max(0.0, last + gap - time.monotonic()))
                last = time.monotonic()
                try:
                    rows.append((filer, transport(url.format(filer=filer)), None))
                except Exception as e:  # reported as data, for this filer alone
                    rows.append((filer, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["filer", "json", "error"])

    wanted = filers.select(pad_cik(F.col("filer").cast("string")).alias("filer")).where("filer is not null").distinct()
    return wanted.repartition(tasks, "filer").mapInPandas(run, FETCHED)
