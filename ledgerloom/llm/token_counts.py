"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of frequent pre-tokens and their lengths in tokens, sent once to every worker.  Tier two is
a cache in each worker: a pre-token that misses the table is encoded there once and remembered.  A document's count is
the sum over its pre-tokens, so neither pre-tokens nor counts are ever shuffled.

The table comes from the whole corpus: each task keeps a Misra-Gries summary of a fixed number of counters, and the
summaries are merged (they stay valid summaries when merged), so that what moves is a fixed number of entries for each
task, not pre-tokens.  The table only saves work; counts are the same with any table, or none.

Defined results
---------------
* null text: null;  empty text: 0;
* very long texts: counted whole;  null ids, repeated rows: carried through, one row out for each row in;
* extra columns: not read;  empty table: empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.bpe import LONG, SPLIT, VOCABULARY, load_ranks
from ledgerloom.llm.common import map_arrow

#: Counters of a task's summary, and entries of the table.
COUNTERS = 4096
#: Pre-tokens a worker remembers before it starts afresh.
CACHE = 400_000


def shrink(counts: Counter, most: int) -> Counter:
    """A Misra-Gries summary of counts: the (most+1)-th largest count is taken off each, what is left stays."""
    if len(counts) <= most:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    off = int(np.partition(values, len(values) - most - 1)[len(values) - most - 1])
    return Counter({k: v - off for k, v in counts.items() if v > off})


def pack(counts: Counter) -> bytes:
    """A summary as one compact value: counts, then the pre-tokens with their lengths in bytes."""
    words = [w.encode("utf-8", "surrogatepass") for w in counts]
    head = np.array([len(words)], np.int64).tobytes()
    return head + np.fromiter(counts.values(), np.int64, len(words)).tobytes() + np.fromiter(map(len, words), np.int32, len(words)).tobytes() + b"".join(words)


def unpack(data: bytes) -> Counter:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    counts = np.frombuffer(data, np.int64, n, 8)
    ends = np.cumsum(np.frombuffer(data, np.int32, n, 8 + 8 * n))
    words, at, out = data[8 + 12 * n :], 0, Counter()
    for c, end in zip(counts.tolist(), ends.tolist()):
        out[words[at:end].decode("utf-8", "surrogatepass")] = c
        at = end
    return out


def frequent_pretokens(df: DataFrame, text_col: str = "text", pattern: str = SPLIT, counters: int = COUNTERS) -> Counter:
    """Frequent pre-tokens of the whole corpus; every one that makes up more than 1/counters of it is there.

    Tasks send one bounded summary each; those are merged in groups on the executors before the driver sees any.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, kept, n = regex.compile(pattern).findall, Counter(), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    kept.update(w for w in find(t) if len(w) <= LONG)
                    if len(kept) > 16 * counters:
                        kept = shrink(kept, counters)
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([pack(shrink(kept, counters))], pa.binary())], names=["summary"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = Counter(), 0
        for b in batches:
            for s in b.column(0).to_pylist():
                kept = shrink(kept + unpack(s), counters)
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([pack(kept)], pa.binary())], names=["summary"])

    sums = map_arrow(df.select(text_col), summarise, "summary binary")
    merged = map_arrow(sums.repartition(8, F.rand(7)), merge, "summary binary")  # a few KB for each task of the scan
    total: Counter = Counter()
    for row in merged.collect():  # at most 8 rows of bounded size
        total = shrink(total + unpack(bytes(row.summary)), counters)
    return total


class Lengths(dict):
    """Pre-token -> tokens: the table first, then this worker's cache, then an encoding."""

    def __init__(self, table: bytes, path: str, pattern: str):
        super().__init__()
        self.table = dict(unpack(table))
        self.update(self.table)
        ranks = load_ranks(path)
        self.encode = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


_LENGTHS: dict[tuple, Lengths] = {}


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = SPLIT, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, n_tokens) of every row."""
    spark = df.sparkSession
    frequent = frequent_pretokens(df, text_col, pattern, counters)
    ranks = load_ranks(path)
    encode = tiktoken.Encoding("table", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    sent = spark.sparkContext.broadcast(pack(Counter({w: len(encode(w)) for w in sorted(frequent)})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (sent.value, path, pattern)
        if key not in _LENGTHS:
            _LENGTHS.clear()
            _LENGTHS[key] = Lengths(*key)
        find, length = regex.compile(pattern).findall, _LENGTHS[key].__getitem__
        for b in batches:
            counts = [None if t is None else sum(map(length, find(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return map_arrow(df.select(id_col, text_col), run, "doc_id bigint, n_tokens bigint")
