"""Packing documents into training windows by minimum bin slack.

Every window is filled as close to its capacity as the remaining documents allow: the longest remaining piece opens it,
and a subset-sum over the multiset of remaining lengths (a bitset of reachable fills, one big integer, with every
length's count split into powers of two) gives the best fill of the rest; walking the steps back gives how many pieces
of each length it takes.  Windows with the same pattern are emitted together as long as the counts last.

A document longer than a window is cut into full windows and one remainder; nothing is dropped.  Only (doc_id, n_tokens)
is shuffled, by a hash of the id, into shards of a bounded number of documents; each shard is packed on its own, and the
slack of a shard is that of its last windows.

Defined results
---------------
* null or empty text: no tokens, so the document takes no place in any window;
* null ids and repeated rows: each row is packed;  ties between equal lengths: by doc_id;
* very long texts: any number of windows;  empty table: no windows;  extra columns: not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.bpe import SPLIT, VOCABULARY, load_ranks
from ledgerloom.llm.common import map_arrow

CAPACITY = 2048
#: Documents of a shard: the unit that is packed together.
SHARD_DOCS = 20_000

WINDOWS = "window_id string, doc_ids array<bigint>, starts array<int>, lengths array<int>, n_tokens int, slack int"

_ENCODINGS: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    if (path, pattern) not in _ENCODINGS:
        _ENCODINGS[path, pattern] = tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return _ENCODINGS[path, pattern]


def text_lengths(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY, pattern: str = SPLIT) -> DataFrame:
    """(doc_id, n_tokens) with 0 for null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return map_arrow(df.select(id_col, text_col), run, "doc_id bigint, n_tokens bigint")


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """[(length, times)] whose sum is the largest not above room; exact, by a bitset subset-sum.

    Among equal sums the one found with longer pieces first is taken.  lengths: falling, each with counts > 0.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps, full = 1, [], 1 << room
    for size in lengths:
        if size > room:
            continue
        left, power = min(counts[size], room // size), 1
        while left > 0:
            k = min(power, left)
            grown = reach | (reach << (size * k)) & mask
            if grown != reach:
                steps.append((reach, size, k))
                reach = grown
                if reach & full:
                    break
            left -= k
            power *= 2
        if reach & full:
            break
    fill = reach.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for before, size, k in reversed(steps):
        if not before >> fill & 1:  # this fill needs the step
            taken[size] += k
            fill -= size * k
    return sorted(taken.items(), reverse=True)


def pack_lengths(pieces: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Windows for a multiset {length: count}, as ([(length, times)], how many such windows), until nothing is left."""
    counts = {n: c for n, c in pieces.items() if c > 0}
    order = sorted(counts, reverse=True)
    while order:
        top = order[0]
        counts[top] -= 1
        if not counts[top]:
            order.pop(0)
        pattern = dict(best_fill(order, counts, capacity - top)) if top < capacity else {}
        pattern[top] = pattern.get(top, 0) + 1
        counts[top] += 1
        times = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            counts[n] -= k * times
        order = [n for n in (order if order and order[0] == top else [top, *order]) if counts[n]]
        yield sorted(pattern.items(), reverse=True), times


def pack_shard(shard: int, ids: list, sizes: list[int], capacity: int) -> dict[str, list]:
    """The windows of one shard of (doc_id, tokens), in a fixed order."""
    out: dict[str, list] = {k: [] for k in ("window_id", "doc_ids", "starts", "lengths", "n_tokens", "slack")}

    def emit(parts: list[tuple]) -> None:
        n = sum(p[2] for p in parts)
        out["window_id"].append(f"{shard:06d}-{len(out['window_id']):08d}")
        out["doc_ids"].append([p[0] for p in parts])
        out["starts"].append([p[1] for p in parts])
        out["lengths"].append([p[2] for p in parts])
        out["n_tokens"].append(n)
        out["slack"].append(capacity - n)

    by_size: dict[int, list[tuple]] = defaultdict(list)
    rows = sorted(zip(ids, sizes), key=lambda r: (r[0] is None, r[0] or 0, r[1]), reverse=True)  # taken from the end
    for i, n in rows:
        full, rest = divmod(n, capacity)
        for k in range(full):
            emit([(i, k * capacity, capacity)])
        if rest:
            by_size[rest].append((i, full * capacity, rest))
    for pattern, times in pack_lengths({n: len(v) for n, v in by_size.items()}, capacity):
        for _ in range(times):
            emit([by_size[n].pop() for n, k in pattern for _ in range(k)])
    return out


def pack_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, path: str = VOCABULARY, pattern: str = SPLIT) -> DataFrame:
    """Windows over all documents of df: which documents, from which token, how many tokens of each."""
    shards = max(1, -(-df.select(id_col).count() // shard_docs))
    sized = text_lengths(df, id_col, text_col, path, pattern).where("n_tokens > 0")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        cols = pack_shard(key[0].as_py(), t.column("doc_id").to_pylist(), t.column("n_tokens").to_pylist(), capacity)
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32())
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(cols.items(), kinds)})

    keyed = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInArrow(run, WINDOWS)
