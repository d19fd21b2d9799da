"""Token ids as wavelet matrices, one compressed file for each shard.

A shard holds the ids of some documents, one after another.  Ids are recoded by falling frequency, so that the upper
bit-planes are almost empty; each plane is cut into blocks that are compressed on their own and carry the number of
ones before them.  A reader answers, from the one file and with a few blocks unpacked: the token at a place, how often
a token occurs before a place (rank), where its k-th occurrence is (select), all occurrences, and whole documents.

Layout: magic, length of the header, header (JSON), then the arrays that the header lists by name, dtype and length.

Shards are cut where the scan is cut, by a bounded number of tokens, so that nothing is shuffled.

Defined results
---------------
* null text: the document is there with a length of -1 and reads as None;  empty text: length 0;
* a very long text is never divided: a shard has at least one document and may exceed its bound by one;
* null ids, repeated rows: a place of their own each;  extra columns: not read;  empty table: no shard;
* a shard without a token has no plane and still lists its documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.taskcontext import TaskContext

from ledgerloom.llm.bpe import SPLIT, VOCABULARY, load_ranks
from ledgerloom.llm.common import map_arrow

MAGIC = b"WVLT0001"
BLOCK = 4096  # bytes of a plane in one block
SHARD_TOKENS = 2_000_000
NO_ID = -(1 << 63)  # stands for a null id


def build(tokens: np.ndarray, ids: list[int | None], lengths: list[int], level: int = 1) -> bytes:
    """The file of one shard; lengths: tokens of each document, -1 for null."""
    values, counts = np.unique(tokens, return_counts=True)
    alphabet = values[np.lexsort((values, -counts))].astype(np.int32)
    bits = int(len(alphabet) - 1).bit_length() if len(alphabet) > 1 else 0
    arrays: list[tuple[str, np.ndarray]] = [
        ("ids", np.array([NO_ID if i is None else i for i in ids], np.int64)),
        ("lengths", np.array(lengths, np.int64)),
        ("alphabet", alphabet),
    ]
    if len(tokens):
        code_of = np.zeros(int(values[-1]) + 1, np.uint16 if bits <= 16 else np.uint32)
        code_of[alphabet] = np.arange(len(alphabet))
        codes = code_of[tokens]
        compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        for p in range(bits - 1, -1, -1):
            ones = (codes >> p & 1).astype(bool)
            packed = np.packbits(ones)
            padded = np.zeros(-(-len(packed) // BLOCK) * BLOCK, np.uint8)
            padded[: len(packed)] = packed
            sums = np.bitwise_count(padded.reshape(-1, BLOCK)).sum(1, dtype=np.int64)
            parts = []
            for k in range(0, len(packed), BLOCK):
                raw = packed[k : k + BLOCK].tobytes()
                small = compress(raw)
                parts.append(small if len(small) < len(raw) else raw)  # a block of full size is stored as it is
            arrays += [
                (f"before{p}", np.r_[0, np.cumsum(sums)].astype(np.int64)),
                (f"ends{p}", np.cumsum([len(x) for x in parts]).astype(np.int64)),
                (f"data{p}", np.frombuffer(b"".join(parts), np.uint8)),
            ]
            codes = np.concatenate([codes[~ones], codes[ones]])
    listed, body = [], []
    for name, a in arrays:
        raw = a.tobytes()
        small = raw if name.startswith("data") else zstandard.compress(raw, 3)
        listed.append([name, a.dtype.str, len(small)])
        body.append(small)
    head = json.dumps({"tokens": len(tokens), "bits": bits, "arrays": listed}).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(body)


class WaveletShard:
    """Reads one file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        n = int.from_bytes(data[8:16], "little")
        head = json.loads(data[16 : 16 + n])
        self.n, self.bits, at, got = head["tokens"], head["bits"], 16 + n, {}
        for name, kind, size in head["arrays"]:
            raw = data[at : at + size]
            got[name] = np.frombuffer(raw if name.startswith("data") else zstandard.decompress(raw), kind)
            at += size
        self.arrays = got
        self.ids = [None if i == NO_ID else i for i in got["ids"].tolist()]
        self.lengths, self.alphabet = got["lengths"], got["alphabet"]
        self.starts = np.r_[0, np.cumsum(np.maximum(self.lengths, 0))]
        self.code_of = {int(t): k for k, t in enumerate(self.alphabet)}
        self.block = lru_cache(maxsize=4096)(self._block)
        self.zeros = {p: self.n - int(got[f"before{p}"][-1]) for p in range(self.bits)}

    def _block(self, p: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ones before each byte) of one block."""
        ends = self.arrays[f"ends{p}"]
        lo, hi = int(ends[k - 1]) if k else 0, int(ends[k])
        raw = self.arrays[f"data{p}"][lo:hi].tobytes()
        size = min(BLOCK, -(-self.n // 8) - k * BLOCK)
        data = np.frombuffer(raw if len(raw) == size else zstandard.decompress(raw), np.uint8)
        return data, np.r_[0, np.cumsum(np.bitwise_count(data), dtype=np.int64)]

    def ones(self, p: int, i: int) -> int:
        """Ones of plane p before place i."""
        k, bit = divmod(i, 8 * BLOCK)
        total = int(self.arrays[f"before{p}"][k])
        if bit:
            data, before = self.block(p, k)
            byte, rest = divmod(bit, 8)
            total += int(before[byte]) + (int(data[byte] >> (8 - rest)).bit_count() if rest else 0)
        return total

    def bit(self, p: int, i: int) -> int:
        k, bit = divmod(i, 8 * BLOCK)
        return int(self.block(p, k)[0][bit >> 3]) >> (7 - (bit & 7)) & 1

    def place(self, p: int, value: int, k: int) -> int:
        """The place of the k-th (from 0) bit of that value in plane p."""
        before = self.arrays[f"before{p}"]
        sums = before if value else np.arange(len(before)) * 8 * BLOCK - before
        b = int(np.searchsorted(sums, k, "right")) - 1
        bits = np.unpackbits(self.block(p, b)[0])
        return b * 8 * BLOCK + int(np.flatnonzero(bits == value)[k - int(sums[b])])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for p in range(self.bits - 1, -1, -1):
            b = self.bit(p, i)
            code = code << 1 | b
            i = self.zeros[p] + self.ones(p, i) if b else i - self.ones(p, i)
        return int(self.alphabet[code])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the token's occurrences in [lo, hi) lie after the last plane."""
        code = self.code_of.get(int(token))
        if code is None:
            return 0, 0
        for p in range(self.bits - 1, -1, -1):
            a, b = self.ones(p, lo), self.ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if code >> p & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before place i."""
        lo, hi = self._range(token, 0, i)
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the token in [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        code, i = self.code_of[int(token)], lo + k
        for p in range(self.bits):
            one = code >> p & 1
            i = self.place(p, one, i - self.zeros[p] if one else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def documents(self) -> Iterator[tuple[int | None, list[int] | None]]:
        """(id, tokens) of every document: all planes undone at once."""
        codes = np.zeros(self.n, np.int64)
        at = np.arange(self.n)
        for p in range(self.bits - 1, -1, -1):
            blocks = len(self.arrays[f"ends{p}"])
            bits = np.unpackbits(np.concatenate([self._block(p, k)[0] for k in range(blocks)]))[: self.n]
            before = np.r_[0, np.cumsum(bits, dtype=np.int64)][:-1]
            b = bits[at]
            codes = codes << 1 | b
            at = np.where(b == 1, self.zeros[p] + before[at], at - before[at])
        tokens = self.alphabet[codes] if self.n else np.zeros(0, np.int32)
        for k, i in enumerate(self.ids):
            yield i, None if self.lengths[k] < 0 else tokens[self.starts[k] : self.starts[k + 1]].tolist()

    def document_at(self, i: int) -> int | None:
        """The id of the document that holds place i."""
        return self.ids[int(np.searchsorted(self.starts, i, "right")) - 1]


_ENCODINGS: dict[tuple[str, str], tiktoken.Encoding] = {}


def wavelet_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, path: str = VOCABULARY, pattern: str = SPLIT) -> DataFrame:
    """(shard_id, doc_ids, n_tokens, payload): every document of df in exactly one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _ENCODINGS:
            _ENCODINGS[path, pattern] = tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        encode = _ENCODINGS[path, pattern].encode_to_numpy
        part, made = TaskContext.get().partitionId(), 0
        ids, lengths, tokens, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            joined = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            columns = [pa.array([f"{part:06d}-{made:04d}"]), pa.array([ids], pa.list_(pa.int64())), pa.array([len(joined)], pa.int64()), pa.array([build(joined, ids, lengths)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard_id", "doc_ids", "n_tokens", "payload"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                row = encode(t, disallowed_special=()) if t else np.zeros(0, np.uint32)
                lengths.append(-1 if t is None else len(row))
                tokens.append(row)
                held += len(row)
                if held >= shard_tokens:
                    yield shard()
                    made += 1
                    ids, lengths, tokens, held = [], [], [], 0
        if ids:
            yield shard()

    return map_arrow(df.select(id_col, text_col), run, "shard_id string, doc_ids array<bigint>, n_tokens bigint, payload binary")


def write_shard_files(shards: DataFrame, folder: str) -> DataFrame:
    """Write each payload of `shards` to its own file in a folder that all executors share; (shard_id, path, bytes).

    A file is written under another name and then renamed, so that a task that runs again leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            paths, sizes = [], []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = os.path.join(folder, f"{name}.wvlt")
                with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data)
                os.replace(part, path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths), pa.array(sizes, pa.int64())], names=["shard_id", "path", "bytes"])

    return map_arrow(shards.select("shard_id", "payload"), run, "shard_id string, path string, bytes bigint")
