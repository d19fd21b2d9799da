"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The bytes of a pre-token are mapped to Latin-1, so that an Aho-Corasick automaton over the vocabulary reports, in one
pass, the longest token that starts at each byte.  Encoding then walks from left to right and takes the longest token
that is compatible with the token before it; where none is, it backtracks.  Two adjacent tokens are compatible when
merging their joined bytes gives exactly these two tokens again, and a sequence whose neighbours are all compatible is
the sequence the merges give.  Compatibility is memoised, so the walk is linear in the bytes.

Pre-tokens recur, so each Python worker also keeps the ids of those it has seen (bounded, emptied when full).

Defined results
---------------
* null text: null ids and a null count;  empty text: no ids;
* ids decode to exactly the bytes of the text;
* very long texts are encoded whole; a very long run without a split is one long pre-token, still in linear time;
* null ids, repeated rows: carried through, one row out for each row in;  extra columns: not read;
* empty table: empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerloom.llm.common import map_arrow

#: Where the public vocabularies lie on this machine; pass another path elsewhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is split before merging: contractions, letters, digits, other marks, white space.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a worker remembers before it starts afresh; bounds memory, never changes a result.
CACHE = 400_000
LONG = 64  # longer pre-tokens are not remembered
BIG = 1 << 62


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> id from a file of ``base64 id`` lines; the id is also the rank of the merge."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Exact byte-level BPE over a ranked vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
            self.halves[i] = (i, i)
            if len(token) > 1 and (cut := self._cut(token, i)):
                left, right = ranks[token[:cut]], ranks[token[cut:]]
                self.pair.setdefault((left, right), i)
                self.halves[i] = (left, right)
            for k in range(len(token) - 1, 0, -1):
                if (s := ranks.get(token[:k])) is not None:
                    self.shorter[i] = s
                    break
        self.automaton.make_automaton()
        #: Tokens that the merges reach from their own bytes; others never come out of an encoding.
        self.whole = {t: i for t, i in ranks.items() if len(t) == 1 or self.halves[i] != (i, i)}

    def _cut(self, token: bytes, rank: int) -> int:
        """Where the last merge that builds token joins its two parts; 0 if merges of lower rank don't leave two."""
        parts = self._merge(token, rank)
        return len(parts[0]) if len(parts) == 2 else 0

    def _merge(self, data: bytes, below: int = BIG) -> list[bytes]:
        """The definition: join the adjacent pair of lowest rank (the leftmost of equals), until none is below the limit."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], BIG)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges keep left and right apart, read off the merges along their common border."""
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            known = self.compatible[key] = self._fits(left, right)
            if len(self.compatible) > 4 * CACHE:
                self.compatible.clear()
        return known

    def _fits(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' last merges again and again; the border stays only if no pair across it
        # merges before the merge that was undone.  On the left the merge comes first among equals.
        pair, halves, limit = self.pair, self.halves, BIG
        while True:
            joined = pair.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit, inner = a, halves[a][1]
                if inner == a:
                    limit, inner = b + 1, halves[b][0]
                    if inner == b:
                        return True
                    b = inner
                else:
                    a = inner
            else:
                limit, inner = b + 1, halves[b][0]
                if inner == b:
                    limit, inner = a, halves[a][1]
                    if inner == a:
                        return True
                    a = inner
                else:
                    b = inner

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (i := self.whole.get(data)) is not None:
            return [i]
        n = len(data)
        if not n:
            return []
        longest: list[int] = [-1] * n
        for end, (i, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = i  # ends come in rising order: the last to start here is the longest
        length, shorter, fits = self.length, self.shorter, self.fits
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            if token < 0:
                raise ValueError("the vocabulary lacks a single byte")
            while True:
                end = at + length[token]
                if not dead[end] and (not out or fits(out[-1], token)):
                    out.append(token)
                    at = end
                    if at == n:
                        return out
                    token = longest[at]
                    break
                token = shorter.get(token, -1)
                if token < 0:  # nothing leads on from here
                    dead[at] = 1
                    if not out:
                        raise ValueError("no exact encoding; the ranks aren't a merge order")
                    last = out.pop()
                    at -= length[last]
                    token = last
                    # the last token again meets dead[end] and gives way to a shorter one

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Remembered(dict):
    """Pre-token -> ids, filled on a miss and emptied when full."""

    def __init__(self, bpe: Bpe, most: int = CACHE):
        super().__init__()
        self.encode, self.most = bpe.encode_piece, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class TextEncoder:
    """Text -> ids: split, then the remembered encodings."""

    def __init__(self, path: str = VOCABULARY, pattern: str = SPLIT):
        self.bpe = Bpe(load_ranks(path))
        self.split = regex.compile(pattern).findall
        self.known = Remembered(self.bpe)

    def __call__(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str = VOCABULARY, pattern: str = SPLIT) -> TextEncoder:
    """This process's encoder: Python workers are reused, so it is built once for each."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TextEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def list_column(rows: list[list[int] | None]) -> pa.Array:
    """A list<int32> column from rows of ids, without one Python object for each id."""
    sizes = np.fromiter((0 if r is None else len(r) for r in rows), np.int64, len(rows))
    values = np.fromiter(chain.from_iterable(r for r in rows if r is not None), np.int32, int(sizes.sum()))
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    missing = np.fromiter((r is None for r in rows), bool, len(rows))
    mask = pa.array(missing) if missing.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()), mask=mask)


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = SPLIT) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) of every row; map-side only.

    round_trip says whether the ids, decoded again, are exactly the bytes of the text (null for null text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        decode = encode.bpe.decode
        for b in batches:
            texts = b.column(1)
            for start in range(0, b.num_rows, 512):
                some = texts.slice(start, 512).to_pylist()
                rows = [None if t is None else encode(t) for t in some]
                n = pa.array([None if r is None else len(r) for r in rows], pa.int64())
                back = pa.array([None if r is None else decode(r) == t.encode("utf-8", "surrogatepass") for r, t in zip(rows, some)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, 512).cast(pa.int64()), list_column(rows), n, back], names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    return map_arrow(df.select(id_col, text_col), run, "doc_id bigint, token_ids array<int>, n_tokens bigint, round_trip boolean")


def bpe_decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of every row of ids; null ids give null text.  Bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).bpe.decode
        for b in batches:
            texts = [None if r is None else decode(r).decode("utf-8", "replace") for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(df.select(id_col, ids_col), run, "doc_id bigint, text string")
