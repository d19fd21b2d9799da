"""Quality rules from compression ratios.

A zstandard ratio (bytes / compressed bytes) tells prose from text that repeats itself (ratio far too high) and from
encoded or random text (ratio too low).  The ratio of prose rises with length, so every limit belongs to a band of
lengths.  The whole document is judged in its own band, and each fixed chunk in the band of the chunk, so that a
repetitive or incompressible passage inside an ordinary document counts too.

Defined results
---------------
* null text, empty text, only white space: rejected (``empty``);
* a text below the first band is too short for its ratio to mean anything: kept;
* very long text: compressed whole, as one frame, and in all its chunks;
* null id, repeated rows, ties: every row is judged on its own, ids are only carried;
* empty table: empty result;
* extra columns: :func:`compression_filter` returns exactly the columns of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ledgerloom.llm.common import map_arrow

#: (bytes from, lowest ratio, highest ratio), by length; the band of the largest start not above the length counts.
#: Base64 of random bytes never exceeds 8 / 6, which the lowest ratios from 1,024 bytes on lie above.
BANDS: tuple[tuple[int, float, float], ...] = (
    (0, 0.0, float("inf")),
    (128, 0.90, 2.4),
    (256, 1.15, 3.0),
    (1024, 1.40, 3.6),
    (4096, 1.50, 4.4),
    (16384, 1.60, 5.2),
    (65536, 1.60, 6.5),
)
CHUNK_BYTES = 2048
#: A document is rejected when more than this share of its bytes lies in chunks outside their band.
BAD_SHARE = 0.25
LEVEL = 3

METRICS = "doc_id bigint, whole_ratio double, lowest_chunk_ratio double, highest_chunk_ratio double, bad_share double, keep boolean, reason string"


def limits(n: int, bands=BANDS) -> tuple[float, float]:
    """Lowest and highest ratio allowed for a text of n bytes."""
    low, high = bands[0][1:]
    for start, lo, hi in bands:
        if n >= start:
            low, high = lo, hi
    return low, high


def chunks(data: bytes, size: int = CHUNK_BYTES) -> list[bytes]:
    """Fixed chunks that cover all of data; a last piece under half a chunk joins the one before it."""
    out = [data[i : i + size] for i in range(0, len(data), size)]
    if len(out) > 1 and len(out[-1]) < size // 2:
        last = out.pop()
        out[-1] += last
    return out


class Judge:
    """Ratios and verdict of one text; holds one compressor."""

    def __init__(self, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE, level: int = LEVEL):
        self.bands, self.chunk_bytes, self.bad_share = bands, chunk_bytes, bad_share
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False).compress

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.compress(data))

    def __call__(self, text: str | None) -> tuple[float | None, float | None, float | None, float | None, bool, str]:
        """(whole ratio, lowest and highest chunk ratio, bad share, keep, reason)."""
        if text is None or not text.strip():
            return None, None, None, None, False, "empty"
        data = text.encode("utf-8", "surrogatepass")
        whole = self.ratio(data)
        low, high = limits(len(data), self.bands)
        if len(data) < self.chunk_bytes * 3 // 2:  # one chunk: the document itself
            ok = low <= whole <= high
            bad, least, most = float(not ok), whole, whole
        else:
            parts = chunks(data, self.chunk_bytes)
            ratios = [self.ratio(p) for p in parts]
            least, most = min(ratios), max(ratios)
            outside = 0
            for p, r in zip(parts, ratios):
                lo, hi = limits(len(p), self.bands)
                outside += len(p) * (not lo <= r <= hi)
            bad = outside / len(data)
        reason = "incompressible" if whole < low else "repetitive" if whole > high else "chunks" if bad > self.bad_share else ""
        return whole, least, most, bad, not reason, reason


def compression_metrics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE) -> DataFrame:
    """Every row's ratios and verdict: one pass over the texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands, chunk_bytes, bad_share)
        for b in batches:
            rows = [judge(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.float64(),) * 4 + (pa.bool_(), pa.string())
            arrays = [b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "whole_ratio", "lowest_chunk_ratio", "highest_chunk_ratio", "bad_share", "keep", "reason"])

    return map_arrow(df.select(id_col, text_col), run, METRICS)


def compression_filter(df: DataFrame, text_col: str = "text", bands=BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE) -> DataFrame:
    """The rows of df that pass the rules, with df's own columns; one pass, no shuffle, no join."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands, chunk_bytes, bad_share)
        for b in batches:
            yield b.filter(pa.array([judge(t)[4] for t in b.column(at).to_pylist()], pa.bool_()))

    return map_arrow(df, run, df.schema)
