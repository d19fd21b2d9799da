"""Near-duplicate groups by ProbMinHash.

A document is a weighted set: its word shingles with their counts.  Every shingle sends a Poisson process of arrivals,
with its weight as the rate, and each arrival falls on a random register of the signature; a register keeps the shingle
of its earliest arrival.  Two documents agree on a register with the probability Jaccard similarity of their weighted
sets.  Arrivals are drawn in rounds, and a shingle stops as soon as its next arrival comes after the latest register of
its document (early termination).

Near duplicates are then found by banding (documents that agree on all registers of a band share a bucket) and
verified on the texts: a pair of one bucket that agrees on enough registers (``CANDIDATE``) is a candidate, and two
documents are linked when the probability Jaccard similarity of their weighted shingles, computed exactly, reaches the
threshold.  Groups are the connected components of the links; exact copies share one signature and are joined by it
before any bucket is built.

In a bucket, candidates are looked up through the rarest registers (two signatures that agree on c of R registers share
one of the R - c + 1 rarest of each), and only as many are kept as span the connected components, so thousands of close
copies cost one comparison each and many unlike members cost none.  These spanning pairs are verified; a component of
which one fails is gone through again with all its candidates verified, so no link is lost to the saving.  A bucket of
more members than a task should hold is dealt into blocks, and each pair of blocks is compared in a task of its own: no
bucket is capped.  Members are rows, never lists.

Defined results
---------------
* null or blank text (no word at all): never a duplicate of anything, a group of its own;
* texts of fewer words than a shingle: the words themselves are the one shingle;
* very long texts: all shingles count;
* ties: of equal candidates the smallest doc_id stays;
* rows that repeat a doc_id: the id is one document, each of its texts is compared and all its rows share its fate;
* null doc_id: kept, never compared;
* extra columns: not read; :func:`near_dedup` returns its input's columns, whatever their names;
* empty table: no groups.

Signatures are told apart by a 64-bit hash.  Spark jobs run while the DataFrame is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import map_arrow, shared_folder, written

SHINGLE = 3
#: Registers of a signature, in bands of ROWS.
REGISTERS, ROWS = 112, 4
#: Similarity from which two documents are near duplicates, and the share of agreeing registers from which it is measured:
#: more than two standard deviations of the estimate below.
THRESHOLD, CANDIDATE = 0.5, 0.4
#: Members of a bucket in one task, and those up to which every pair is looked at.
WIDE, DENSE = 20_000, 1_000
#: A similarity of exactly the threshold counts, whatever its sum is rounded to.
ROUNDING = 1e-9
CACHE = 400_000

WORDS = re.compile(r"\w+")
M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (two rounds of multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash(dict):
    """word -> 64-bit hash, the same in every process; emptied when full."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= CACHE:
            self.clear()
        self[word] = h
        return h


_WORDS = WordHash()


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, shingle hash, count) of the distinct shingles of all texts, sorted by document."""
    rows, n = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        words = WORDS.findall(t.lower()) if t else []
        n[k] = len(words)
        rows.append(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)))
    h = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))  # words from here to the end of the document
    total = np.repeat(n, n)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(h), np.uint64)
        for j in range(size):
            ahead = np.roll(h, -j)
            acc = np.where(left > j, mix(acc + ahead * np.uint64(2 * j + 1)), acc)
    whole = (left >= size) | ((total < size) & (left == total))  # a short document is one shingle
    doc, acc = doc[whole], acc[whole]
    order = np.lexsort((acc, doc))
    doc, acc = doc[order], acc[order]
    if not len(doc):
        return doc, acc, np.zeros(0)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (acc[1:] != acc[:-1])])
    return doc[new], acc[new], np.diff(np.r_[new, len(doc)]).astype(np.float64)


def signatures(n_docs: int, doc: np.ndarray, item: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """[document, register] 32-bit fingerprints of the earliest arrivals; documents without items keep zeros."""
    earliest = np.full(n_docs * registers, np.inf)
    sign = np.zeros(n_docs * registers, np.uint64)
    at, k = np.zeros(len(doc)), 0
    latest = np.full(n_docs, np.inf)
    with np.errstate(over="ignore"):
        state = mix(item + np.uint64(0x9E3779B97F4A7C15))
        while len(doc):
            k += 1
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            at = at - np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight  # exponential gap
            open_ = at < latest[doc]  # an arrival after the latest register changes nothing, nor does any later one
            if not open_.all():
                doc, item, weight, at, state = doc[open_], item[open_], weight[open_], at[open_], state[open_]
                if not len(doc):
                    break
            slot = doc * registers + (mix(state ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(earliest, slot, at)
            won = earliest[slot] == at
            sign[slot[won]] = item[won]
            latest = earliest.reshape(n_docs, registers).max(1)
        return (mix(sign + np.uint64(1)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n_docs, registers)


def sketch(texts: list[str | None], registers: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of texts, and which of them have any word."""
    doc, item, weight = shingles(texts)
    has = np.zeros(len(texts), bool)
    has[doc] = True
    return signatures(len(texts), doc, item, weight, registers), has


def slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded total length, so that memory doesn't follow the batch."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def document_signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", registers: int = REGISTERS) -> DataFrame:
    """(doc_id, text_hash, signature) of every row that has an id and a word; map-side only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, texts = b.column(0).cast(pa.int64()), b.column(2), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                s, has = sketch(texts[lo:hi], registers)
                rows = pa.array([x.tobytes() for x in s], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), hashes.slice(lo, hi - lo), rows], names=["doc_id", "text_hash", "signature"]).filter(pa.array(has))

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return map_arrow(rows.withColumn("text_hash", F.xxhash64("text")), run, "doc_id bigint, text_hash bigint, signature binary")


class Rare:
    """Finds the members of a bucket that may agree with a given one on at least `need` registers."""

    def __init__(self, signs: np.ndarray, need: int):
        n, registers = signs.shape
        token = signs.astype(np.uint64) | np.arange(registers, dtype=np.uint64) << np.uint64(32)
        _, token, count = np.unique(token.ravel(), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.lexsort((np.arange(len(count)), count))] = np.arange(len(count))  # one order of all tokens, the rarest first
        single = int((count == 1).sum())
        prefix = np.sort(rank[token].reshape(n, registers), 1)[:, : registers - need + 1]
        self.prefix = [row[k:] for row, k in zip(prefix, (prefix < single).sum(1))]  # a token of one member leads nowhere
        who = np.repeat(np.arange(n), [len(x) for x in self.prefix])
        what = np.concatenate(self.prefix) if n else np.zeros(0, np.int64)
        order = np.argsort(what, kind="stable")
        names, start = np.unique(what[order], return_index=True)
        self.holders = dict(zip(names.tolist(), np.split(who[order], start[1:]))) if len(names) else {}

    def __call__(self, member: int, alive: np.ndarray) -> np.ndarray:
        got = []
        for t in self.prefix[member].tolist():
            held = self.holders[t]
            held = self.holders[t] = held[alive[held]]  # those that are gone leave for good
            got.append(held)
        return np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)


def links(signs: np.ndarray, need: int, same: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """(root, a, b): pairs of rows that span the connected components of one bucket, named by their first row.

    Two rows are linked when they agree on `need` registers and, if `same` is given, it says so of row a and rows b.  A
    component grows from its first row: each of its members meets the rows that no component has yet.
    """
    n = len(signs)
    alive, out = np.ones(n, bool), []
    lookup = Rare(signs, need) if n > DENSE else lambda member, alive: np.flatnonzero(alive)
    for root in range(n):
        if not alive[root]:
            continue
        alive[root], waiting = False, [root]
        while waiting:
            member = waiting.pop()
            rows = lookup(member, alive)
            if len(rows):
                rows = rows[(signs[rows] == signs[member]).sum(1) >= need]
            if same is not None and len(rows):
                rows = rows[same(member, rows)]
            alive[rows] = False
            waiting += rows.tolist()
            out += [(root, member, r) for r in rows.tolist()]
    return out


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets (items in rising order, weights)."""
    common, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = x[1][i], y[1][j]
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    upto = np.searchsorted(b / a, b / a, "right")  # of an item, those with at most its ratio count by a, the others by b
    left = x[1].sum() - a.sum() + np.cumsum(a)[upto - 1]
    right = y[1].sum() - np.cumsum(b)[upto - 1]
    return float((1 / (left / a + right / b)).sum())


def weighted_sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(items, weights) of each text."""
    doc, item, weight = shingles(texts)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(item[lo:hi], weight[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ok) of pairs(a, b) of texts(sign, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None  # rows of one a follow each other
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                a, first = part.column(0).to_pylist(), part.column(2)
                sets, ok = weighted_sets(part.column(3).to_pylist()), []
                for k, s in enumerate(sets):
                    if a[k] != last:
                        last, kept = a[k], weighted_sets([first[k].as_py()])[0]
                    ok.append(similarity(kept, s) >= threshold - ROUNDING)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    second = pairs.join(texts.withColumnsRenamed({"sign": "b", "text": "text_b"}), "b")
    both = second.join(texts.withColumnsRenamed({"sign": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b")
    return map_arrow(both, run, "a bigint, b bigint, ok boolean")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id): the smallest id reachable from each id over edges (a, b); ids without an edge are absent.

    Alternating star contraction: every round hangs the larger neighbours of a node on its smallest neighbour, then the
    smaller ones, until nothing changes; each round's edges are written to the shared folder, so that lineage stays
    short and a lost executor costs no more than a reread.
    """
    shared_folder(edges.sparkSession)
    e = edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct().checkpoint()
    before = None
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = small.where("a <> b").distinct().checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("doc_id"), F.col("b").alias("group_id")).union(e.select("b", "b").distinct())
        before = now


def bucket_members(copies: DataFrame, registers: int, rows: int, wide: int) -> DataFrame:
    """(bucket, lo, hi, sign): the members of every bucket that two signatures share, in pairs of blocks."""
    width, bands = 4 * rows, registers // rows
    band = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"substring(signature, {k * width + 1}, {width})").alias("v")) for k in range(bands)]))
    keys = copies.select("sign", band.alias("band")).select("sign", F.xxhash64("band.k", "band.v").alias("bucket"))
    counted = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("sign", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("sign", F.lit(2))).alias("y")).where("n > 1")
    # buckets with the same members say the same: each set of members is compared once
    chosen = counted.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / wide).cast("int").alias("blocks"))
    members = keys.join(chosen, "bucket").withColumn("block", F.pmod(F.xxhash64("sign", F.lit(3)), F.col("blocks")).cast("int"))
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "sign")


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", registers: int = REGISTERS, rows: int = ROWS, threshold: float = THRESHOLD, candidate: float = CANDIDATE, wide: int = WIDE) -> DataFrame:
    """(doc_id, group_id) of every document in a group of two or more; group_id is the smallest id of the group."""
    need = int(np.ceil(candidate * registers - 1e-9))
    signed = written(document_signatures(df, id_col, text_col, registers).withColumn("sign", F.xxhash64("signature")), "signed")
    # one row for each signature: exact copies leave here, with a link to the smallest of them
    first = F.min(F.struct("doc_id", "text_hash", "signature")).alias("m")
    copies = written(signed.groupBy("sign").agg(first).select("sign", "m.*"), "copies")
    exact = signed.select("doc_id", "sign").join(copies.select("sign", F.col("doc_id").alias("b")), "sign").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")

    def arranged(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in order, the order, and the signatures in it."""
        ids, sign = t.column("doc_id").to_numpy(), t.column("sign").to_numpy()
        order = np.lexsort((sign, ids))
        signs = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(len(ids), registers)
        return ids[order], sign[order], signs[order]

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        ids, sign, signs = arranged(t)
        root, a, b = np.array(links(signs, need), np.int64).reshape(-1, 3).T
        same = [pa.array([k.as_py()] * len(a), pa.int64()) for k in key]
        return pa.table(dict(zip(("bucket", "lo", "hi"), same)) | {"root": sign[root], "a": sign[a], "b": sign[b], "doc_a": ids[a], "doc_b": ids[b]})

    parts = "bucket bigint, lo bigint, hi bigint"
    members = bucket_members(copies, registers, rows, wide).join(copies.select("sign", "doc_id", "signature"), "sign")
    spanning = written(members.groupBy("bucket", "lo", "hi").applyInArrow(compare, parts + ", root bigint, a bigint, b bigint, doc_a bigint, doc_b bigint"), "spanning")

    # the texts of all that stands in a pair, read by id and hash of the text
    asked = spanning.select(F.col("a").alias("sign")).union(spanning.select("b")).distinct()
    places = copies.join(asked, "sign", "left_semi").select("sign", "doc_id", "text_hash")
    own = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null").withColumn("text_hash", F.xxhash64("text"))
    texts = written(own.join(places, ["doc_id", "text_hash"]).groupBy("sign").agg(F.first("text").alias("text")), "texts")
    judged = written(verified(spanning.select("a", "b").distinct(), texts, threshold), "judged")
    near = spanning.join(judged.where("ok"), ["a", "b"], "left_semi").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))

    # components that a failed pair held together are taken apart, every candidate in them verified
    failed = written(spanning.join(judged.where("not ok"), ["a", "b"], "left_semi").select("bucket", "lo", "hi", "root").distinct(), "failed")
    if not failed.isEmpty():
        again = spanning.join(failed, ["bucket", "lo", "hi", "root"], "left_semi")
        again = again.select("bucket", "lo", "hi", "root", F.explode(F.array("a", "b")).alias("sign")).distinct()

        def compare_texts(key: tuple, t: pa.Table) -> pa.Table:
            order = np.lexsort((t.column("sign").to_numpy(), t.column("doc_id").to_numpy()))
            ids, _, signs = arranged(t)
            whole, sets = t.column("text"), {}

            def of(k: int) -> tuple[np.ndarray, np.ndarray]:
                if k not in sets:
                    sets[k] = weighted_sets([whole[int(order[k])].as_py()])[0]
                return sets[k]

            pairs = links(signs, need, lambda a, bs: np.array([similarity(of(a), of(b)) >= threshold - ROUNDING for b in bs.tolist()]))
            _, a, b = np.array(pairs, np.int64).reshape(-1, 3).T
            return pa.table({"a": ids[a], "b": ids[b]})

        full = again.join(copies.select("sign", "doc_id", "signature"), "sign").join(texts, "sign")
        near = near.union(full.groupBy("bucket", "lo", "hi", "root").applyInArrow(compare_texts, "a bigint, b bigint"))
    return components(exact.union(near))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of df without the near duplicates: of each group the row with the smallest id stays."""
    gone = duplicate_groups(df, id_col, text_col, **how).where("doc_id <> group_id").select(F.col("doc_id").alias("__gone"))
    kept = df.join(gone, df[id_col] == gone["__gone"], "left_anti")
    return kept
