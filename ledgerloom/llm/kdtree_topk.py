"""Exact top-k search with one KD-tree per shard.

Vectors are placed into spatial shards by median splits along the widest dimension.  The splits are fitted to a bounded
sample (``SAMPLE_ROWS`` rows of each cell, in the order of a hash), which only decides where a vector is stored: every
vector is indexed and every result is exact.  A cell that holds more than a shard's rows is split again in the same way;
copies of one place, which no split parts, are dealt out by a hash of their id.  Each shard then builds its KD-tree once,
again by median splits, with tight boxes around every node, and the trees are written to the shared folder.

Queries are the rows whose id is divisible by ``EVERY``.  A query first searches the shard it lies in; its k-th distance
there is propagated.  It then descends through the boxes of cells, level by level, into those that are nearer than that
distance: first it searches the few nearest shards, and with the k-th distance of these the rest that are still near
enough.  Inside a shard a query walks the tree best first: of all nodes that it has seen it opens the one with the nearest
box, and stops when that lies beyond its k-th distance so far.  Queries that open the same leaf are compared with it in
one matrix product.

Products only pick candidates, with a margin for rounding; the distances that decide are computed from the
coordinates in double precision.  Ties go to the smaller id.

A shard meets its queries in blocks of a bounded number, so that neither side of a task grows with the data.  What the
driver holds is the boxes of the first level's cells, at most ``CELLS``.

Defined results
---------------
* a null vector, one with a null, NaN or infinite element, or of another length than the commonest: no query and no
  neighbour (of equally common lengths the smallest counts);
* null ids: neither query nor neighbour;  a vector is never its own neighbour (equal ids), copies under other ids are;
* repeated ids: of each id the row with the smallest vector (in array order) counts;
* fewer than k other vectors: all of them;  empty table: empty result;  extra columns: not read.

Spark jobs run while the DataFrame is built.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.common import map_arrow, written

K = 10
#: Queries are the rows whose id is divisible by this.
EVERY = 100
SHARD_ROWS = 8_192
LEAF_ROWS = 256
#: Queries that meet a shard in one group, and those that are searched together.
QUERY_BLOCK, QUERY_ROWS = 65_536, 1_024
#: Rows that the splits of a cell are fitted to, and cells that one round of splits makes at most.
SAMPLE_ROWS, CELLS = 32_768, 1_024
#: Shards that a query searches after its own before it is sent on.
NEAR = 4
#: Bits of a cell's number within its parent.
LEVEL_BITS = 20
FOUND = "query_id bigint, neighbour_id bigint, distance2 double"
NONE = np.iinfo(np.int64).max


def median_cut(part: np.ndarray) -> tuple[int, float] | None:
    """(dimension, value) of a median split along the widest dimension: rows with at least the value go right, and both
    sides have rows.  None if all rows are alike."""
    spread = part.max(0) - part.min(0)
    dim = int(spread.argmax())
    if not spread[dim] > 0:
        return None
    column = part[:, dim]
    cut = float(np.partition(column, len(column) // 2)[len(column) // 2])
    if cut == column.min():  # then the cut lies just above it
        cut = float(column[column > cut].min())
    return dim, cut


class Tree:
    """A KD-tree over one shard: median splits, a tight box around every node, rows stored in the order of the leaves."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.ids, self.x = arrays["ids"], arrays["x"]
        self.left, self.first, self.last = arrays["left"], arrays["first"], arrays["last"]
        self.low, self.high = arrays["low"], arrays["high"]
        self.x32 = self.x.astype(np.float32, copy=False)
        self.norm = np.einsum("ij,ij->i", self.x32, self.x32, dtype=np.float64)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
        x = np.ascontiguousarray(x, np.float64)
        order = np.argsort(ids, kind="stable")
        placed, low, high, left, first, last, at = [], [], [], [], [], [], 0
        todo: list[tuple[np.ndarray, int, bool]] = [(order, -1, False)]
        while todo:  # depth first, left before right, so that a node's rows are one run
            rows, parent, is_left = todo.pop()
            part, node = x[rows], len(left)
            low.append(part.min(0))
            high.append(part.max(0))
            first.append(at)
            last.append(at + len(rows))
            left.append([-1, -1])
            if parent >= 0:
                left[parent][0 if is_left else 1] = node
            cut = median_cut(part) if len(rows) > leaf_rows else None
            if cut is None:
                placed.append(rows)
                at += len(rows)
                continue
            right = part[:, cut[0]] >= cut[1]
            todo += [(rows[right], node, False), (rows[~right], node, True)]
        rows = np.concatenate(placed)
        stored = x[rows]
        if (stored.astype(np.float32) == stored).all():  # nothing is lost by keeping them narrow
            stored = stored.astype(np.float32)
        return cls({"ids": ids[rows], "x": stored, "left": np.array(left, np.int32), "first": np.array(first, np.int64), "last": np.array(last, np.int64), "low": np.array(low), "high": np.array(high)})

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.arrays)
        return out.getvalue()

    @classmethod
    def of_bytes(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data), allow_pickle=False) as got:
            return cls({k: got[k] for k in got.files})

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The (query row, id, squared distance) of the k nearest, and nothing farther than bound (squared, inclusive)."""
        n, nodes = len(q), len(self.left)
        best, near = np.full((n, k), np.inf), np.full((n, k), NONE)
        kth = bound.astype(np.float64).copy()
        queue = np.full((n, nodes), np.inf)  # of the nodes that a query has seen and not opened, the distance to the box
        queue[:, 0] = box_distance2(q, self.low[:1], self.high[:1])[:, 0]
        q32 = q.astype(np.float32)
        qq = np.einsum("ij,ij->i", q32, q32, dtype=np.float64)
        live = np.arange(n)
        while len(live):
            node = queue[live].argmin(1)
            gap = queue[live, node]
            going = (gap <= kth[live]) & np.isfinite(gap)
            live, node = live[going], node[going]
            queue[live, node] = np.inf
            order = np.argsort(node, kind="stable")
            for rows in np.split(live[order], np.flatnonzero(np.diff(node[order])) + 1) if len(live) else ():
                at = int(node[np.searchsorted(live, rows[0])])
                children = self.left[at]
                if children[0] >= 0:
                    queue[rows[:, None], children[None]] = box_distance2(q[rows], self.low[children], self.high[children])
                else:
                    self._compare(at, rows, qid, q, q32, qq, k, best, near, kth)
        row = np.repeat(np.arange(n), k)
        real = np.isfinite(best.ravel())
        return row[real], near.ravel()[real], best.ravel()[real]

    def _compare(self, leaf: int, rows: np.ndarray, qid, q, q32, qq, k: int, best, near, kth) -> None:
        """Queries `rows` against the rows of one leaf."""
        lo, hi = int(self.first[leaf]), int(self.last[leaf])
        norm = self.norm[lo:hi]
        d = qq[rows, None] + norm[None] - 2 * (q32[rows] @ self.x32[lo:hi].T)
        margin = 1e-5 * (qq[rows] + norm.max()) + 1e-12
        room = kth[rows] + margin
        if hi - lo > k + 1:  # at most the k nearest of this leaf and the query itself can count, give or take rounding
            room = np.minimum(room, np.partition(d, k, 1)[:, k] + 2 * margin)
        a, b = np.nonzero(d <= room[:, None])
        who, what = rows[a], lo + b
        other = self.ids[what] != qid[who]
        who, what = who[other], what[other]
        exact = ((q[who] - self.x[what].astype(np.float64)) ** 2).sum(1)
        inside = exact <= kth[who]
        who, what, exact = who[inside], what[inside], exact[inside]
        if not len(who):
            return
        changed = np.unique(who)
        w = np.concatenate([np.repeat(changed, k), who])
        i = np.concatenate([near[changed].ravel(), self.ids[what]])
        d2 = np.concatenate([best[changed].ravel(), exact])
        by = np.lexsort((i, d2, w))
        w, i, d2 = w[by], i[by], d2[by]
        pick = np.searchsorted(w, changed)[:, None] + np.arange(k)
        best[changed], near[changed] = d2[pick], i[pick]
        kth[changed] = np.minimum(kth[changed], best[changed, k - 1])


def box_distance2(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[query, box] squared distances, slightly rounded down."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        c = q[:, j, None]
        out += np.maximum(np.maximum(low[None, :, j] - c, c - high[None, :, j]), 0) ** 2
    return out * (1 - 1e-12)


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v array<double>) of the rows that count, one for each id, and their length."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = sizes[0].n if sizes else 0
    return rows.where(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v")), dims


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    return np.concatenate(flat).reshape(-1, dims) if flat else np.zeros((0, dims))


# Placing vectors into shards.  A cell's number is its parent's, shifted, with its own number (from 1) below.


def fit_splits(x: np.ndarray, cells: int) -> np.ndarray:
    """Splits as rows (dimension, value, left, right): a child of at least 0 is another row, -1 - c is cell c."""
    out: list[list[float]] = []
    found, leaves = [(len(x), 0, x, -1, 0)], []
    while found and len(found) + len(leaves) < cells:  # always the largest cell next
        found.sort(key=lambda f: (f[0], -f[1]))
        size, _, part, parent, side = found.pop()
        cut = median_cut(part) if size > 1 else None
        if cut is None:
            leaves.append((parent, side))
            continue
        row = len(out)
        out.append([cut[0], cut[1], 0, 0])
        if parent >= 0:
            out[parent][2 + side] = row
        right = part[:, cut[0]] >= cut[1]
        found += [(int((~right).sum()), 2 * row, part[~right], row, 0), (int(right.sum()), 2 * row + 1, part[right], row, 1)]
    for c, (parent, side) in enumerate([*((f[3], f[4]) for f in found), *leaves]):
        if parent >= 0:
            out[parent][2 + side] = -1 - c
    return np.array(out, np.float64).reshape(-1, 4)


def place(x: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """The cell of each row."""
    at = np.zeros(len(x), np.int64)
    inner = np.arange(len(x)) if len(splits) else np.zeros(0, np.int64)
    dim, value, children = splits[:, 0].astype(np.int64), splits[:, 1], splits[:, 2:].astype(np.int64)
    while len(inner):
        s = at[inner]
        at[inner] = children[s, (x[inner, dim[s]] >= value[s]).astype(np.int64)]
        inner = inner[at[inner] >= 0]
    return -1 - at if len(splits) else at


def spatial_shards(rows: DataFrame, dims: int, shard_rows: int, sample_rows: int = SAMPLE_ROWS, cells: int = CELLS) -> DataFrame:
    """rows(id, v) with a column `shard`.  Each round reads the rows of the cells that are still too large once more."""
    schema = "id bigint, v array<double>, cell bigint"
    done, rows, level = None, rows.select("id", "v", F.lit(0).cast("bigint").alias("cell")), 0
    while True:
        level += 1
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
        shares = sizes.select("cell", "n", (F.lit(float(1 << 32)) * sample_rows / F.col("n")).alias("below"), F.least(F.lit(cells), F.ceil(F.col("n") / (shard_rows * 0.75))).cast("int").alias("parts"))

        def fit(key: tuple, t: pa.Table) -> pa.Table:
            order = np.argsort(t.column("id").to_numpy(), kind="stable")
            splits = fit_splits(matrix(t.column("v"), dims)[order], t.column("parts")[0].as_py())
            return pa.table({"cell": pa.array([key[0].as_py()]), "n": pa.array([t.column("n")[0].as_py()]), "splits": pa.array([splits.tobytes()], pa.binary())})

        # a third of all rows may be in one cell: the few numbers of a cell go to its rows, sampled before they meet
        drawn = rows.join(F.broadcast(shares) if level == 1 else shares, "cell").where(F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 32)) < F.col("below"))
        fitted = written(drawn.groupBy("cell").applyInArrow(fit, "cell bigint, n bigint, splits binary"), "splits")
        whole = [np.frombuffer(r.splits, np.float64).reshape(-1, 4) for r in fitted.collect()] if level == 1 else []  # one row

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, cell = matrix(b.column(1), dims), b.column(2).to_numpy()
                ids, n = b.column(0).to_numpy(), b.column(3).to_numpy()
                child = np.zeros(len(cell), np.int64)
                for c in np.unique(cell):
                    of = np.flatnonzero(cell == c)
                    splits = whole[0] if whole else np.frombuffer(b.column(4)[int(of[0])].as_py(), np.float64).reshape(-1, 4)
                    if len(splits):
                        child[of] = place(x[of], splits)
                    else:  # copies of one place
                        deal = max(1, -(-int(n[of[0]]) // shard_rows))
                        child[of] = (ids[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % deal
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((cell << LEVEL_BITS) + child + 1)], names=["id", "v", "cell"])

        if level == 1:
            n = sum(r.n for r in fitted.select("n").collect())
            known = rows.select("id", "v", "cell", F.lit(n).cast("bigint").alias("n"), F.lit(b"").alias("splits"))
        else:
            known = rows.join(fitted, "cell").select("id", "v", "cell", "n", "splits")
        rows = written(map_arrow(known, assign, schema), "cells")
        if level == 63 // LEVEL_BITS:
            ready = rows
        else:
            large = written(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard_rows).select("cell"), "large")
            ready = rows if large.isEmpty() else rows.join(large, "cell", "left_anti")
        done = ready if done is None else done.unionByName(ready)
        if ready is rows:
            return done.withColumnRenamed("cell", "shard")
        rows = rows.join(large, "cell", "left_semi")


def level_of(shard):
    """How many rounds of splits made a cell."""
    return F.when(shard < (1 << LEVEL_BITS), 1).when(shard < (1 << 2 * LEVEL_BITS), 2).otherwise(3)


BOX = "cell bigint, low array<double>, high array<double>"


def around(boxes: DataFrame, dims: int) -> DataFrame:
    """The boxes around the children of each parent cell."""

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        low, high = matrix(t.column("low"), dims).min(0), matrix(t.column("high"), dims).max(0)
        return pa.table({"cell": pa.array([key[0].as_py()]), "low": pa.array([low.tolist()]), "high": pa.array([high.tolist()])})

    return boxes.select(F.shiftright("cell", LEVEL_BITS).alias("cell"), "low", "high").groupBy("cell").applyInArrow(merge, BOX)


def route(queries: DataFrame, boxes: DataFrame, dims: int, blocks: int) -> DataFrame:
    """(id, v, kth, home, shard, gap): each query with the shards other than its own that lie within its k-th distance.

    boxes: (cell, low, high) of every shard.  Queries descend level by level; a parent's boxes meet its queries in
    blocks.
    """
    levels = [boxes.where(level_of(F.col("cell")) == n) for n in (1, 2, 3)]
    deepest = max((r.n for r in boxes.select(level_of(F.col("cell")).alias("n")).distinct().collect()), default=1)
    for n in range(deepest - 1, 0, -1):
        levels[n - 1] = written(levels[n - 1].unionByName(around(levels[n], dims)), "boxes")
    top = levels[0].orderBy("cell").collect()  # at most CELLS
    names = np.array([r.cell for r in top], np.int64)
    low, high = np.array([r.low for r in top]), np.array([r.high for r in top])
    shape = "id bigint, v array<double>, kth double, home bigint, cell bigint, gap double"

    def hits(q: pa.RecordBatch, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, q.num_rows, QUERY_ROWS):
            part = q.slice(s, QUERY_ROWS)
            x, kth = matrix(part.column(1), dims), part.column(2).to_numpy()
            for c in range(0, len(names), CELLS):
                gap = box_distance2(x, low[c : c + CELLS], high[c : c + CELLS])
                a, b = np.nonzero(gap <= kth[:, None])
                sent = part.take(pa.array(a))
                yield pa.RecordBatch.from_arrays([*(sent.column(j) for j in range(4)), pa.array(names[c + b]), pa.array(gap[a, b])], names=["id", "v", "kth", "home", "cell", "gap"])

    def from_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from hits(b, names, low, high)

    frontier = map_arrow(queries.select("id", "v", "kth", "home"), from_top, shape)
    out = []
    for n in range(1, deepest):
        frontier = written(frontier, "frontier")
        shards = boxes.where(level_of(F.col("cell")) == n).select("cell")
        out.append(frontier.join(shards, "cell", "left_semi"))
        inner = frontier.join(shards, "cell", "left_anti").drop("gap").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        below = levels[n].select(F.shiftright("cell", LEVEL_BITS).alias("parent"), F.col("cell").alias("child"), "low", "high").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def descend(key: tuple, q: pa.Table, b: pa.Table) -> pa.Table:
            got = [r for p in q.select(["id", "v", "kth", "home"]).to_batches() for r in hits(p, b.column("child").to_numpy(), matrix(b.column("low"), dims), matrix(b.column("high"), dims))] if q.num_rows and b.num_rows else []
            schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("kth", pa.float64()), ("home", pa.int64()), ("cell", pa.int64()), ("gap", pa.float64())])
            return pa.concat_tables([schema.empty_table(), *(pa.Table.from_batches([r]).cast(schema) for r in got)])

        frontier = inner.groupBy("cell", "block").cogroup(below.groupBy("parent", "part")).applyInArrow(descend, shape)
    out.append(frontier)
    sent = out[0]
    for x in out[1:]:
        sent = sent.unionByName(x)
    return sent.where("cell <> home").withColumnRenamed("cell", "shard")


def top_k(df: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, cells: int = CELLS, near: int = NEAR) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest other vectors, by Euclidean distance, of every vector whose
    id is divisible by `every`; all vectors are searched."""
    spark = df.sparkSession
    rows, dims = clean_vectors(df, id_col, vec_col)
    if not dims:
        return spark.createDataFrame([], "query_id bigint, rank bigint, neighbour_id bigint, distance double")
    rows = spatial_shards(written(rows, "vectors"), dims, shard_rows, sample_rows, cells)

    def build(key: tuple, t: pa.Table) -> pa.Table:
        tree = Tree.build(t.column("id").to_numpy(), matrix(t.column("v"), dims), leaf_rows)
        return pa.table({"cell": pa.array([key[0].as_py()]), "low": pa.array([tree.low[0].tolist()]), "high": pa.array([tree.high[0].tolist()]), "tree": pa.array([tree.to_bytes()], pa.large_binary()).cast(pa.binary())})

    trees = written(rows.groupBy("shard").applyInArrow(build, BOX + ", tree binary"), "trees")
    asked = written(rows.where(F.pmod("id", F.lit(every)) == 0), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def search(key: tuple, q: pa.Table, shard: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "distance2": pa.array([], pa.float64())})]
        if q.num_rows and shard.num_rows:
            tree = Tree.of_bytes(shard.column("tree")[0].as_py())
            for s in range(0, q.num_rows, QUERY_ROWS):
                part = q.slice(s, QUERY_ROWS)
                i = part.column("id").to_numpy()
                row, hit, d2 = tree.search(i, matrix(part.column("v"), dims), k, part.column("kth").to_numpy())
                out.append(pa.table({"query_id": i[row], "neighbour_id": hit, "distance2": d2}))
        return pa.concat_tables(out)

    def searched(sent: DataFrame) -> DataFrame:
        """What queries (id, v, kth, shard) find in their shards; a shard's tree goes to each block of its queries."""
        parted = sent.select("id", "v", "kth", "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        stored = trees.select(F.col("cell").alias("stored"), "tree").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return parted.groupBy("shard", "block").cogroup(stored.groupBy("stored", "part")).applyInArrow(search, FOUND)

    by = Window.partitionBy("query_id").orderBy("distance2", "neighbour_id")

    def best(found: DataFrame) -> DataFrame:
        """The k best of each query, kept so on the map side before they are shuffled."""
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    def bounds(found: DataFrame) -> DataFrame:
        return found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance2")).otherwise(F.lit(float("inf"))).alias("kth"))

    found = written(searched(asked.withColumn("kth", F.lit(float("inf")))), "home")
    # a query that is alone in its shard has found nothing yet: its bound is infinite
    start = asked.withColumnRenamed("shard", "home").join(bounds(found).withColumnRenamed("query_id", "id"), "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
    sent = route(start, trees.select("cell", "low", "high"), dims, blocks)
    sent = written(sent.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("gap", "shard"))), "sent")
    found = written(best(found.unionByName(searched(sent.where(F.col("turn") <= near)))).drop("rank"), "near")
    later = sent.where(F.col("turn") > near).drop("kth").join(bounds(found).withColumnRenamed("query_id", "id"), "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf")))).where("gap <= kth")
    ranked = best(found.unionByName(searched(later)))
    return ranked.select("query_id", F.col("rank").cast("bigint").alias("rank"), "neighbour_id", F.round(F.sqrt("distance2"), 6).alias("distance"))


#: The same in SQL.
TOP_K_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_distance(a.e, b.e) AS x
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % {EVERY} = 0
),
r AS (SELECT query_id, neighbour_id, x, row_number() OVER (PARTITION BY query_id ORDER BY x, neighbour_id) AS rank FROM d)
SELECT query_id, rank, neighbour_id, round(x, 6) AS distance FROM r WHERE rank <= {K}
"""
