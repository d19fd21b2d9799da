"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are read in overlapping chunks that together cover all of it.  In each chunk, learned filters slide
over the bytes and keep their largest response.  A document is described by the largest and the mean of its chunks'
responses, and a logistic unit turns these into one probability of good quality.

As the input of a filter is one byte per tap, embedding and filter fold into a table of 256 rows per tap, and the
convolution is a sum of table rows.

The network is trained on the driver from a bounded sample of labelled rows (``TRAIN_ROWS`` and ``TRAIN_CHARS``, in the
order of a hash of doc_id).  Scoring is one map over all texts, without a shuffle.

Defined results
---------------
* null, empty or blank text: probability 0, rejected;
* a text shorter than a filter: padded with zero bytes;  very long texts: all chunks count;
* null ids, repeated rows, ties: every row is scored on its own;
* labels: rows with null id or null label are ignored; of repeated ids the lowest label counts, and of different texts
  under one id the one with the least hash;
* no labels of both kinds: there is nothing to learn and every text that isn't blank gets probability 1;
* extra columns: :func:`quality_filter` returns exactly its input's columns, whatever their names;
* empty table: empty result.

:func:`train` runs Spark jobs at once, scoring is lazy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import map_arrow, one_text_each

WIDTH, FILTERS, EMBED = 5, 16, 8
CHUNK, OVERLAP = 1024, 64
#: At most this many labelled rows are used for training.
TRAIN_ROWS = 3000
#: Characters of their texts together; a text that no longer fits is left out whole.
TRAIN_CHARS = 32_000_000
EPOCHS, BATCH, RATE, SEED = 14, 32, 0.01, 11
#: Few rows are gone over more often, until there were this many batches, and in smaller batches where their bytes, all
#: epochs together, would be more than this.
STEPS = 400
TRAIN_BYTES = EPOCHS * TRAIN_CHARS
#: A document is kept from this probability on.
KEEP = 0.2


def starts(n: int) -> np.ndarray:
    """Starts of the chunks of n bytes; each but the first shares OVERLAP bytes with the one before it."""
    step = CHUNK - OVERLAP
    return np.arange(0, max(1, n - OVERLAP), step)


class ByteCnn:
    """Parameters, training and scoring."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "taps": r.normal(0, 0.35, (WIDTH, EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.trained = False

    def tables(self) -> np.ndarray:
        """[tap, byte, filter]: what a byte at a tap adds to each filter."""
        return np.ascontiguousarray(np.einsum("be,wef->wbf", self.p["embed"], self.p["taps"]))

    @staticmethod
    def response(data: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Responses at every position, before bias; data has at least WIDTH bytes."""
        n = len(data) - WIDTH + 1
        out = tables[0].take(data[:n], axis=0)
        for w in range(1, WIDTH):
            out += tables[w].take(data[w : w + n], axis=0)
        return out

    def pooled(self, data: np.ndarray, tables: np.ndarray, where: bool = False):
        """[chunk, filter] largest responses (and the positions that gave them)."""
        if len(data) < WIDTH:
            data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
        at = starts(len(data))
        best = np.empty((len(at), FILTERS), tables.dtype)
        pos = np.empty((len(at), FILTERS), np.int64)
        for k, s in enumerate(at):  # starts() leaves every chunk at least WIDTH bytes
            r = self.response(data[s : s + CHUNK], tables)
            if where:
                top = r.argmax(0)
                best[k], pos[k] = r[top, np.arange(FILTERS)], top + s
            else:
                r.max(0, out=best[k])
        return (best, pos, data) if where else best

    def features(self, best: np.ndarray) -> np.ndarray:
        act = np.maximum(best + self.p["bias"], 0)
        return np.concatenate([act.max(0), act.mean(0)])

    def probability(self, text: str | None, tables: np.ndarray) -> float:
        if text is None or not text.strip():
            return 0.0
        if not self.trained:
            return 1.0
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        z = float(self.features(self.pooled(data, tables)) @ self.p["out"] + self.p["out_bias"][0])
        return 1 / (1 + float(np.exp(-z)))

    def gradient(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted logistic loss; it reaches a filter only at the positions that gave its largest responses."""
        tables = self.tables()
        grad = {k: np.zeros_like(x) for k, x in self.p.items()}
        table_grad = np.zeros_like(tables)
        for i in range(len(docs)):
            best, pos, data = self.pooled(docs[i], tables, where=True)
            act = np.maximum(best + self.p["bias"], 0)
            top = act.argmax(0)
            feats = np.concatenate([act[top, np.arange(FILTERS)], act.mean(0)])
            z = float(feats @ self.p["out"] + self.p["out_bias"][0])
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(docs)
            grad["out"] += d * feats
            grad["out_bias"] += d
            g = np.repeat(d * self.p["out"][None, FILTERS:] / len(act), len(act), 0)
            g[top, np.arange(FILTERS)] += d * self.p["out"][:FILTERS]
            g *= act > 0
            grad["bias"] += g.sum(0)
            f = np.broadcast_to(np.arange(FILTERS), pos.shape)
            for w in range(WIDTH):
                np.add.at(table_grad[w], (data[pos + w], f), g)
        grad["embed"] = np.einsum("wbf,wef->be", table_grad, self.p["taps"])
        grad["taps"] = np.einsum("be,wbf->wef", self.p["embed"], table_grad)
        return grad

    @staticmethod
    def plan(sizes: list[int]) -> tuple[int, int]:
        """(epochs, documents of a batch) for documents of these many bytes.

        Few but very long documents would be gone over hundreds of times for the sake of STEPS, whatever their bytes.
        """
        n = len(sizes)
        epochs = max(EPOCHS, -(-STEPS // -(-n // BATCH)))
        if epochs * sum(sizes) <= TRAIN_BYTES or epochs == EPOCHS:
            return epochs, BATCH
        epochs = max(EPOCHS, TRAIN_BYTES // sum(sizes))
        return epochs, max(1, min(BATCH, n * epochs // STEPS))

    def fit(self, texts: list[str], labels: list[int]) -> ByteCnn:
        """Adam on the logistic loss."""
        docs = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
        y = np.array(labels, np.float32)
        if not len(y) or y.min() == y.max():
            return self
        weight = np.where(y == 0, min(4.0, (y == 1).sum() / (y == 0).sum()) ** 0.5, 1.0)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        r, step = np.random.default_rng(SEED + 1), 0
        epochs, size = self.plan([len(d) for d in docs])
        for epoch in range(epochs):
            order = r.permutation(len(docs))
            for lo in range(0, len(order), size):
                batch = order[lo : lo + size]
                grad = self.gradient([docs[i] for i in batch], y[batch], weight[batch])
                step += 1
                for k in self.p:
                    m[k] += 0.1 * (grad[k] - m[k])
                    v2[k] += 0.001 * (grad[k] ** 2 - v2[k])
                    rate = RATE * (1 - epoch / epochs)
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        self.trained = True
        return self


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ByteCnn:
    """A network fitted to at most `rows` labelled documents, taken in the order of a hash of their id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    label = {r.doc_id: r.quality for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()}  # bounded by rows
    found = {i: t for i, t in one_text_each(docs, list(label), id_col, text_col, TRAIN_CHARS).items() if t.strip()}
    return ByteCnn().fit(list(found.values()), [int(label[i] > 0) for i in found])


def quality_scores(df: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, probability) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for b in batches:
            p = [model.probability(t, tables) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(p, pa.float64())], names=["doc_id", "probability"])

    return map_arrow(df.select(id_col, text_col), run, "doc_id bigint, probability double")


def quality_filter(df: DataFrame, model: ByteCnn, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of df with a probability of at least `keep`, with df's own columns."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for b in batches:
            yield b.filter(pa.array([model.probability(t, tables) >= keep for t in b.column(at).to_pylist()], pa.bool_()))

    return map_arrow(df, run, df.schema)
