"""The pipeline against a version of it that goes through the documents one by one."""

from collections import defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
from ledgerloom.llm import byte_cnn, compression_rules, packing, probminhash, secret_novelty
from ledgerloom.llm.common import one_text_each, shared_folder, table
from pyspark.sql import functions as F


def brute_groups(rows):
    """All pairs compared: linked if they share a band, enough registers and half of their shingles."""
    rows = sorted((i, t) for i, t in rows)
    sign, has = probminhash.sketch([t for _, t in rows])
    sets = probminhash.weighted_sets([t for _, t in rows])
    keep = []
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(len(rows)):
        for a in range(b):
            agree = sign[a] == sign[b]
            if has[a] and has[b] and agree.mean() >= probminhash.CANDIDATE and agree.reshape(-1, probminhash.ROWS).all(1).any() and probminhash.similarity(sets[a], sets[b]) >= probminhash.THRESHOLD - 1e-9:
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    for k, (i, t) in enumerate(rows):
        if find(k) == k:
            keep.append((i, t))
    return keep


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = byte_cnn.train(docs, table(spark, sf_dir, "labels"))
    judge, tables, novelty = compression_rules.Judge(), model.tables(), secret_novelty.Novelty()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if judge(t)[4]]
    rows = [(i, t) for i, t in rows if model.probability(t, tables) >= byte_cnn.KEEP]
    rows = brute_groups(rows)
    rows = [(i, secret_novelty.redact(t, secret_novelty.findings(t, novelty))) for i, t in rows]
    encode = packing.encoding(packing.VOCABULARY, packing.SPLIT).encode_ordinary
    spans = defaultdict(list)
    windows = corpus_pipeline.run(spark, sf_dir).collect()
    for w in windows:
        assert w.n_tokens <= packing.CAPACITY
        for i, s, n in zip(w.doc_ids, w.starts, w.lengths):
            spans[i].append((s, n))
    assert set(spans) == {i for i, t in rows if encode(t)}
    for i, t in rows:
        at = 0
        for s, n in sorted(spans[i]):
            assert s == at
            at += n
        assert at == len(encode(t))
    ids, sizes = zip(*[(i, len(encode(t))) for i, t in rows if encode(t)])
    brute = packing.pack_shard(0, list(ids), list(sizes), packing.CAPACITY)
    assert sorted((w.doc_ids, w.starts, w.lengths) for w in windows) == sorted(zip(brute["doc_ids"], brute["starts"], brute["lengths"]))


def test_filtering_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_awkward_rows_go_through(spark, sf_dir, awkward, empty):
    for docs in (awkward, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        ids = {i for w in docs.collect() for i in w.doc_ids}
        assert not ids & {3, 4, 5}


def test_training_on_few_long_texts_is_bounded(monkeypatch):
    """30 texts of a million bytes were gone over 400 times."""
    seen = []

    def gradient(self, docs, y, weight):
        seen.append(sum(map(len, docs)))
        return {k: np.zeros_like(x) for k, x in self.p.items()}

    monkeypatch.setattr(byte_cnn.ByteCnn, "gradient", gradient)
    byte_cnn.ByteCnn().fit(["a" * 1_000_000] * 30, [0, 1] * 15)
    assert sum(seen) <= byte_cnn.EPOCHS * byte_cnn.TRAIN_CHARS and len(seen) >= byte_cnn.STEPS
    assert byte_cnn.ByteCnn.plan([9_000] * 80) == (134, byte_cnn.BATCH)  # short texts: as ever
    assert byte_cnn.ByteCnn.plan([40_000] * 3000) == (byte_cnn.EPOCHS, byte_cnn.BATCH)


def test_texts_left_out_of_training_are_not_moved(spark):
    """They were shuffled and written with the others, all labelled texts of a table of long ones."""
    rows = [(1, "first"), (1, "again"), (2, "".join(map(chr, np.random.default_rng(0).integers(33, 120, 3_000_000)))), (3, "third"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    got = one_text_each(df, [1, 2, 3, 4, 5], "doc_id", "text", 1000)
    first = df.where("doc_id = 1").orderBy(F.xxhash64("text")).first().text
    assert got == {1: first, 3: "third"}
    assert size() - before < 1_000_000
