"""Operators that look at documents, vectors or pages together."""

import math
import time
import tracemalloc
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from compare import connect, of_spark, of_sql
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import html_blocks as html, kdtree_topk as kd, packing, probminhash as pmh
from ledgerloom.llm.common import one_text_each
from ledgerloom.llm.queries import oracle_sql, queries


# 1


def test_labels_agree_with_the_pages_own_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = html.train()  # fitted to composed pages only: all pages of the table are held out
    right = total = 0
    for r in pages.collect():
        found = html.blocks(r.html)
        got = html.label_pages(model, [html.vectors(found)])[0]
        right += sum(a == b[3] for a, b in zip(got, found))
        total += len(found)
    assert right / total > 0.9, right / total


def test_held_out_layouts():
    model, right, total = html.train(), 0, 0
    for page in html.synthetic_pages(60, seed=99):
        found = html.blocks(page)
        got = html.label_pages(model, [html.vectors(found)])[0]
        right += sum(a == b[3] for a, b in zip(got, found))
        total += len(found)
    assert right / total > 0.93, right / total


def test_every_page_is_labelled_as_it_is_alone(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = html.train(pages)
    got = {r.page_id: r for r in queries()["op1_html_blocks"](spark, sf_dir).collect()}
    for r in pages.collect():
        found = html.blocks(r.html)
        labels = html.label_pages(model, [html.vectors(found)])[0].tolist()
        assert got[r.page_id].content == labels and got[r.page_id].text == "\n".join(b[0] for b, y in zip(found, labels) if y)


def scalar_states(p, rows, way):
    """The states of one direction, number by number."""
    n, squash = html.HIDDEN, lambda v: 1 / (1 + math.exp(-v))
    h, c, out = [0.0] * n, [0.0] * n, {}
    for t in range(len(rows)) if way == "f" else reversed(range(len(rows))):
        z = [float(p["b" + way][j]) + sum(float(v) * float(p["x" + way][k][j]) for k, v in enumerate(rows[t])) + sum(h[k] * float(p["h" + way][k][j]) for k in range(n)) for j in range(4 * n)]
        c = [squash(z[n + j]) * c[j] + squash(z[j]) * math.tanh(z[3 * n + j]) for j in range(n)]
        h = [squash(z[2 * n + j]) * math.tanh(c[j]) for j in range(n)]
        out[t] = h
    return [out[t] for t in range(len(rows))]


def test_probabilities_are_those_of_a_scalar_network():
    model = html.train()
    pages = [html.vectors(html.blocks(p)) for p in html.synthetic_pages(3, seed=77)]
    pages = [p[:12] for p in pages if len(p)]
    x, mask = html.padded(pages)
    got = model.scores(x, mask)
    for k, rows in enumerate(pages):
        forward, back = scalar_states(model.p, rows, "f"), scalar_states(model.p, rows, "b")
        for t in range(len(rows)):
            z = float(model.p["out_bias"][0]) + sum(a * float(w) for a, w in zip(forward[t] + back[t], model.p["out"]))
            assert abs(got[t, k] - 1 / (1 + math.exp(-z))) < 1e-4


def numeric_gradient(model, loss, grad, r, each=4, step=1e-5):
    for key, g in grad.items():
        for _ in range(each):
            at = tuple(int(r.integers(n)) for n in g.shape)
            old = model.p[key][at]
            model.p[key][at] = old + step
            up = loss()
            model.p[key][at] = old - step
            down = loss()
            model.p[key][at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-6 + 1e-3 * abs(g[at]), (key, at)


def test_gradients_of_both_directions():
    model = html.BiLstm()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    r = np.random.default_rng(0)
    x = r.normal(size=(5, 3, html.TAGS + html.WORDS + html.PLAIN))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 1, 0], [1, 0, 0]], bool)
    y = (r.random(mask.shape) < 0.5) * mask

    def loss():
        p = model.scores(x, mask)
        return float(-(np.where(y > 0, np.log(p), np.log(1 - p)) * mask).sum() / mask.sum())

    numeric_gradient(model, loss, model.gradient(x, mask, y), r)


def test_pages_of_one_id_in_training(spark):
    pages = html.synthetic_pages(8, seed=3)
    rows = [(k % 2, pages[k % 8]) for k in range(1000)] + [(7, "<p>" + "long " * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id bigint, html string")
    one, other = (one_text_each(d, [0, 1, 7], "page_id", "html", 1_000_000) for d in (df, df.orderBy(F.desc("page_id"), "html").repartition(3)))
    assert list(one) == [0, 1] and one == other and one[0] in pages[::2] and one[1] in pages[1::2]
    assert one_text_each(df, [], "page_id", "html", 10) == one_text_each(df, [99], "page_id", "html", 10) == {}


@pytest.mark.parametrize("page", ["<a " * 660_000, "<div>" * 400_000, "<div>x" * 60_000 + "</div></b>" * 60_000, '<a "' * 500_000, "<script " * 250_000, "<script>" * 250_000, "<!x" * 600_000, "<?x" * 600_000, "<!--" * 500_000, "<" * 2_000_000, "9" * 2_000_000, "</b>" * 500_000, "<body>" * 300_000])
def test_long_pages_are_cut_in_linear_time(page):
    began = time.process_time()
    html.blocks("<p>token</p>" + page)
    assert time.process_time() - began < 15


def test_awkward_pages(spark):
    rows = [(1, None), (2, ""), (3, "plain text"), (4, "<p>open <b>never closed <div>more</p></span>"), (None, "<p>x</p>"), (6, "<div><p>Some words that say something.</p></div>" * 5000), (6, "<p>again</p>"), (7, "<script>x</script><!-- y -->"), (8, "<<<>>> &amp; <p")]
    df = spark.createDataFrame([(i, h, "u", "clash") for i, h in rows], "page_id bigint, html string, url string, content string")
    model = html.train(df)
    got = html.extract_text(df, model).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text is None and by[1].content is None and by[2].text == "" and by[7].content == [] and len(max((r.content for r in got if r.content), key=len)) == 5000
    assert html.extract_text(df.limit(0), model).count() == 0


# 4


def test_top_k_equals_sql(spark, sf_dir):
    df = queries()["op4_kdtree_topk"](spark, sf_dir)
    assert of_spark(df) == of_sql(connect(sf_dir), oracle_sql()["op4_kdtree_topk"], df.columns)


def brute_top(points, k):
    out = {}
    for i, x in points.items():
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in points.items() if j != i)[:k]
        out |= {(i, n + 1): j for n, (_, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("every, how", [(1, {"shard_rows": 20, "leaf_rows": 4}), (1, {"shard_rows": 1000, "leaf_rows": 8}), (3, {"shard_rows": 8, "leaf_rows": 2, "sample_rows": 40, "cells": 3, "near": 1})])
def test_top_k_over_several_shards_with_ties(spark, every, how):
    r = np.random.default_rng(4)
    points = {k: r.integers(0, 4, 3).astype(float).tolist() for k in range(150)} | {k: [1.0, 2.0, 3.0] for k in range(150, 210)}
    df = spark.createDataFrame(list(points.items()), "vec_id bigint, embedding array<double>")
    got = {(x.query_id, x.rank): x.neighbour_id for x in kd.top_k(df, 4, every=every, **how).collect()}
    assert got == {q: i for q, i in brute_top(points, 4).items() if q[0] % every == 0}


def test_tree_search_is_exact_and_opens_few_leaves():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.1, (300, 8)) for c in range(10)])
    ids = r.permutation(len(x)).astype(np.int64)
    tree, opened = kd.Tree.of_bytes(kd.Tree.build(ids, x, 32).to_bytes()), []
    compare = tree._compare
    tree._compare = lambda leaf, rows, *a: (opened.append(len(rows)), compare(leaf, rows, *a))
    q = x[::50]
    row, near, d2 = tree.search(ids[::50], q, 5, np.full(len(q), np.inf))
    for k in range(len(q)):
        d = ((x - q[k]) ** 2).sum(1)
        want = sorted((d[j], ids[j]) for j in range(len(x)) if ids[j] != ids[50 * k])[:5]
        assert near[row == k].tolist() == [i for _, i in want] and np.allclose(d2[row == k], [a for a, _ in want])
    assert sum(opened) < 0.2 * len(q) * (tree.left[:, 0] < 0).sum()
    assert tree.search(ids[:3], x[:3], 5, np.zeros(3))[0].size == 0


def test_splits_place_every_row_into_a_cell_of_about_equal_size():
    r = np.random.default_rng(6)
    x = r.normal(size=(5000, 4))
    cell = kd.place(x, kd.fit_splits(x, 13))
    assert set(cell) == set(range(13)) and np.bincount(cell).max() <= 2 * 5000 / 8
    assert len(kd.fit_splits(np.ones((50, 2)), 8)) == 0


def test_awkward_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (2, [5.0, 5.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [None, 1.0]), (7, [3.0, 4.0]), (8, []), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id bigint, embedding array<double>, shard int, copy int, distance string")
    got = {(r.query_id, r.rank): (r.neighbour_id, r.distance) for r in kd.top_k(df, 3, every=1).collect()}
    assert got == {(1, 1): (2, 0.0), (1, 2): (7, 5.0), (2, 1): (1, 0.0), (2, 2): (7, 5.0), (7, 1): (1, 5.0), (7, 2): (2, 5.0)}
    assert kd.top_k(df.limit(0)).count() == 0
    alike = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(40)], "vec_id bigint, embedding array<double>")
    assert kd.top_k(alike, 2, every=1, shard_rows=5, leaf_rows=2).count() == 80


# 6


def jaccard(x, y):
    """Exact probability Jaccard by its definition; items of equal weights count together."""
    both = Counter((x.get(j, 0), y.get(j, 0)) for j in x.keys() | y.keys())
    return sum(n / sum(m * max(u / a, v / b) for (u, v), m in both.items()) for (a, b), n in both.items() if a and b)


def weighted_sets(texts):
    doc, item, weight = pmh.shingles(texts)
    sets = defaultdict(dict)
    for d, i, w in zip(doc.tolist(), item.tolist(), weight.tolist()):
        sets[d][i] = w
    return sets


def test_signatures_estimate_probability_jaccard():
    base = [f"w{k}" for k in range(120)]
    variants = [" ".join(base), " ".join(base[:100] + ["other"] * 20), " ".join(base[40:] + base[:10]), " ".join(["w1", "w2", "w3"] * 20 + base)]
    sets = weighted_sets(variants)
    sign, _ = pmh.sketch(variants, 4096)
    for a, b in combinations(range(len(variants)), 2):
        assert abs((sign[a] == sign[b]).mean() - jaccard(sets[a], sets[b])) < 0.035


def test_groups_of_all_documents_are_those_of_all_pairs(groups, texts):
    want = exact_groups({i: t for i, t in texts.items() if t})
    assert {i: groups.get(i, i) for i in want} == want and set(groups) <= set(want)


@pytest.fixture(scope="module")
def groups(spark, sf_dir):
    return {r.doc_id: r.group_id for r in queries()["op6_near_duplicates"](spark, sf_dir).collect()}


def test_near_duplicates_are_found(groups, texts):
    ids = sorted(i for i, t in texts.items() if len(pmh.WORDS.findall(t)) >= 3)  # shorter ones have no shingle of three
    words = [Counter(zip(w, w[1:], w[2:])) for w in (pmh.WORDS.findall(texts[i].lower()) for i in ids)]
    close = far = hit = 0
    for a, b in combinations(range(len(ids)), 2):
        both = sum((words[a] & words[b]).values())
        j = both / max(1, sum((words[a] | words[b]).values()))
        same = groups.get(ids[a], -1) == groups.get(ids[b], -2)
        if j >= 0.6:
            close += 1
            hit += same
        elif j < 0.3:
            far += same
    assert close > 20 and hit / close >= 0.95 and far == 0
    copies = defaultdict(list)
    for i in texts:
        if pmh.WORDS.search(texts[i]):
            copies[texts[i]].append(i)
    for same in copies.values():
        assert len(same) == 1 or len({groups[i] for i in same}) == 1
    assert all(g == min(i for i in groups if groups[i] == g) for g in set(groups.values()))


def test_one_of_each_group_stays(documents, groups):
    kept = {r.doc_id for r in pmh.near_dedup(documents).collect()}
    assert kept == {r.doc_id for r in documents.collect() if groups.get(r.doc_id, r.doc_id) == r.doc_id}


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(k, k + 1) for k in range(60) if k % 20] + [(int(a), int(b)) for a, b in r.integers(100, 140, (25, 2))] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    want = {i: find(i) for e in edges if e[0] != e[1] for i in e}
    got = {r.doc_id: r.group_id for r in pmh.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want


def test_near_duplicates_of_awkward_rows(awkward, empty):
    got = {r.doc_id: r.group_id for r in pmh.duplicate_groups(awkward).collect()}
    assert got[1] == got[2] == got[-10] == -10 and got[11] == got[12] == 11 and not {3, 4, 5, None} & set(got)
    kept = pmh.near_dedup(awkward)
    assert kept.columns == awkward.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, (r.doc_id for r in awkward.collect() if r.doc_id not in (1, 2, 12))))
    assert pmh.duplicate_groups(empty).count() == pmh.near_dedup(empty).count() == 0


def copies_of_one(n, at, similarity, seed):
    """Ideal signatures of n edited copies of an original, whose place among the ids is given."""
    r = np.random.default_rng(seed)
    original = r.integers(0, 1 << 32, pmh.REGISTERS, dtype=np.uint32)
    signs = np.where(r.random((n, pmh.REGISTERS)) < similarity, original, r.integers(0, 1 << 32, (n, pmh.REGISTERS), dtype=np.uint32))
    return np.insert(signs, at, original, axis=0)


def united(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    return [find(x) for x in range(n)]


NEED = math.ceil(pmh.CANDIDATE * pmh.REGISTERS)


def all_pairs(signs):
    return [(a, b) for a in range(len(signs)) for b in range(a) if (signs[a] == signs[b]).sum() >= NEED]


@pytest.mark.parametrize("dense", [pmh.DENSE, 0])
@pytest.mark.parametrize("n, similarity", [(60, 0.55), (200, 0.6), (120, 0.45), (120, 0.9)])
def test_components_of_a_bucket_are_exact(n, similarity, dense, monkeypatch):
    monkeypatch.setattr(pmh, "DENSE", dense)
    signs = np.concatenate([copies_of_one(n, n // 2, similarity, 6), copies_of_one(n // 2, n // 4, 0.6, 7)])
    found = pmh.links(signs, NEED)
    want = united(len(signs), all_pairs(signs))
    assert united(len(signs), [x[1:] for x in found]) == want and len(found) == len(signs) - len(set(want)) and all(want[a] == root for root, a, _ in found)
    odd = lambda a, bs: (a + bs) % 3 > 0
    found = pmh.links(signs, NEED, odd)
    assert united(len(signs), [x[1:] for x in found]) == united(len(signs), [(a, b) for a, b in all_pairs(signs) if odd(a, b)])


def test_a_bucket_of_unlike_members():
    r = np.random.default_rng(0)
    signs = r.integers(0, 1 << 32, (50_000, pmh.REGISTERS), dtype=np.uint32)
    signs[:, :4], signs[:, 20:50] = 7, np.arange(30)  # one band and a passage in common
    signs[40_000:40_010] = copies_of_one(9, 4, 0.8, 1)
    began = time.process_time()
    tracemalloc.start()
    found = pmh.links(signs, NEED)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 9 and time.process_time() - began < 60 and peak < 1_000_000_000


def exact_groups(texts):
    """{id: smallest id}: all candidates compared by exact similarity."""
    ids = sorted(texts)
    sign, has = pmh.sketch([texts[i] for i in ids])
    sets = weighted_sets([texts[i] for i in ids])
    pairs = [(a, b) for a, b in all_pairs(sign) if has[a] and has[b] and (sign[a] == sign[b]).reshape(-1, pmh.ROWS).all(1).any() and jaccard(sets[a], sets[b]) >= pmh.THRESHOLD - 1e-9]
    return {ids[k]: ids[root] for k, root in enumerate(united(len(ids), pairs)) if has[k]}


def test_similarity_is_the_exact_one():
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 12, 300)) for _ in range(6)] + ["a b c d e f", "a b c d e f a b c d e f", "x", ""]
    sets, plain = pmh.weighted_sets(texts), weighted_sets(texts)
    for a, b in combinations(range(len(texts)), 2):
        assert abs(pmh.similarity(sets[a], sets[b]) - jaccard(plain[a], plain[b])) < 1e-9


def near_copies(seed, size, edits, ids, original):
    r = np.random.default_rng(seed)
    words = [f"s{seed}w{k}" for k in range(size)]
    texts = {original: " ".join(words)}
    for k in ids:
        copy = list(words)
        for j in r.choice(size, edits, replace=False):
            copy[j] = f"x{k}y{j}"
        texts[k] = " ".join(copy)
    return texts


@pytest.mark.parametrize("wide", [pmh.WIDE, 16])
def test_groups_are_those_of_all_pairs(spark, wide):
    """Edited copies that meet through an original of a middle id, and texts around the threshold, in one and in many blocks."""
    texts = near_copies(1, 400, 30, [*range(40, 100), *range(101, 160)], 100) | near_copies(2, 200, 16, range(300, 340), 320)
    passage = " ".join(f"p{k}" for k in range(100))
    texts |= {k: passage + " " + " ".join(f"d{k}v{j}" for j in range(35 + k % 30)) for k in range(500, 560)}  # about half in common
    want = exact_groups(texts)
    df = spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string")
    got = {x.doc_id: x.group_id for x in pmh.duplicate_groups(df, wide=wide).collect()}
    assert {i: got.get(i, i) for i in want} == want and sum(g == 40 for g in got.values()) > 110
    assert 1 < len({want[k] for k in range(500, 560)}) < 60  # some pairs fail, some don't


def test_every_text_of_a_repeated_id_is_compared(spark):
    texts = [" ".join(f"{name}{k}" for k in range(60)) for name in "abcd"]
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (5, texts[2]), (5, texts[2]), (7, texts[1] + " more"), (8, texts[2]), (9, texts[3]), (9, texts[3] + " more")]
    got = {r.doc_id: r.group_id for r in pmh.duplicate_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 8: 1}


# 9


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_best_fill_is_the_best(counts, room):
    reach = {0}
    for n, c in counts.items():
        reach = {s + n * k for s in reach for k in range(c + 1) if s + n * k <= room}
    got = packing.best_fill(sorted(counts, reverse=True), counts, room)
    assert sum(n * k for n, k in got) == max(reach) and all(k <= counts[n] for n, k in got)


def covered(rows, capacity):
    spans = defaultdict(list)
    for w in rows:
        assert sum(w.lengths) == w.n_tokens <= capacity and w.slack == capacity - w.n_tokens
        for i, s, n in zip(w.doc_ids, w.starts, w.lengths):
            spans[i].append((s, n))
    return {i: sorted(x) for i, x in spans.items()}


def test_windows_hold_every_token_once(spark, sf_dir, texts):
    rows = queries()["op9_pack_windows"](spark, sf_dir).collect()
    spans, total = covered(rows, packing.CAPACITY), 0
    encode = packing.encoding(packing.VOCABULARY, packing.SPLIT).encode_ordinary
    for i, t in texts.items():
        at = 0
        for s, n in spans.get(i, []):
            assert s == at
            at += n
        assert at == len(encode(t))
        total += at
    assert len({w.window_id for w in rows}) == len(rows) and len(rows) <= -(-total // packing.CAPACITY) + 2


def test_packing_awkward_rows(awkward, empty):
    rows = packing.pack_windows(awkward, capacity=16, shard_docs=5).collect()
    covered(rows, 16)
    encode = packing.encoding(packing.VOCABULARY, packing.SPLIT).encode_ordinary
    want = Counter()
    for r in awkward.collect():
        want[r.doc_id] += len(encode(r.text or ""))
    got = Counter()
    for w in rows:
        for i, n in zip(w.doc_ids, w.lengths):
            got[i] += n
    assert got == +want
    assert packing.pack_windows(empty).count() == 0
