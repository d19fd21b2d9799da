"""Main-text extraction: a recurrent labeller of page blocks.

A page is cut into leaf blocks, runs of text between block-level tags.  Each block becomes a vector: its tag path
(hashed), its words (hashed), and a few plain measures such as length and the share of its text in links.  A
bidirectional LSTM in numpy reads the blocks of the page in order, so that every block is classified with the whole
document as its context; the blocks labelled content make up the text.

The network is fitted here, on the driver, to pages that :func:`synthetic_pages` composes from many layouts (with and
without semantic tags) together with a bounded number of rows of the table whose own ``article`` or ``main`` element
says what is content (``TRAIN_ROWS`` and ``TRAIN_CHARS``, in the order of a hash of the id).  These two tags are taken out of the paths that the network sees, so that it
can't just repeat them.  Labelling is one map over all pages, without a shuffle.

Defined results
---------------
* null html: null text, no labels;  empty html, or one without text: empty text, no labels;
* broken html (unclosed or stray tags, no body): read as far as it goes, in linear time, never an error; a tag that no
  ">" closes before the next "<" is text;
* very long pages: all blocks are read; the context is the whole page;
* null ids, repeated rows: one row out for each row in;  extra columns: not read;  empty table: empty result;
* pages of one id in training: the one with the least hash.

:func:`train` runs Spark jobs at once, :func:`extract_text` is lazy.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import map_arrow, one_text_each

TAGS, WORDS, PLAIN = 24, 16, 6
HIDDEN = 16
#: At most this many pages of the table are used for training, besides SYNTHETIC composed ones.
TRAIN_ROWS, SYNTHETIC = 150, 250
#: Characters of those pages together; a page that no longer fits is left out whole.
TRAIN_CHARS = 8_000_000
EPOCHS, BATCH, RATE, SEED = 6, 16, 0.02, 5
#: Blocks of pages labelled together, bounding memory.
TOGETHER = 20_000

#: Outside quotation marks a tag ends before the next "<", so that an open one costs no more than what is up to there.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^<>]*+>.*?(?:</\1\s*>|\Z)|<![^<>]*+>|<\?[^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^<>\"'])*+)>|([^<]+|<)", re.S | re.I
)
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([^"'>]+)""", re.I)
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
SEMANTIC = frozenset(("article", "main"))
HEAD = frozenset(("head", "title"))


def bucket(key: str, n: int) -> int:
    return xxhash.xxh32_intdigest(key.encode("utf-8", "surrogatepass")) % n


class Buckets(dict):
    """key -> bucket, emptied when full."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, key: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[key] = b = bucket(key, self.n)
        return b


_TAG, _WORD = Buckets(TAGS), Buckets(WORDS)


def blocks(page: str) -> list[tuple[str, tuple[int, ...], int, bool]]:
    """(text, path, characters in links, inside article or main) of every leaf block that has text, in order.

    The path is (its number of words, how many of them fall into each of TAGS buckets); its words are the names of the
    open elements and their class, id and role words, without article and main.  The counts follow the tags one by one,
    so that deep nesting costs no more than flat pages.
    """
    out: list[tuple[str, tuple[int, ...], int, bool]] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    path = [0] * (TAGS + 1)
    parts: list[str] = []
    opened: Counter[str] = Counter()  # names in the stack
    linked = semantic = head = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not head:
                out.append((text, tuple(path), min(linked, len(text)), semantic > 0))
            parts.clear()
        linked = 0

    def gone(left: str, words: tuple[int, ...]) -> None:
        nonlocal semantic, head
        opened[left] -= 1
        semantic -= left in SEMANTIC
        head -= left in HEAD
        for w in words:
            path[w] -= 1
        path[0] -= len(words)

    for m in TOKEN.finditer(page):
        text = m[5]
        if text is not None:
            parts.append(text)
            if opened["a"]:
                linked += len(text)
            continue
        name = m[3]
        if name is None:
            if m[1]:
                parts.append(" ")
            continue
        name = name.lower()
        if name in BLOCKS:
            close()
        if m[2]:
            if opened[name]:
                while stack[-1][0] != name:
                    gone(*stack.pop())
                gone(*stack.pop())
            continue
        if name in VOID or m[4].endswith("/"):
            continue
        if name in SELF_CLOSING and stack and stack[-1][0] == name:
            gone(*stack.pop())
        if name == "body" and head:
            for x in stack:
                if x[0] in HEAD:
                    gone(*x)
            stack[:] = [x for x in stack if x[0] not in HEAD]
        words = () if name in SEMANTIC else tuple(_TAG[w] + 1 for w in (name, *(w.lower() for c in CLASS.findall(m[4]) for w in re.split(r"[\s_\-]+", c) if w)))
        stack.append((name, words))
        for w in words:
            path[w] += 1
        path[0] += len(words)
        opened[name] += 1
        semantic += name in SEMANTIC
        head += name in HEAD
    close()
    return out


def vectors(found: list[tuple[str, tuple[int, ...], int, bool]]) -> np.ndarray:
    """One row for each block."""
    n = len(found)
    x = np.zeros((n, TAGS + WORDS + PLAIN), np.float32)
    for k, (text, path, linked, _) in enumerate(found):
        row = x[k]
        row[:TAGS] = path[1:]
        words = text.split()
        got = np.bincount([_WORD[w] for w in words], minlength=WORDS)
        row[TAGS : TAGS + WORDS] = got / len(words)
        row[TAGS + WORDS :] = (np.log1p(len(text)) / 6, linked / len(text), (text.count(".") + text.count(",")) / len(words), (k + 1) / n, path[0] / 10, text[-1] in ".!?:;")
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiLstm:
    """A bidirectional LSTM with a logistic unit on both states."""

    def __init__(self, seed: int = SEED):
        r, d = np.random.default_rng(seed), TAGS + WORDS + PLAIN
        self.p: dict[str, np.ndarray] = {}
        for way in "fb":
            self.p["x" + way] = r.normal(0, d**-0.5, (d, 4 * HIDDEN)).astype(np.float32)
            self.p["h" + way] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p["b" + way] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        self.p["out"] = r.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["out_bias"] = np.zeros(1, np.float32)

    def pass_over(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool = False):
        """States [time, page, hidden] of one direction; padding leaves a state as it is."""
        steps, n, _ = x.shape
        kind = self.p["out"].dtype
        h, c = np.zeros((n, HIDDEN), kind), np.zeros((n, HIDDEN), kind)
        out, saved = np.zeros((steps, n, HIDDEN), kind), []
        wx = x @ self.p["x" + way] + self.p["b" + way]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = wx[t] + h @ self.p["h" + way]
            i, f, o = sigmoid(z[:, :HIDDEN]), sigmoid(z[:, HIDDEN : 2 * HIDDEN]), sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep:
                saved.append((t, h, c, i, f, o, g, th, m))
            h, c = np.where(m, o * th, h), np.where(m, c2, c)
            out[t] = h
        return (out, saved) if keep else out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """[time, page] probabilities of content."""
        both = np.concatenate([self.pass_over(x, mask, "f"), self.pass_over(x, mask, "b")], 2)
        return sigmoid(both @ self.p["out"] + self.p["out_bias"][0])

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the real blocks."""
        hf, sf = self.pass_over(x, mask, "f", True)
        hb, sb = self.pass_over(x, mask, "b", True)
        both = np.concatenate([hf, hb], 2)
        d = (sigmoid(both @ self.p["out"] + self.p["out_bias"][0]) - y) * mask / mask.sum()
        grad = {"out": np.einsum("tn,tnh->h", d, both), "out_bias": d.sum(keepdims=True).ravel()}
        dh = d[:, :, None] * self.p["out"]
        return grad | self.back(x, sf, dh[:, :, :HIDDEN], "f") | self.back(x, sb, dh[:, :, HIDDEN:], "b")

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> BiLstm:
        """Back-propagation through whole pages, with Adam."""
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        r, step = np.random.default_rng(SEED + 1), 0
        use = [k for k in range(len(pages)) if len(pages[k])]
        for epoch in range(EPOCHS):
            order = sorted(use, key=lambda k: (len(pages[k]) // 8, r.random()))
            groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for gi in r.permutation(len(groups)):
                x, mask = padded([pages[k] for k in groups[gi]])
                y = np.zeros(mask.shape, np.float32)
                for j, k in enumerate(groups[gi]):
                    y[: len(labels[k]), j] = labels[k]
                grad = self.gradient(x, mask, y)
                step += 1
                rate = RATE * (1 - 0.8 * epoch / EPOCHS)
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.001 * (g * g - m2[k])
                    self.p[k] = (self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self

    def back(self, x: np.ndarray, saved: list, part: np.ndarray, way: str) -> dict[str, np.ndarray]:
        """Gradients of one direction."""
        n = x.shape[1]
        gx, gh = np.zeros_like(self.p["x" + way]), np.zeros_like(self.p["h" + way])
        gb = np.zeros_like(self.p["b" + way])
        h_next, c_next = np.zeros((n, HIDDEN), part.dtype), np.zeros((n, HIDDEN), part.dtype)
        for t, h, c, i, f, o, g, th, m in reversed(saved):
            dh = part[t] + h_next
            do = dh * m
            dc = np.where(m, c_next + do * o * (1 - th * th), 0)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), do * th * o * (1 - o), dc * i * (1 - g * g)], 1)
            gx += x[t].T @ dz
            gh += h.T @ dz
            gb += dz.sum(0)
            h_next = dz @ self.p["h" + way].T + np.where(m, 0, dh)
            c_next = np.where(m, dc * f, c_next)
        return {"x" + way: gx, "h" + way: gh, "b" + way: gb}


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[time, page, feature] and the mask of what is real."""
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), TAGS + WORDS + PLAIN), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def label_pages(model: BiLstm, pages: list[np.ndarray]) -> list[np.ndarray]:
    """For every page, which of its blocks are content; pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order, group, most = sorted(range(len(pages)), key=lambda k: len(pages[k])), [], 0
    order = [k for k in order if len(pages[k])]
    for n, k in enumerate(order):
        group.append(k)
        most = len(pages[k])
        if n + 1 == len(order) or (len(group) + 1) * max(most, len(pages[order[n + 1]])) > TOGETHER:
            x, mask = padded([pages[j] for j in group])
            p = model.scores(x, mask)
            for c, j in enumerate(group):
                out[j] = p[: len(pages[j]), c] >= 0.5
            group = []
    return out


def synthetic_pages(n: int = SYNTHETIC, seed: int = SEED) -> list[str]:
    """Pages of many layouts whose content lies in an article or main element; the words are made up."""
    r = random.Random(seed)
    syllables = "ta re mi so lu ken dor val est in ion an er qua ble so par ti".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    sentence = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi))).capitalize() + "."
    prose = lambda: " ".join(sentence(5, 18) for _ in range(r.randint(1, 6)))
    link = lambda: f'<a href="/{word()}">{word()}</a>'
    out = []
    for _ in range(n):
        menu = "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 12)))
        nav = r.choice((f"<nav><ul>{menu}</ul></nav>", f'<div class="menu"><ul>{menu}</ul></div>', f'<header id="top">{" | ".join(link() for _ in range(5))}</header>', ""))
        ad = r.choice((f'<div class="ad">{sentence(4, 14)}</div>', f'<div class="banner promo">{sentence(3, 9)} {link()}</div>', f"<aside>{prose()}</aside>", ""))
        body = [f"<h1>{sentence(2, 9)}</h1>"]
        for _ in range(r.randint(1, 14)):
            body.append(r.choice((f"<p>{prose()}</p>", f"<p>{prose()}</p>", f"<p>{sentence(1, 3)}</p>", f"<p><b>{prose()}<br><p>{prose()}</p>", f"<h2>{sentence(1, 6)}</h2>", f"<ul><li>{sentence(3, 12)}</li><li>{sentence(3, 12)}</li></ul>", f"<table><tr><td>{word()}</td><td>{r.randint(1, 9999)}</td></tr></table>", f"<blockquote>{prose()} {link()}</blockquote>")))
        side = r.choice((f'<div class="related"><h3>{word()}</h3><ul>{menu}</ul></div>', f'<div id="comments"><p>{sentence(3, 12)}</p></div>', ""))
        foot = r.choice((f"<footer>&copy; {word()}.example &middot; {sentence(3, 12)}</footer>", f'<div class="footer">{link()} {link()} {sentence(2, 8)}</div>', ""))
        name = r.choice(("article", "main"))
        first, last = r.choice(((nav + ad, side + foot), (nav, ad + foot), (nav + side, foot)))
        out.append(f"<html><head><title>{word()}</title></head><body>{first}<{name}>{''.join(body)}</{name}>{last}</body></html>")
    return out


def train(pages: DataFrame | None = None, rows: int = TRAIN_ROWS, id_col: str = "page_id", html_col: str = "html") -> BiLstm:
    """The labeller, fitted to composed pages and to at most `rows` pages of the table, in the order of a hash of the id."""
    texts = synthetic_pages()
    if pages is not None and rows:
        ids = pages.select(F.col(id_col).cast("bigint").alias("i")).where("i is not null").distinct().orderBy(F.xxhash64("i"), "i").limit(rows).collect()  # bounded by rows
        texts += one_text_each(pages, [x.i for x in ids], id_col, html_col, TRAIN_CHARS).values()
    found = [b for b in map(blocks, texts) if any(x[3] for x in b)]
    return BiLstm().fit([vectors(b) for b in found], [np.array([x[3] for x in b], np.float32) for b in found])


def extract_text(df: DataFrame, model: BiLstm, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, content): the content blocks joined by line breaks, and the label of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                pages = part.column(1).to_pylist()
                found = [blocks(h) if h else [] for h in pages]
                labels = label_pages(model, [vectors(f) for f in found])
                texts = [None if h is None else "\n".join(x[0] for x, y in zip(f, l) if y) for h, f, l in zip(pages, found, labels)]
                marks = [None if h is None else l.tolist() for h, l in zip(pages, labels)]
                columns = [part.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(marks, pa.list_(pa.bool_()))]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "text", "content"])

    return map_arrow(df.select(id_col, html_col), run, "page_id bigint, text string, content array<boolean>")
