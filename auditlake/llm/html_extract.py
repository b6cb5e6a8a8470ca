"""HTML extraction: a bidirectional LSTM labels the leaf blocks of a page as main text or not."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from auditlake.llm.common import cut_table, drawn, drop_table, table
from auditlake.llm.html_blocks import Block, leaf_blocks
from auditlake.llm.html_pages import PageMaker

#: Pages whose text the training pages are set from, all of it; so many of their texts come to the driver, about, of so many characters at most.
SAMPLE_PAGES = 400
SAMPLE_TEXTS = 8000
TEXT_CHARS = 1000
TAG_BUCKETS, WORD_BUCKETS = 2048, 4096
TAG_SIZE, LEAF_SIZE, WORD_SIZE, NUMBERS = 16, 8, 8, 4
HIDDEN = 16
TRAIN_PAGES, TRAIN_STEPS, TRAIN_BATCH = 3000, 480, 24
#: Pages that are labelled together, and blocks with which the longest of them is padded to.
GROUP = 256
GROUP_BLOCKS = 1 << 15
CACHED_WORDS = 300_000


def _bucket(kind: str, term: str, buckets: int) -> int:
    return zlib.crc32(f"{kind}{term}".encode("utf-8", "replace")) % buckets


@dataclass
class Features:
    """Blocks of some pages, one after another: buckets of their paths and words with where each block's begin, and numbers."""

    path: np.ndarray
    path_start: np.ndarray
    leaf: np.ndarray
    word: np.ndarray
    word_start: np.ndarray
    numbers: np.ndarray


_cache: dict[str, int] = {}


def _word_bucket(word: str) -> int:
    bucket = _cache.get(word)
    if bucket is None:
        if len(_cache) >= CACHED_WORDS:
            _cache.clear()
        bucket = _cache[word] = _bucket("w", word.lower().strip(".,;:!?()\"'"), WORD_BUCKETS)
    return bucket


def features(blocks: list[Block]) -> Features:
    path, path_start, leaf, word, word_start, numbers = [], [], [], [], [], []
    for b in blocks:
        path_start.append(len(path))
        path += [_bucket("t", p, TAG_BUCKETS) for p in b.path] or [0]
        tag = next((p for p in reversed(b.path) if p[0] != "."), "")
        leaf.append(_bucket("l", tag, TAG_BUCKETS))
        words = b.text.split()
        word_start.append(len(word))
        word += map(_word_bucket, words)
        ends = b.text.rstrip("\"')").endswith((".", "!", "?"))
        numbers.append((np.log1p(len(words)) / 4, b.linked / max(1, len(b.text)), float(ends), len(b.path) / 10))
    ints = lambda x: np.asarray(x, np.int64)
    return Features(ints(path), ints(path_start), ints(leaf), ints(word), ints(word_start), np.asarray(numbers, np.float32).reshape(-1, NUMBERS))


@dataclass
class Labeller:
    """Tables of path, leaf and word vectors; for each direction the input, recurrent and bias weights of the four gates; output."""

    tags: np.ndarray
    leaves: np.ndarray
    words: np.ndarray
    forward: list[np.ndarray]
    backward: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.tags, self.leaves, self.words, *self.forward, *self.backward, self.out, self.bias]


def new_labeller(seed: int = 9) -> Labeller:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    size = TAG_SIZE + LEAF_SIZE + WORD_SIZE + NUMBERS

    def direction() -> list[np.ndarray]:
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
        return [normal(size, 4 * HIDDEN, scale=size**-0.5), normal(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5), bias]

    return Labeller(
        normal(TAG_BUCKETS, TAG_SIZE, scale=0.1),
        normal(TAG_BUCKETS, LEAF_SIZE, scale=0.1),
        np.zeros((WORD_BUCKETS, WORD_SIZE), np.float32),
        direction(),
        direction(),
        normal(2 * HIDDEN, scale=0.2),
        np.zeros(1, np.float32),
    )


def _inputs(m: Labeller, f: Features) -> np.ndarray:
    """A vector for each block: mean of its path's vectors, its leaf tag's vector, mean of its words' vectors, numbers."""
    count = lambda start, total: np.diff(np.append(start, total))[:, None].astype(np.float32)
    path = np.add.reduceat(m.tags[f.path], f.path_start, axis=0) / np.sqrt(count(f.path_start, len(f.path)))
    words = np.add.reduceat(m.words[f.word], f.word_start, axis=0) / count(f.word_start, len(f.word))
    return np.concatenate([path, m.leaves[f.leaf], words, f.numbers], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(weights: list[np.ndarray], x: np.ndarray, active: list[int], order, keep: list | None = None) -> np.ndarray:
    """States (steps, pages, hidden) of inputs (steps, pages, size); page k takes part in step t if k < active[t]."""
    w, u, b = weights
    given = x @ w + b
    states = np.zeros((*x.shape[:2], HIDDEN), np.float32)
    h, c = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
    for t in order:
        k = active[t]
        gates = given[t, :k] + h[:k] @ u
        i, f, o = (_sigmoid(gates[:, n * HIDDEN : (n + 1) * HIDDEN]) for n in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        new = f * c[:k] + i * g
        if keep is not None:
            keep.append((t, k, h[:k].copy(), c[:k].copy(), i, f, o, g, new))
        c[:k] = new
        h[:k] = o * np.tanh(new)
        states[t, :k] = h[:k]
    return states


def _padded(x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[int], tuple[np.ndarray, np.ndarray]]:
    """Inputs as (steps, pages, size), pages in the given order, which must be longest first; and each block's step and page."""
    page = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    wide = np.zeros((int(lengths.max(initial=0)), len(lengths), x.shape[1]), np.float32)
    wide[step, page] = x
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(len(wide))]
    return wide, active, (step, page)


def label(m: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Probability of being main text for each block of each page."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: -len(pages[i]))
    at = 0
    while at < len(order):
        size = max(1, min(GROUP, GROUP_BLOCKS // len(pages[order[at]])))  # the longest comes first, and all are padded to it
        group = order[at : at + size]
        at += size
        lengths = np.array([len(pages[i]) for i in group])
        x, active, where = _padded(_inputs(m, features([b for i in group for b in pages[i]])), lengths)
        ahead = _lstm(m.forward, x, active, range(len(x)))
        back = _lstm(m.backward, x, active, range(len(x) - 1, -1, -1))
        p = _sigmoid(np.concatenate([ahead, back], axis=2)[where] @ m.out + m.bias)
        for i, part in zip(group, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
            out[i] = part
    return out


def _back(weights: list[np.ndarray], x: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of the direction's weights and of its inputs."""
    w, u, b = weights
    d_u, d_given = np.zeros_like(u), np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
    d_h, d_c = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
    for t, k, h, c, i, f, o, g, new in reversed(kept):
        dh = d_h[:k] + d_states[t, :k]
        squashed = np.tanh(new)
        dc = d_c[:k] + dh * o * (1 - squashed * squashed)
        d = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        d_given[t, :k] = d
        d_u += h.T @ d
        d_h[:k], d_c[:k] = d @ u.T, dc * f
    flat = d_given.reshape(-1, 4 * HIDDEN)
    return [x.reshape(-1, x.shape[2]).T @ flat, d_u, flat.sum(axis=0)], d_given @ w.T


def loss_and_gradients(m: Labeller, pages: list[list[Block]], labels: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
    pages, y = [pages[i] for i in order], np.concatenate([labels[i] for i in order]).astype(np.float32)
    f = features([b for p in pages for b in p])
    x, active, where = _padded(_inputs(m, f), np.array([len(p) for p in pages]))
    kept_f, kept_b = [], []
    states = np.concatenate(
        [_lstm(m.forward, x, active, range(len(x)), kept_f), _lstm(m.backward, x, active, range(len(x) - 1, -1, -1), kept_b)], axis=2
    )
    own = states[where]
    p = _sigmoid(own @ m.out + m.bias)
    loss = float(-(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)).mean())
    d = (p - y) / len(y)
    d_states = np.zeros_like(states)
    d_states[where] = d[:, None] * m.out
    grads_f, d_x_f = _back(m.forward, x, kept_f, d_states[:, :, :HIDDEN])
    grads_b, d_x_b = _back(m.backward, x, kept_b, d_states[:, :, HIDDEN:])
    d_in = (d_x_f + d_x_b)[where]
    d_tags, d_leaves, d_words = np.zeros_like(m.tags), np.zeros_like(m.leaves), np.zeros_like(m.words)
    n_path = np.diff(np.append(f.path_start, len(f.path)))
    n_word = np.diff(np.append(f.word_start, len(f.word)))
    np.add.at(d_tags, f.path, np.repeat(d_in[:, :TAG_SIZE] / np.sqrt(n_path)[:, None], n_path, axis=0))
    np.add.at(d_leaves, f.leaf, d_in[:, TAG_SIZE : TAG_SIZE + LEAF_SIZE])
    at = TAG_SIZE + LEAF_SIZE
    np.add.at(d_words, f.word, np.repeat(d_in[:, at : at + WORD_SIZE] / n_word[:, None], n_word, axis=0))
    return loss, [d_tags, d_leaves, d_words, *grads_f, *grads_b, own.T @ d, np.array([d.sum()], np.float32)]


def training_pages(sentences: list[str], n: int, seed: int = 3) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Pages made by ``PageMaker``, as blocks and labels."""
    maker = PageMaker(sentences, seed)
    pages, labels = [], []
    for _ in range(n):
        blocks = leaf_blocks(maker.page())
        labels.append(np.array([maker.MARK in b.text for b in blocks], np.float32))
        pages.append([Block(b.text.replace(maker.MARK, ""), b.path, b.linked) for b in blocks])
    return pages, labels


def train(sentences: list[str], steps: int = TRAIN_STEPS, seed: int = 9) -> Labeller:
    """Fit a labeller with Adam to pages set from the sentences. Same input, same labeller."""
    m = new_labeller(seed)
    pages, labels = training_pages(sentences, TRAIN_PAGES, seed)
    rng = np.random.default_rng(seed)
    arrays = m.arrays()
    first, second = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(pages), TRAIN_BATCH)
        _, grads = loss_and_gradients(m, [pages[i] for i in chosen], [labels[i] for i in chosen])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.012 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for a, g, u, s in zip(arrays, grads, first, second, strict=True):
            g = g / max(1.0, norm)
            u += 0.1 * (g - u)
            s += 0.01 * (g * g - s)
            a -= rate * (u / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return m


@F.pandas_udf(ArrayType(StringType()))
def _texts(htmls: pd.Series) -> pd.Series:
    return htmls.map(lambda page: [b.text for b in leaf_blocks(page)])


def sentences_of(pages: DataFrame, n: int = SAMPLE_PAGES, texts: int = SAMPLE_TEXTS) -> list[str]:
    """Texts to set training pages from: blocks of about ``n`` whole pages, chosen by a hash of url and html at a rate that follows from the
    number of pages; longer ones than TEXT_CHARS in sentences. Of these about ``texts`` are chosen in the same way."""
    rate = min(1.0, n / max(1, pages.select(F.lit(1)).count()))
    chosen = pages.where(F.col("html").isNotNull() & drawn(F.xxhash64("url", "html", F.lit(2)), rate)).select("html").distinct()  # a page may be repeated without bound
    each = chosen.select(F.explode(_texts(F.col("html"))).alias("text"))
    parts = F.when(F.length("text") > TEXT_CHARS, F.split("text", r"(?<=[.!?])\s+")).otherwise(F.array("text"))
    each = cut_table(each.select(F.explode(parts).alias("text")).where(F.length("text").between(13, TEXT_CHARS)).distinct())
    rate = min(1.0, texts / max(1, each.count()))
    found = sorted(r["text"] for r in each.where(drawn(F.xxhash64("text", F.lit(3)), rate)).collect())
    drop_table(each)
    return found


def main_text(m: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page: blocks labelled so, in page order, joined by one space."""
    blocks = [leaf_blocks(p) for p in pages]
    return [" ".join(b.text for b, q in zip(own, p, strict=True) if q >= 0.5) for own, p in zip(blocks, label(m, blocks), strict=True)]


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row. Null and empty html gives an empty text; repeated rows give equal
    results; null ids stay; no rows give none; other columns are left out. Only html is sent to Python, in batches."""

    @F.pandas_udf("text string, n_chars long")
    def main(htmls: pd.Series) -> pd.DataFrame:
        text = main_text(labeller, htmls.tolist())
        return pd.DataFrame({"text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", main(F.col("html")).alias("main"))
    return rows.select("page_id", "url", "main.*")


def fit(pages: DataFrame) -> Labeller:
    return train(sentences_of(pages))


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages``; see ``extract``, with a labeller fitted on a sample of them."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
