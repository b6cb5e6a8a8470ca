"""Toxicity: a factorization machine over hashed terms, trained in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import drawn, in_training_part, table

#: Labelled rows of each class that the model is fitted on, about; the bound of what comes to the driver.
SAMPLE_ROWS = 3000
HASH_BITS = 20
PREFIXES = (4, 5, 6)
FACTORS = 4
#: Steps for the weights alone, as many again for weights and factors.
TRAIN_STEPS = 150
STEP = 0.05
#: A weight is drawn towards 0 with so many standard deviations of its gradient under chance, which eases as it grows past EASE. Every
#: term of the sample takes part at each step, with the others; a rare one is held back by as much as chance moves it. Chosen from 1.5 to 5 by
#: the log loss on rows of the training part with remainder 3, of a fit to those with 0 and 1; no held-out row was looked at.
SHRINK = 3.5
EASE = 0.1
TOXIC_FROM = 0.3
CACHED_WORDS = 400_000

_WORD = re.compile(r"\w+")


def hashed_terms(word: str) -> tuple[int, ...]:
    """Buckets of a lower-case word: itself, and its first letters (stems take many endings)."""
    terms = [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return tuple(zlib.crc32(t.encode("utf-8", "replace")) >> (32 - HASH_BITS) for t in terms)


def document_terms(text: str | None) -> np.ndarray:
    """Buckets of the whole text, each once."""
    found: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        found.update(hashed_terms(word))
    return np.array(sorted(found), np.int32)


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the terms of a text that the sample has; ``place`` gives the row
    of each bucket, -1 for those that no sampled document has."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray


class SparseRows:
    """A matrix of 0 and 1, by the columns of each row; every column has a 1. Products with vectors and matrices only."""

    dtype = np.dtype(np.float32)

    def __init__(self, rows: list[np.ndarray], width: int):
        lengths = np.array([len(r) for r in rows], np.int64)
        columns = np.concatenate(rows).astype(np.int32, copy=False)
        counts = np.bincount(columns, minlength=width)
        self.counts = counts
        self._take, self._sizes = columns, lengths
        # Owners in the order of the columns: one number holds both, so that the sort needs no room beside it.
        both = columns.astype(np.int64) << 32
        both |= np.repeat(np.arange(len(rows), dtype=np.int64), lengths)
        both.sort()
        self._back, self._back_sizes = both.astype(np.int32), counts

    def __matmul__(self, other: np.ndarray) -> np.ndarray:
        return _sums(other, self._take, self._sizes)

    @property
    def T(self) -> SparseRows:  # noqa: N802
        turned = object.__new__(SparseRows)
        turned._take, turned._sizes, turned._back, turned._back_sizes = self._back, self._back_sizes, self._take, self._sizes
        return turned


def _sums(values: np.ndarray, take: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the ``values`` taken for each row, so many as its size."""
    if values.ndim == 2:
        if not values.shape[1]:
            return np.zeros((len(sizes), 0), values.dtype)
        return np.stack([_sums(np.ascontiguousarray(c), take, sizes) for c in values.T], axis=1)
    out = np.zeros(len(sizes), values.dtype)
    filled = np.flatnonzero(sizes)
    if len(filled):
        out[filled] = np.add.reduceat(values[take], (np.cumsum(sizes) - sizes)[filled])
    return out


def loss_and_gradients(x, y: np.ndarray, bias: np.ndarray, w: np.ndarray, v: np.ndarray, decay):
    """Mean logistic loss of rows of 0/1 terms with weight decay (one for all terms or one for each), and gradients of bias, w and v."""
    decay = np.broadcast_to(np.asarray(decay, w.dtype), w.shape)
    sums = x @ v
    scores = bias + x @ w + 0.5 * ((sums * sums).sum(axis=1) - x @ (v * v).sum(axis=1))
    p = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    size = (decay * (w * w + (v * v).sum(axis=1))).sum()
    loss = float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean() + 0.5 * size)
    g = ((p - y) / len(y)).astype(x.dtype)
    g_terms = x.T @ g
    g_v = x.T @ (g[:, None] * sums) - g_terms[:, None] * v + decay[:, None] * v
    return loss, [np.array([g.sum()]), g_terms + decay * w, g_v]


def _descend(array: np.ndarray, grad: np.ndarray, chance: np.ndarray, state: list[np.ndarray], step: int) -> None:
    """A step of Adam in place, then a pull to 0 in the same metric by SHRINK times ``chance``, the gradient's deviation."""
    first, second = state
    first += 0.1 * (grad - first)
    second += 0.01 * (grad * grad - second)
    rate = STEP / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    array -= rate * first / (1 - 0.9**step)
    pull = rate * SHRINK * chance / (1 + np.abs(array) / EASE)
    array[:] = np.sign(array) * np.maximum(np.abs(array) - pull, 0)


def train(terms: list[np.ndarray], toxic: list[int], prior: float | None = None, steps: int = TRAIN_STEPS, seed: int = 5) -> Machine:
    """Fit a machine to labelled term sets over all their terms. ``prior`` is the share of toxic rows where the model will be used; the
    bias is moved from the sample's share to it. Same input, same machine.

    Weights are fitted first. The factors then start at multiples of them, so that a term that only counts beside another, like a
    group's name beside an insult, has a gradient although it alone says nothing."""
    y = np.asarray(toxic, np.float32)
    seen = np.unique(np.concatenate(terms)) if len(terms) and 0 < y.sum() < len(y) else np.zeros(0, np.int32)
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[seen] = np.arange(len(seen), dtype=np.int32)
    share = float(y.mean()) if len(y) else 0.5
    bias, w, v = np.zeros(1, np.float32), np.zeros(len(seen), np.float32), np.zeros((len(seen), FACTORS), np.float32)
    if len(seen):
        x = SparseRows([place[t] for t in terms], len(seen))
        chance = lambda squares: np.sqrt(share * (1 - share) * np.maximum(squares, 0)) / len(y)
        alone = chance(x.counts).astype(np.float32)
        for factors in (v[:, :0], v):
            if factors.shape[1]:
                v += w[:, None] * np.random.default_rng(seed).standard_normal(FACTORS).astype(np.float32)
            states = [[np.zeros_like(a), np.zeros_like(a)] for a in (bias, w, factors)]
            for step in range(1, steps + 1):
                _, grads = loss_and_gradients(x, y, bias, w, factors, decay=1e-5)
                if factors.shape[1] and step % 10 == 1:
                    beside = chance(x.T @ np.square(x @ factors)).astype(np.float32)
                _descend(bias, grads[0], np.zeros(1), states[0], step)
                _descend(w, grads[1], alone, states[1], step)
                if factors.shape[1]:
                    _descend(factors, grads[2], beside, states[2], step)
    odds = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    base = float(bias[0]) if len(seen) else odds(share)
    return Machine(place, base + (0.0 if prior is None else float(odds(prior) - odds(share))), w, v)


def scores(machine: Machine, texts: list[str | None]) -> np.ndarray:
    cache: dict[str, tuple[int, ...]] = {}
    out = np.empty(len(texts))
    for row, text in enumerate(texts):
        found: set[int] = set()
        for word in set(_WORD.findall((text or "").lower())):
            places = cache.get(word)
            if places is None:
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                places = cache[word] = tuple(p for p in machine.place[list(hashed_terms(word))].tolist() if p >= 0)
            if places:
                found.update(places)
        own = sorted(found)
        v = machine.factors[own].astype(np.float64)
        total = v.sum(axis=0)
        out[row] = machine.bias + machine.weights[own].sum(dtype=np.float64) + 0.5 * float((total * total - (v * v).sum(axis=0)).sum())
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted to about ``rows`` documents of each label of the training part, chosen by a hash of the id.

    The sample is drawn from the labels, so its size is known before it is sent to the documents; they are not shuffled, and term
    sets, not texts, come back. A document labelled twice counts as toxic if any label says so; null labels don't count. Of an id that
    several rows share, one text is taken, that of the least hash, so that no more rows come back than were drawn.
    """
    known = labels.where(in_training_part() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, rows / n))).otherwise(share)
    sample = F.broadcast(known.where(drawn(F.xxhash64("doc_id", F.lit(3)), share)))  # about 2 * rows rows of an id and a label

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "terms": [document_terms(t) for t in batch["text"]]})

    texts = docs.select("doc_id", F.struct(F.xxhash64("text").alias("hash"), "text").alias("own")).join(sample, "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("own").alias("own")).select("doc_id", "toxic", "own.text")
    rows_of = texts.mapInPandas(run, "doc_id long, toxic int, terms array<int>")
    found = rows_of.toPandas()
    found = found.assign(key=[np.asarray(t, np.int32).tobytes() for t in found["terms"]]).sort_values(["doc_id", "key"])
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else None
    terms, toxic = [np.asarray(t, np.int32) for t in found["terms"]], found["toxic"].tolist()
    del found  # it holds the sample twice
    return train(terms, toxic, prior)


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` (any columns, text among them) with toxicity (0 to 1), which replaces a column of that name. Null and empty texts have
    no terms and get the score of the bias; a machine without terms gives every row that. Equal texts get equal scores."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(machine, texts.tolist()))

    return docs.withColumn("toxicity", score(F.col("text")))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, scored by a machine fitted on the training part's labels; see ``fit`` and ``score_toxicity``."""
    docs = table(spark, sf_dir, "documents")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", F.coalesce(~in_training_part(), F.lit(False)).alias("held_out"), "text"), machine)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= TOXIC_FROM).cast("int").alias("predicted"))
