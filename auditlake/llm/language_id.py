"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import drawn, in_training_part, table

UNDETERMINED = "und"
#: Bounds of the labelled sample that the model is fitted on: rows for each language, and characters of each row.
SAMPLE_ROWS = 1000
SAMPLE_CHARS = 600
HIDDEN = 12
WINDOW = 128
BLOCK = 4096
#: Texts that are strings of Python at the same time; about a block of windows.
ROWS_AT_ONCE = 256
TRAIN_STEPS = 420
TRAIN_BATCH = 192
TRAIN_WINDOW = 64
#: Documents whose pooled probability of the predicted language is lower are rejected.
LEAST_SCORE = 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Direction:
    """One direction: input tables for the gate and the candidate state, and their recurrent matrices.

    gate = sigmoid(gate_in[byte] + h gate_h); new = tanh(new_in[byte] + gate * (h new_h)); h = gate * h + (1 - gate) * new
    """

    gate_in: np.ndarray
    new_in: np.ndarray
    gate_h: np.ndarray
    new_h: np.ndarray
    out: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.gate_in, self.new_in, self.gate_h, self.new_h, self.out]


@dataclass
class Model:
    languages: list[str]
    forward: Direction
    backward: Direction
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.forward.arrays(), *self.backward.arrays(), self.bias]


def new_model(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)

    def direction() -> Direction:
        gate_in = normal(256, hidden, scale=0.3) + np.float32(0.5)
        matrices = [normal(hidden, hidden, scale=hidden**-0.5) for _ in range(2)]
        return Direction(gate_in, normal(256, hidden, scale=0.5), *matrices, normal(hidden, len(languages), scale=hidden**-0.5))

    return Model(languages, direction(), direction(), np.zeros(len(languages), np.float32))


def _step(d: Direction, x: np.ndarray, h: np.ndarray, gate: np.ndarray, new: np.ndarray, work: np.ndarray) -> None:
    """One byte for all windows; h is changed in place. The last three are room for results."""
    np.take(d.gate_in, x, axis=0, out=gate, mode="clip")
    gate += np.dot(h, d.gate_h, out=work)
    gate *= 0.5
    np.tanh(gate, out=gate)
    gate *= 0.5
    gate += 0.5
    np.take(d.new_in, x, axis=0, out=new, mode="clip")
    np.dot(h, d.new_h, out=work)
    work *= gate
    new += work
    np.tanh(new, out=new)
    h -= new
    h *= gate
    h += new


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=-1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=-1, keepdims=True)
    return scores


def _label_windows(model: Model, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities summed over the letters of each window (rows of ``windows``, longest first), and how many letters."""
    x = np.ascontiguousarray(windows.T).astype(np.intp)
    steps, n = x.shape
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # windows longer than t
    scores = np.zeros((steps, n, len(model.languages)), np.float32)
    room = [np.empty((n, len(model.forward.new_h)), np.float32) for _ in range(3)]
    for d, order in ((model.forward, range(steps)), (model.backward, range(steps - 1, -1, -1))):
        h = np.zeros((n, len(d.new_h)), np.float32)
        for t in order:
            if k := active[t]:
                _step(d, x[t, :k], h[:k], *(r[:k] for r in room))
                scores[t, :k] += h[:k] @ d.out
    letters = _LETTER[x] & (np.arange(steps)[:, None] < lengths)
    scores += model.bias
    probabilities = _softmax(scores)
    return np.einsum("tbc,tb->bc", probabilities, letters.astype(np.float32)), letters.sum(axis=0)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and pooled probability of every text. Each text is cut into windows that cover all of it; every position of a
    window is labelled and the probabilities at letters are averaged over the document."""
    if not model.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    sums, counts = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    owners, starts = [], []
    for i, r in enumerate(raw):
        for start in range(0, len(r), WINDOW):
            owners.append(i)
            starts.append(start)
    lengths = np.array([min(WINDOW, len(raw[i]) - s) for i, s in zip(owners, starts, strict=True)], np.int64)
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), BLOCK):
        chosen = order[at : at + BLOCK]
        windows = np.zeros((len(chosen), WINDOW), np.uint8)
        for row, k in enumerate(chosen.tolist()):
            windows[row, : lengths[k]] = np.frombuffer(raw[owners[k]], np.uint8, lengths[k], starts[k])
        pooled, letters = _label_windows(model, _LOWER[windows], lengths[chosen])
        owner = np.array([owners[k] for k in chosen.tolist()], np.int64)
        np.add.at(sums, owner, pooled)
        np.add.at(counts, owner, letters)
    best = sums.argmax(axis=1)
    score = sums[np.arange(len(texts)), best] / np.maximum(counts, 1)
    known = [n > 0 and (t.isascii() or any(map(str.isalpha, t))) for n, t in zip(counts, texts, strict=True)]
    return (
        [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)],
        [min(1.0, float(s)) if k else 0.0 for s, k in zip(score, known, strict=True)],
    )


def _run_through(d: Direction, x: np.ndarray) -> tuple[list, np.ndarray]:
    """States of a training batch (steps, windows), with what the way back needs."""
    h, kept, states = np.zeros((x.shape[1], len(d.new_h)), np.float32), [], []
    for row in x:
        gate = 1 / (1 + np.exp(-(d.gate_in[row] + h @ d.gate_h)))
        inner = h @ d.new_h
        new = np.tanh(d.new_in[row] + gate * inner)
        kept.append((h, gate, inner, new))
        h = gate * h + (1 - gate) * new
        states.append(h)
    return kept, np.stack(states)


def _back_through(d: Direction, x: np.ndarray, kept: list, d_states: np.ndarray) -> list[np.ndarray]:
    """Gradients of gate_in, new_in, gate_h and new_h."""
    d_gate_h, d_new_h = np.zeros_like(d.gate_h), np.zeros_like(d.new_h)
    d_gates, d_news = np.empty_like(d_states), np.empty_like(d_states)
    carry = np.zeros_like(d_states[0])
    for t in range(len(x) - 1, -1, -1):
        h, gate, inner, new = kept[t]
        d_h = d_states[t] + carry
        d_new = d_h * (1 - gate) * (1 - new * new)
        d_inner = d_new * gate
        d_gate = (d_h * (h - new) + d_new * inner) * gate * (1 - gate)
        d_gate_h += h.T @ d_gate
        d_new_h += h.T @ d_inner
        carry = d_h * gate + d_gate @ d.gate_h.T + d_inner @ d.new_h.T
        d_gates[t], d_news[t] = d_gate, d_new
    d_gate_in, d_new_in = np.zeros_like(d.gate_in), np.zeros_like(d.new_in)
    np.add.at(d_gate_in, x.ravel(), d_gates.reshape(-1, d_gates.shape[-1]))
    np.add.at(d_new_in, x.ravel(), d_news.reshape(-1, d_news.shape[-1]))
    return [d_gate_in, d_new_in, d_gate_h, d_new_h]


def loss_and_gradients(model: Model, x: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the letters of a batch (steps, windows of bytes), and its gradients in the order of arrays()."""
    kept_f, states_f = _run_through(model.forward, x)
    kept_b, states_b = _run_through(model.backward, x[::-1])
    states_b = states_b[::-1]
    p = _softmax(states_f @ model.forward.out + states_b @ model.backward.out + model.bias)
    weight = _LETTER[x].astype(np.float32)
    weight /= max(1.0, float(weight.sum()))
    windows = np.arange(x.shape[1])
    loss = float(-(np.log(p[:, windows, labels] + 1e-9) * weight).sum())
    p[:, windows, labels] -= 1
    p *= weight[..., None]
    hidden = states_f.shape[-1]
    flat = p.reshape(-1, p.shape[-1])
    grads_f = _back_through(model.forward, x, kept_f, p @ model.forward.out.T)
    grads_b = _back_through(model.backward, x[::-1], kept_b, (p @ model.backward.out.T)[::-1])
    grads_f.append(states_f.reshape(-1, hidden).T @ flat)
    grads_b.append(states_b.reshape(-1, hidden).T @ flat)
    return loss, [*grads_f, *grads_b, flat.sum(axis=0)]


def train(texts: list[str], labels: list[str], steps: int = TRAIN_STEPS, seed: int = 7) -> Model:
    """Fit a model with Adam on windows drawn from labelled texts, as many of each language. Same input, same model."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    model = new_model(languages, seed=seed)
    by_language = [
        [_LOWER[np.frombuffer(t.encode(), np.uint8)] for t, own in zip(texts, labels, strict=True) if own == language]
        for language in languages
    ]
    by_language = [[t for t in own if len(t) >= TRAIN_WINDOW] or [np.resize(t, TRAIN_WINDOW) for t in own if len(t)] for own in by_language]
    if not languages or not all(by_language):
        return Model([], model.forward, model.backward, model.bias)
    arrays = model.arrays()
    first, second = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    for step in range(1, steps + 1):
        own = rng.integers(0, len(languages), TRAIN_BATCH)
        x = np.empty((TRAIN_WINDOW, TRAIN_BATCH), np.intp)
        for column, language in enumerate(own.tolist()):
            text = by_language[language][rng.integers(len(by_language[language]))]
            start = rng.integers(len(text) - TRAIN_WINDOW + 1)
            x[:, column] = text[start : start + TRAIN_WINDOW]
        _, grads = loss_and_gradients(model, x, own)
        scale = min(1.0, 1.0 / (np.sqrt(sum(float((g * g).sum()) for g in grads)) + 1e-9))
        rate = 0.02 * min(1.0, step / 20) * (1 - step / (steps + 1))
        for a, g, m, v in zip(arrays, grads, first, second, strict=True):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled text: of each language about ``rows`` documents of the training part, chosen by a hash of id and
    text at a rate that follows from the language's count, and ``chars`` characters of each from a place that the hash names. Repeated rows count once."""
    labelled = docs.where(in_training_part() & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for language, n in counts.items():
        rate = F.when(F.col("lang") == language, F.lit(min(1.0, rows / n))).otherwise(rate)
    mark = F.xxhash64("doc_id", "text", F.lit(11))
    start = F.pmod(mark, F.greatest(F.length("text") - chars, F.lit(1))) + 1
    chosen = labelled.where(drawn(mark, rate))
    found = chosen.select("lang", F.substring("text", start, F.lit(chars)).alias("part"), mark.alias("mark")).distinct().collect()
    found.sort(key=lambda r: (r["lang"], r["mark"], r["part"]))
    return [r["part"] for r in found], [r["lang"] for r in found]


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return train(*training_sample(docs, rows))


def label_batch(model: Model, texts: pa.Array) -> pa.Array:
    """struct<lang, score> of each text of a batch, of which few at once become strings of Python."""
    found = [predict(model, texts.slice(at, ROWS_AT_ONCE).to_pylist()) for at in range(0, len(texts), ROWS_AT_ONCE)]
    language, score = [name for names, _ in found for name in names], [s for _, scores in found for s in scores]
    return pa.StructArray.from_arrays([pa.array(language, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (any columns, text among them) with lang_pred and lang_score, which replace columns of these names.

    Null texts and texts without a letter get ``und`` and 0; so does everything if the model saw no language. Equal texts get
    equal predictions whatever their other columns. Batches stream through as Arrow, and Python holds ``ROWS_AT_ONCE`` texts of one.
    """

    @F.arrow_udf("lang string, score double")
    def label(texts: pa.Array) -> pa.Array:
        return label_batch(model, texts)

    own = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    with_label = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), label(F.col("text")).alias("label"))
    return with_label.select("own.*", F.col("label.lang").alias("lang_pred"), F.col("label.score").alias("lang_score"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; see ``fit`` and ``identify``."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (~in_training_part()).alias("held_out"), "text")
    named = identify(rows, fit(docs)).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
    return named.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
