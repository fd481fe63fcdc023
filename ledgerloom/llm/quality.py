"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network calibrated by temperature.

Each word (or, if it is rare, its shape) owns a random sparse index vector; its word vector is the normalised sum of the
index vectors around its occurrences in the training texts. A document is the mean of its word vectors, the mean product
of neighbouring ones and its length.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_held_out
from .training import labelled

#: Labelled rows of each class that are learned from, at most; words and shapes that have vectors, at most.
PER_CLASS, WORDS, SHAPES, MIN_COUNT = 3000, 20_000, 4000, 5
DIM, NONZERO, WINDOW, HIDDEN = 32, 6, 2, 16
CUT = 0.3
_CACHE, _CHUNK = 300_000, 1 << 16


def shape(word: str) -> str:
    """Runs of letters and digits reduced to their case or kind, other characters as they are, 12 characters at most."""
    out: list[str] = []
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
        if kind not in "aA0x" or not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:12])


class _Ids(dict):
    """Word to row of the vectors: its own, its shape's, or 0 (unknown)."""

    def __init__(self, words: dict[str, int], shapes: dict[str, int]):
        super().__init__()
        self.words, self.shapes = words, shapes

    def __missing__(self, word):
        if len(self) >= _CACHE:
            self.clear()
        self[word] = at = self.words.get(word) or self.shapes.get(shape(word), 0)
        return at


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    shapes: dict[str, int] = field(default_factory=dict)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((1, DIM), np.float32))
    mean: np.ndarray | float = 0.0
    scale: np.ndarray | float = 1.0
    w1: np.ndarray = field(default_factory=lambda: np.zeros((2 * DIM + 1, HIDDEN)))
    b1: np.ndarray = field(default_factory=lambda: np.zeros(HIDDEN))
    w2: np.ndarray = field(default_factory=lambda: np.zeros(HIDDEN))
    b2: float = 0.0
    temperature: float = 1.0

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        n, total, product = len(ids), np.zeros(DIM), np.zeros(DIM)
        for at in range(0, n, _CHUNK):
            v = self.vectors[ids[at : at + _CHUNK + 1]]
            total += v[:_CHUNK].sum(axis=0)
            product += np.einsum("ij,ij->j", v[:-1], v[1:])
        return np.concatenate((total / max(1, n), product / max(1, n - 1) * DIM, [np.log1p(n)]))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _runs(texts: list[np.ndarray], most: int = 1 << 21):
    """The texts in runs of about `most` words, so that what the vectors are summed from stays small."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _word_vectors(texts: list[np.ndarray], size: int) -> np.ndarray:
    rng = np.random.default_rng(3)
    index = np.zeros((size, DIM), np.float32)
    for row in index:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice((-1.0, 1.0), NONZERO)
    sums = np.zeros((size, DIM))
    index[0] = 0  # between documents
    for run in _runs(texts):
        ids = np.concatenate([np.concatenate((t, np.zeros(WINDOW, t.dtype))) for t in run])
        for d in range(DIM):
            own, near = index[:, d][ids], np.zeros(len(ids), np.float32)
            for k in range(1, WINDOW + 1):
                near[k:] += own[:-k]
                near[:-k] += own[k:]
            sums[:, d] += np.bincount(ids, near, size)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = sums / np.where(norm > 0, norm, 1)
    vectors[0] = 0
    return vectors.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of labels.quality; without labels of both classes every score is 0.5."""
    counts, rows = labelled(docs, labels, "quality", per_class)
    if len(counts) < 2:
        return Model()
    texts, y, number = [], [], {}  # texts as numbers of words in order of appearance, four bytes a word
    for _, text, label in rows:
        words = text.split()
        texts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        y.append(label)
    times, shaped = np.zeros(len(number), np.int64), Counter()
    for t in texts:
        np.add.at(times, t, 1)
    seen = Counter(dict(zip(number, times.tolist(), strict=True)))
    words = {w: i for i, (w, n) in enumerate(seen.most_common(WORDS), 1) if n >= MIN_COUNT}
    for w, n in seen.items():
        shaped[shape(w)] += n
    shapes = {s: i for i, (s, _) in enumerate(shaped.most_common(SHAPES), 1 + len(words))}
    ids = _Ids(words, shapes)
    code = np.fromiter(map(ids.__getitem__, number), np.int32, len(number))
    coded = [code[t] for t in texts]  # a word too rare for a vector of its own teaches its shape
    model = Model(words, shapes, _word_vectors(coded, 1 + len(words) + len(shapes)))
    x, y = np.array([model.pooled(c) for c in coded]), np.array(y, float)
    rng = np.random.default_rng(5)
    check = rng.random(len(y)) < 0.2  # for the temperature
    model.mean, model.scale = x[~check].mean(axis=0), x[~check].std(axis=0) + 1e-6
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    _train(model, x[~check], y[~check], weight[~check], rng)
    if check.any():
        z = model.logits(x[check])
        model.temperature = min(np.geomspace(0.3, 5, 60), key=lambda t: float((weight[check] * np.logaddexp(0, -np.where(y[check] == 1, z, -z) / t)).sum()))
    return model


def _train(m: Model, x, y, weight, rng, steps=400, rate=0.02, decay=1e-3) -> None:
    x, weight = (x - m.mean) / m.scale, weight / weight.sum()
    p = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        h = np.tanh(x @ p[0] + p[1])
        e = weight * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -500, 500))) - y)
        back = e[:, None] * p[2] * (1 - h * h)
        grads = [x.T @ back + decay * p[0], back.sum(axis=0), h.T @ e + decay * p[2], np.array([e.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            p[i] = p[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = p[0], p[1], p[2], float(p[3][0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; only the text is an input.

    Null text counts as empty and has a score too; texts of any length are read whole; repeated rows score alike; an empty
    table gives an empty result; extra columns of any name are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        m = held.value
        ids = _Ids(m.words, m.shapes)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                rows.append(m.pooled(np.fromiter(map(ids.__getitem__, words), np.int32, len(words))))
            scores = m.scores(np.array(rows)) if rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    picked = docs.select("doc_id", "text")
    scored = picked.mapInArrow(each, picked.select("doc_id", F.lit(0.0).alias("score")).schema)
    return scored.select("doc_id", crc_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
