"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and word beginnings that labelled toxic texts hold far more often than others. Grades 1 to 3 of a
toxic training text follow from how many such features it holds, by thirds; grade 0 is not toxic. The thresholds share
one weight vector, P(grade >= k) = sigmoid(w x - theta_k), and the output is the expected grade.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHOLE_ROWS, crc_held_out, materialize
from .training import labelled

#: Labelled rows of each class that are learned from, at most; features kept, at most.
PER_CLASS, FEATURES = 3000, 1000
GRADES, CUT = 3, 0.5
#: A feature is kept if toxic texts hold it this many times as often as others.
RATIO = 8.0
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in BEGINNINGS if len(word) > k)]


class _Hits(dict):
    """Word to the numbers of its kept features; most words have none."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word):
        if len(self) >= _CACHE:
            self.clear()
        self[word] = found = tuple(i for f in features(word) if (i := self.known.get(f)) is not None)
        return found


@dataclass
class Model:
    known: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, 10.0))

    def at_least(self, text: str | None, hits: _Hits) -> np.ndarray:
        """P(grade >= k) for k from 1 to GRADES."""
        found = Counter(chain.from_iterable(f for w in _WORD.findall((text or "").lower()) if (f := hits[w])))
        z = sum(self.weights[i] * np.log1p(n) for i, n in found.items())
        return 1 / (1 + np.exp(self.thresholds - z))

    def hits(self) -> _Hits:
        return _Hits(self.known)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of labels.toxic; without labels of both classes nothing counts as toxic."""
    counts, rows = labelled(docs, labels, "toxic", per_class)
    if len(counts) < 2:
        return Model()
    bags, y, held, seen, number = [], [], (Counter(), Counter()), set(), {}  # a text is held as its words' numbers and counts
    for _, text, label in rows:
        words = Counter(_WORD.findall(text.lower()))
        if (mark := hash(frozenset(words.items()))) in seen:
            continue  # a copy teaches nothing new
        seen.add(mark)
        bags.append((np.array([number.setdefault(w, len(number)) for w in words], np.int32), np.array(list(words.values()), np.int32)))
        y.append(label)
        held[label].update({f for w in words for f in features(w)})
    n1, n0 = max(1, sum(y)), max(1, len(y) - sum(y))
    least = max(3, 0.003 * n1)
    rate = lambda f: (held[1][f] / n1, held[0][f] / n0)
    apart = {f: (a - b) ** 2 / (a + b) for f, n in held[1].items() if n >= least for a, b in [rate(f)] if a >= RATIO * b}
    known = {f: i for i, f in enumerate(sorted(apart, key=lambda f: (-apart[f], f))[:FEATURES])}
    found, x = [tuple(i for f in features(w) if (i := known.get(f)) is not None) for w in number], np.zeros((len(bags), len(known)))
    for row, (words, times) in enumerate(bags):
        for w, n in zip(words.tolist(), times.tolist(), strict=True):
            for i in found[w]:
                x[row, i] += n
    y, total = np.array(y), x.sum(axis=1)
    cuts = np.quantile(total[y == 1], [1 / 3, 2 / 3]) if (y == 1).any() else [0, 0]
    grade = np.where(y == 1, 1 + (total > cuts[0]) + (total > cuts[1]), 0)
    weight = np.where(y == 1, counts[1] / n1, counts[0] / n0)
    weights, thresholds = _ordinal(np.log1p(x), grade, weight / weight.sum())
    return Model(known, weights, thresholds)


def _ordinal(x, grade, weight, steps=400, rate=0.1, decay=2e-5):
    """Shared weights and ordered thresholds by Adam; gaps between thresholds stay positive as exponentials."""
    w, t = np.zeros(x.shape[1]), np.array([1.0, 0.0, 0.0])[:GRADES]
    first, second = np.zeros(len(w) + GRADES), np.zeros(len(w) + GRADES)
    over = grade[:, None] >= np.arange(1, GRADES + 1)
    for step in range(1, steps + 1):
        theta = np.concatenate(([t[0]], t[0] + np.cumsum(np.exp(t[1:]))))
        p = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - theta, -500, 500)))
        full = np.hstack((np.ones((len(x), 1)), p, np.zeros((len(x), 1))))
        rows = np.arange(len(x))
        mass = np.maximum(full[rows, grade] - full[rows, grade + 1], 1e-12)
        slope = full * (1 - full)
        dz = -weight * (slope[rows, grade] - slope[rows, grade + 1]) / mass
        dtheta = np.zeros(GRADES)
        for k in range(1, GRADES + 1):
            dtheta[k - 1] = (weight / mass * slope[:, k] * ((grade == k).astype(float) - (grade == k - 1))).sum()
        dt = np.array([dtheta.sum(), *(np.exp(t[j]) * dtheta[j:].sum() for j in range(1, GRADES))])
        g = np.concatenate((x.T @ dz + decay * w, dt))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[: len(w)], t - move[len(w) :]
    del over
    return w, np.concatenate(([t[0]], t[0] + np.cumsum(np.exp(t[1:]))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, severity (expected grade, 0 to 3), p_toxic, grade (likeliest) and toxic of every row.

    Null text counts as empty and isn't toxic; texts of any length are read whole; of equally likely grades the lower is
    given; repeated rows score alike; an empty table gives an empty result; extra columns of any name are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        m = held.value
        hits = m.hits()
        for batch in batches:
            p = np.array([m.at_least(t, hits) for t in batch.column(1).to_pylist()]).reshape(-1, GRADES)
            steps = np.hstack((np.ones((len(p), 1)), p)) - np.hstack((p, np.zeros((len(p), 1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(steps.argmax(axis=1), pa.int32())], ["doc_id", "severity", "p_toxic", "grade"])

    picked = docs.select("doc_id", "text")
    schema = picked.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("grade")).schema
    scored = picked.mapInArrow(each, schema)
    return scored.select("doc_id", crc_held_out(F.col("doc_id")).alias("held_out"), "severity", "p_toxic", "grade", (F.col("p_toxic") >= CUT).alias("toxic"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model holds toxic; all columns, whatever their names, stay as they are.

    Null and empty texts aren't toxic and stay, null ids too; texts of any length are read whole; repeated rows fare alike;
    an empty table gives an empty result.
    """
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def each(batches):
        m = held.value
        hits = m.hits()
        for batch in batches:
            yield batch.filter(pa.array([m.at_least(t, hits)[0] < CUT for t in batch.column(at).to_pylist()], pa.bool_()))

    return materialize(docs.mapInArrow(each, docs.schema), "kept", WHOLE_ROWS)  # whole rows go to Python and back
