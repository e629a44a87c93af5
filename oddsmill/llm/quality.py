"""Quality: Bradley-Terry pairwise ranking of documents, cut at a quantile of the learned scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import slices
from .labelled import labelled_texts, sample_labels

#: Documents with at least this score are predicted good. The quantile is laid here.
THRESHOLD = 0.7
#: Preference pairs: for every document of the sample, this many partners from the other class.
PARTNERS = 8
RIDGE, STEPS, RATE = 1e-4, 400, 0.05

MARKS = b"|#*$%&@=<>^~_+\\{}[]/"
CLASS = np.zeros(256, np.int64)
for _i, _signs in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:'\"()-", b"!?", MARKS], 1):
    CLASS[list(_signs)] = _i
NAMES = ["upper", "lower", "digit", "blank", "newline", "plain_mark", "loud_mark", "odd_mark", "other", "log_words", "word_length", "distinct_words", "top_word", "repeats", "shouted", "marked_words", "short_lines", "repeated_lines", "sentence_ends", "log_longest_word"]


def describe(text: str) -> list[float]:
    """Shares and sizes that do not depend on the language. An empty text is all zeros."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    kinds = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / len(raw)
    n, counts = len(words), Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ended = sum(w[-1:] in (b".", b"!", b"?") for w in words)
    return [
        *kinds[1:], kinds[0], np.log1p(n), len(raw) / n / 10, len(counts) / n, counts.most_common(1)[0][1] / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(w.isupper() for w in words) / n, sum(not w[-1:].isalnum() and w[-1:] < b"\x80" for w in words) / n,
        sum(len(x) < 30 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines), ended / n, np.log1p(max(map(len, counts))),
    ]


def basis(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features bounded to five deviations, and how far each is from the middle: a linear score can then prefer a range."""
    x = np.clip((rows - mean) / scale, -5, 5)
    return np.hstack([x, np.abs(x), x > 2, x < -2]).astype(float)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float  # the strength at the quantile
    spread: float

    def score(self, texts: list[str]) -> np.ndarray:
        rows = np.array([describe(t) for t in texts]).reshape(-1, len(NAMES))
        return to_score(basis(rows, self.mean, self.scale) @ self.weight, self.cut, self.spread)


def to_score(strength: np.ndarray, cut: float, spread: float) -> np.ndarray:
    """Rising with the strength, between 0 and 1, and ``THRESHOLD`` at the cut."""
    return 1 / (1 + np.exp(-np.clip((strength - cut) / spread + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def fit_pairs(better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Weights that minimise the logistic loss of feature differences, P(a over b) = sigmoid(w (a - b)), by Adam."""
    diff = better - worse
    w, m, v = np.zeros(diff.shape[1]), np.zeros(diff.shape[1]), np.zeros(diff.shape[1])
    for step in range(1, STEPS + 1):
        part = diff[(step * 4096) % len(diff) :][:4096] if len(diff) > 8192 else diff
        lost = 1 / (1 + np.exp(np.clip(part @ w, -30, 30)))
        grad = RIDGE * w - part.T @ lost / len(part)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def learn(rows: np.ndarray, y: np.ndarray) -> Model:
    """From the described sample. Every document meets ``PARTNERS`` of the other class, chosen by a fixed seed; strengths
    are cut at the quantile that leaves above it as many as there are good ones. Without both classes every
    strength is 0 and every score ``THRESHOLD`` if the known label is good or none is known, else below it."""
    mean, scale = (rows.mean(axis=0), rows.std(axis=0) + 1e-6) if len(rows) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = 4 * len(NAMES)
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(width), -1e-9 if len(good) or not len(y) else 1.0, 1.0)
    x = basis(rows, mean, scale)
    rng = np.random.default_rng(7)
    a = np.concatenate([np.repeat(good, PARTNERS), rng.choice(good, len(bad) * PARTNERS)])
    b = np.concatenate([rng.choice(bad, len(good) * PARTNERS), np.repeat(bad, PARTNERS)])
    order = rng.permutation(len(a))
    weight = fit_pairs(x[a[order]], x[b[order]])
    strength = np.sort(x @ weight)
    at = len(bad)  # the first of those above: halfway to the one below it
    cut = (strength[at - 1] + strength[at]) / 2
    spread = max(float(strength.std()), 1e-6)
    return Model(mean, scale, weight, float(cut), spread)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on the sampled labelled documents of ``docs(doc_id, text)``; the driver gets their few numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([describe(t or "") for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    train = labelled_texts(docs, sample_labels(labels, label)).select("text", (F.col("y") != 0).cast("int").alias("y"))
    sample = train.mapInArrow(run, "y int, x array<double>").collect()
    return learn(np.array([r.x for r in sample], float).reshape(-1, len(NAMES)), np.array([r.y for r in sample], int))


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key, score`` of each row of ``docs(key, text)`` (null: empty); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score([t or "" for t in b.column(1).to_pylist()]), pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
