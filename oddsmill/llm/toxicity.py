"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .chunks import slices
from .labelled import labelled_texts, sample_labels
from .workers import frugal

#: Lengths of the n-grams in bytes of lower-cased text in which every run of other signs reads as spaces.
SIZES = (4, 5, 6)
#: Buckets that n-grams are hashed to.
BUCKETS = 1 << 18
#: Features: the buckets whose document share differs most between the classes, by standard errors, and this many at least.
FEATURES, LEAST_Z = 4_096, 4.0
#: Added to each count in the ratios.
SMOOTHING = 1.0
RIDGE, STEPS, RATE = 1e-4, 300, 0.05
#: Bytes of text that are counted or scored at a time; arrays of n-grams are some dozens of times as large.
SCORED_BYTES = 500_000
#: Documents with at least this score are predicted toxic.
THRESHOLD = 0.3

GAP = max(SIZES)
LETTER = np.array([c if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256)], np.uint8)


def buckets_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of all texts, and the row that each belongs to. Texts are padded with spaces, so no n-gram
    has letters of two of them."""
    raw = [t.encode() for t in texts]
    joined = LETTER[np.frombuffer((b" " * GAP).join([b"", *raw, b""]), np.uint8)]
    ends = np.cumsum([len(r) + GAP for r in raw])
    row = np.repeat(np.arange(len(raw) + 1), np.diff(np.concatenate(([0], ends, [len(joined)])))).astype(np.int32)
    wide, found = joined.astype(np.uint32), []
    plain = np.zeros(len(joined), np.uint32)
    with np.errstate(over="ignore"):
        done = 0
        for size in SIZES:
            for k in range(done, size):
                plain[: len(joined) - k] = plain[: len(joined) - k] * np.uint32(0x01000193) + wide[k:]
            done = size
            h = (plain ^ np.uint32(size)) * np.uint32(0x9E3779B1)
            found.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(found), np.tile(row, len(SIZES))


@dataclass
class Model:
    slot: np.ndarray  # by bucket: number of its feature, or -1
    weight: np.ndarray  # by feature, the ratio multiplied in
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        rows, slots = present(texts, self.slot)
        total = np.bincount(rows, self.weight[slots], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def present(texts: list[str], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, feature) pairs of the texts."""
    bucket, row = buckets_of(texts)
    slots = slot[bucket]
    keep = (slots >= 0) & (row < len(texts))
    pairs = np.unique(row[keep].astype(np.int64) << 32 | slots[keep])
    return pairs >> 32, pairs & 0xFFFFFFFF


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a bucket, added up over the task; class totals under bucket -1."""
    seen, total = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for b in slices(batch, 0, SCORED_BYTES):
            y = np.array(b.column(1).to_pylist())
            bucket, row = buckets_of([t or "" for t in b.column(0).to_pylist()])
            bucket, row = bucket.reshape(len(SIZES), -1), row[: len(row) // len(SIZES)]
            edges = np.searchsorted(row, np.arange(len(y) + 1))
            for k, low, high in zip(y, edges[:-1], edges[1:]):
                flag = np.zeros(BUCKETS, bool)
                flag[bucket[:, low:high]] = True
                seen[k] += flag
                total[k] += 1
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[0][at], total[0])), pa.array(np.append(seen[1][at], total[1]))], ["bucket", "n0", "n1"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on the sampled labelled documents of ``docs(doc_id, text)``.

    Counts of buckets are combined by Spark; the driver gets the chosen features (``FEATURES`` at most) and, of the
    sampled rows, the numbers of their features. Repeated rows count each; empty tables count as without labels. Labels other than 0 count as 1. Without rows of both classes every score is
    the share of label 1 among the labelled rows (0 without any)."""
    train = labelled_texts(docs, sample_labels(labels, label)).withColumn("y", (F.col("y") != 0).cast("int"))
    counts = train.select("text", "y").mapInArrow(frugal(_count), "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.persist()
    total = counts.where("bucket = -1").first()
    n0, n1 = (total.n0, total.n1) if total else (0, 0)
    slot = np.full(BUCKETS, -1, np.int32)
    if not n0 or not n1:
        counts.unpersist()
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model(slot, np.zeros(1), 30.0 * (2 * share - 1) if share in (0, 1) else float(np.log(share / (1 - share))))
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    chosen = counts.where("bucket >= 0").withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(FEATURES).collect()
    counts.unpersist()
    slot[[c.bucket for c in chosen]] = np.arange(len(chosen))
    ratio = np.array([np.log((c.n1 + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((c.n0 + SMOOTHING) / (n0 + 2 * SMOOTHING)) for c in chosen])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 0, SCORED_BYTES):
                row, found = present([t or "" for t in b.column(0).to_pylist()], slot)
                parts = np.split(found, np.searchsorted(row, np.arange(1, b.num_rows)))
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([p.astype("<u2").tobytes() for p in parts], pa.binary())], ["y", "features"])

    sample = train.select("text", "y").mapInArrow(frugal(rows), "y int, features binary").collect()
    y = np.array([r.y for r in sample], float)
    features = [np.frombuffer(r.features, "<u2") for r in sample]
    weight, bias = logistic(features, y, ratio)
    return Model(slot, weight * ratio, bias)


def logistic(features: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the bias, by Adam on the whole sample."""
    at = np.concatenate([*features, np.zeros(0, "<u2")]).astype(np.int64)
    row = np.repeat(np.arange(len(y)), [len(f) for f in features])
    x = ratio[at]
    theta = np.zeros(len(ratio) + 1)
    theta[-1] = np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, theta[at] * x, minlength=len(y)) + theta[-1], -30, 30)))
        off = (p - y) / len(y)
        grad = np.append(np.bincount(at, off[row] * x, minlength=len(ratio)) + RIDGE * theta[:-1], off.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def score_rows(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxic_score") -> DataFrame:
    """``docs``, all columns, with the score of each text (null: empty) in ``name``; no shuffle, and each text crosses to Python once.

    Repeated rows are scored each; an empty table gives an empty one."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, at, SCORED_BYTES):
                scores = pa.array(model.score([t or "" for t in b.column(at).to_pylist()]), pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, name])

    return docs.mapInArrow(frugal(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def kept_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns and no other, without the rows whose text scores ``threshold`` or more."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, at, SCORED_BYTES):
                yield b.filter(pa.array(model.score([t or "" for t in b.column(at).to_pylist()]) < threshold))

    return docs.mapInArrow(frugal(run), docs.schema)
