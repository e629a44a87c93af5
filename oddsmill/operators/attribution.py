"""Exact attributions of boosted trees: how much each feature moved each row's margin.

A tree's output is a sum over leaves, and what a leaf gives is a product over the features on its path: for features that are
known, whether the row passes the feature's splits; for the others, the share of training rows that passed them. The average of a
feature's effect over all orders in which features can become known is, for such a product, an integral of a
polynomial in one variable, and few Gauss-Legendre points give it exactly. It depends on the row only by which of the
leaf's features pass, so each leaf gets a table over these patterns, and rows look them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.sources.files import scratch_path


@dataclass
class Leaf:
    features: list[int]
    low: np.ndarray    # a row passes feature i when low[i] < x <= high[i]
    high: np.ndarray
    table: np.ndarray  # by pattern of passed features and feature: its share of the leaf's value
    mean: float        # what the leaf gives when nothing is known


def pattern_table(value: float, cover: np.ndarray) -> np.ndarray:
    """``table[pattern, i]``: the share of feature i. ``cover[i]`` is the share of training rows that pass feature i."""
    d = len(cover)
    passed = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
    points, weights = np.polynomial.legendre.leggauss((d + 1) // 2 or 1)   # exact up to degree d
    out = np.zeros((1 << d, d))
    for t, w in zip((points + 1) / 2, weights / 2):
        known = cover + (passed - cover) * t
        for i in range(d):
            out[:, i] += w * value * (passed[:, i] - cover[i]) * np.delete(known, i, axis=1).prod(axis=1)
    return out


def leaves_of(nodes: dict[int, dict], weight: float) -> list[Leaf]:
    """Leaves of one tree; a node has ``left, right, feature, threshold, rows, value`` (``left`` below 0 at a leaf)."""
    out, todo = [], [(0, {})]
    while todo:
        at, path = todo.pop()
        n = nodes[at]
        if n["left"] < 0:
            features = sorted(path)
            low, high, cover = (np.array([path[f][k] for f in features], float) for k in range(3))
            value = weight * n["value"]
            out.append(Leaf(features, low, high, pattern_table(value, cover), value * float(cover.prod())))
            continue
        f, edge = n["feature"], n["threshold"]
        low, high, cover = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((n["left"], (low, min(high, edge))), (n["right"], (max(low, edge), high))):
            todo.append((child, path | {f: (*bounds, cover * nodes[child]["rows"] / n["rows"])}))
    return out


def ensemble_leaves(spark, model) -> list[Leaf]:
    """All leaves of a fitted tree ensemble, from its stored nodes (trees times leaves of a tree, whatever the training rows)."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        if r.leftChild >= 0 and r.split.numCategories != -1:
            raise ValueError("attributions are for ordered features")
        trees.setdefault(r.treeID, {})[r.id] = {
            "left": r.leftChild, "right": r.rightChild, "feature": r.split.featureIndex, "rows": float(r.rawCount), "value": r.prediction,
            "threshold": r.split.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else None}
    return [leaf for k, w in enumerate(model.treeWeights) for leaf in leaves_of(trees[k], w)]


def attributions(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """By row and feature. With the mean over training rows (``base``) a row's attributions add up to its margin."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        if leaf.features:
            own = x[:, leaf.features]
            code = ((own > leaf.low) & (own <= leaf.high)) @ (1 << np.arange(len(leaf.features)))
            out[:, leaf.features] += leaf.table[code]
    return out


def base(leaves: list[Leaf]) -> float:
    return sum(leaf.mean for leaf in leaves)


def mean_attributions(rows: DataFrame, names: list[str], leaves: list[Leaf]) -> DataFrame:
    """``feature, importance``: the mean absolute attribution over all ``rows``; tasks send one sum per feature."""
    holder = rows.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(names)), 0
        for b in batches:
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            total, n = total + np.abs(attributions(x, holder.value)).sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array([n] * len(names), pa.int64())], ["feature", "total", "n"])

    sums = rows.select(names).mapInArrow(run, "feature string, total double, n bigint").groupBy("feature").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    return sums.select("feature", F.when(F.col("n") > 0, F.col("t") / F.col("n")).otherwise(0.0).alias("importance"))
