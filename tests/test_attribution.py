"""Attributions against their definition: averages over all orders, and sums that make up the margin."""

import itertools
import math
import random

import numpy as np
import pytest

from oddsmill.operators import attribution as AT

NAMES = [f"x{i}" for i in range(5)]


def expected(nodes, x, known, at=0):
    """A tree's mean output when only the features in ``known`` are known."""
    n = nodes[at]
    if n["left"] < 0:
        return n["value"]
    if n["feature"] in known:
        return expected(nodes, x, known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
    return sum(nodes[c]["rows"] / n["rows"] * expected(nodes, x, known, c) for c in (n["left"], n["right"]))


def by_definition(nodes, x):
    out = []
    for i in range(len(x)):
        others = [j for j in range(len(x)) if j != i]
        total = 0.0
        for size in range(len(x)):
            weight = math.factorial(size) * math.factorial(len(x) - size - 1) / math.factorial(len(x))
            total += weight * sum(expected(nodes, x, {*s, i}) - expected(nodes, x, set(s)) for s in itertools.combinations(others, size))
        out.append(total)
    return out


def random_tree(rng, depth):
    """Also with features that are split on more than once along a path."""
    nodes = {}

    def grow(left_depth, rows):
        at = len(nodes)
        nodes[at] = None
        if left_depth == 0 or rng.random() < 0.15:
            nodes[at] = {"left": -1, "right": -1, "feature": -1, "threshold": None, "rows": rows, "value": rng.gauss(0, 1)}
            return at
        share = rng.uniform(0.1, 0.9)
        left, right = grow(left_depth - 1, rows * share), grow(left_depth - 1, rows * (1 - share))
        nodes[at] = {"left": left, "right": right, "feature": rng.randrange(5), "threshold": rng.choice([0.2, 0.5, 0.8]), "rows": rows, "value": 0.0}
        return at

    grow(depth, 1000.0)
    return nodes


@pytest.mark.parametrize("seed", range(6))
def test_trees_match_the_definition(seed):
    rng = random.Random(seed)
    nodes = random_tree(rng, 2 + seed)
    x = np.array([[rng.choice([0.1, 0.2, 0.4, 0.5, 0.7, 0.9]) for _ in range(5)] for _ in range(8)])
    leaves = AT.leaves_of(nodes, 1.0)
    got = AT.attributions(x, leaves)
    for row, own in zip(x, got):
        assert own == pytest.approx(by_definition(nodes, row), abs=1e-9)
        assert AT.base(leaves) + own.sum() == pytest.approx(expected(nodes, row, set(range(5))))


def test_a_fitted_ensemble_adds_up_to_its_margin(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(2)
    rows = [[rng.random() for _ in range(5)] for _ in range(500)]
    data = spark.createDataFrame([(*r, float(r[0] + r[1] * r[2] > 0.8)) for r in rows], [*NAMES, "label"])
    framed = VectorAssembler(inputCols=NAMES, outputCol="features").transform(data)
    model = GBTClassifier(maxIter=7, maxDepth=4, stepSize=0.3, seed=1).fit(framed)
    margins = [r.rawPrediction[1] for r in model.transform(framed).collect()]
    leaves = AT.ensemble_leaves(spark, model)
    own = AT.attributions(np.array(rows), leaves)
    assert AT.base(leaves) + own.sum(axis=1) == pytest.approx(margins)
    got = {r.feature: r.importance for r in AT.mean_attributions(data, NAMES, leaves).collect()}
    assert [got[n] for n in NAMES] == pytest.approx(np.abs(own).mean(axis=0))
    assert min(got["x0"], got["x1"], got["x2"]) > max(got["x3"], got["x4"])
