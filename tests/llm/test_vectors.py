import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oddsmill.llm import hard_negatives, max_score, vectors

SHAPE = "vec_id bigint, embedding array<float>, label int, score double, id int, vector string, shards string, rank string, positives string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2, "v", "s", "r", "p") for r in rows], SHAPE)


def odd_rows(seed=3, n=900, width=11):
    """Few different values, so that scores tie; repeated rows and ids, null and non-finite components, short and empty vectors."""
    rng = random.Random(seed)
    value = lambda: rng.choice([-0.5, -0.25, 0.0, 0.1, 0.3, 0.7])
    rows = [(i, [value() for _ in range(width)], rng.randrange(4)) for i in range(n)]
    rows[5] = (5, None, 1)
    rows[6] = (6, [None] + [0.1] * (width - 1), 1)
    rows[8] = (8, [math.nan] * width, 1)
    rows[9] = (9, [math.inf] + [0.0] * (width - 1), 2)
    rows[10] = (10, [0.5] * 3, 2)
    rows[11] = (11, [], 3)
    rows[12] = (12, [0.7] * (width + 4), 0)
    rows[13] = (13, [0.7] * width, None)
    rows += [(None, [0.7] * width, 1), rows[200], rows[200], rows[17], (300, [0.3] * width, 2), (-100, [0.1] * width, 0)]
    return rows + [(1000 + i, [0.7, -0.5] * 5 + [0.7], 3) for i in range(300)]  # one hot vector


def whole(rows, scale):
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], [math.floor(scale * float(np.float32(x))) for x in r[1]], r[2]) for r in fine]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def order(r):
    return -r[1], r[0] is None, r[0] or 0


def brute_top(rows, k=10):
    rows, out = whole(rows, 1024), []
    asked = {}
    for i, v, _ in rows:
        if i is not None and i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, v in asked.items():
        found = sorted(((i, product(v, w)) for i, w, _ in rows if i != q), key=order)[:k]
        out += [(q, n, i, s) for n, (i, s) in enumerate(found, 1)]
    return sorted(out, key=str)


def brute_negatives(rows):
    rows, out, asked = [(i, v, (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in whole(rows, 256) if y is not None], [], {}
    for i, v, y in rows:
        if i is not None and i % 100 == 0:
            asked[i] = min(asked.get(i, (y, v)), (y, v))
    for a, (y, v) in asked.items():
        scored = sorted(((i, product(v, w), z) for i, w, z in rows if i != a), key=order)
        for p, s, _ in [r for r in scored if r[2] == y][:5]:
            inside = [r for r in scored if r[2] != y and 30 * s <= 100 * r[1] <= 90 * s]
            out += [(a, p, n, i, s, t) for n, (i, t, _) in enumerate(inside[:10], 1)]
    return sorted(out, key=str)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 100 == 0, label).collect()), key=str)


@pytest.mark.parametrize("most,least", [(32_768, 256), (50, 1)])
def test_odd_vectors_match_brute_force(spark, monkeypatch, most, least):
    monkeypatch.setattr(vectors, "SHARD_ROWS", most)
    monkeypatch.setattr(vectors, "LEAST_ROWS", least)
    rows = odd_rows()
    df = table(spark, rows)
    assert sorted(map(tuple, max_score.top_k(df, F.col("id") % 100 == 0).collect()), key=str) == brute_top(rows)
    assert mined(df) == brute_negatives(rows)


def test_few_rows_and_none(spark):
    few = [(0, [0.5, 0.1], 1), (1, [0.4, 0.2], 1), (2, [0.3, -0.2], 2)]
    assert sorted(map(tuple, max_score.top_k(table(spark, few), F.col("id") % 100 == 0).collect()), key=str) == brute_top(few)
    assert mined(table(spark, few)) == brute_negatives(few)
    for rows in ([], [(1, [1.0], 1)], [(0, None, 1)]):
        df = table(spark, rows)
        assert max_score.top_k(df, F.col("id") % 100 == 0).count() == 0
        assert mined(df) == []


def test_a_threshold_makes_terms_non_essential_and_loses_nothing():
    rng = np.random.default_rng(2)
    rows = rng.integers(-300, 300, (2_000, 12)) * (rng.random((2_000, 12)) < 0.4)
    shard = max_score.Shard(pa.array(np.arange(2_000)), rows)
    for q in rng.integers(-300, 300, (40, 12)):
        q[rng.random(12) < 0.3] = 0
        total = rows @ q
        want = np.lexsort((np.arange(2_000), -total))[:10]
        for threshold in (None, int(total[want[-1]]), int(total[want[-1]]) - 5_000, -1):
            got, scores = shard.search(None, q, threshold, 10)
            assert got.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
        assert len(shard.search(None, q, int(total.max()) + 1, 10)[0]) == 0


@pytest.mark.parametrize("width", [1, 8, 13])
@pytest.mark.parametrize("largest", [1, 200, 1 << 20])
def test_lookups_add_up_to_inner_products(width, largest):
    rng = np.random.default_rng(width)
    rows, anchors = rng.integers(-largest, largest + 1, (300, width)), rng.integers(-largest, largest + 1, (7, width))
    rows[0], rows[1] = -largest, largest
    got = hard_negatives.scores(hard_negatives.subset_sums(anchors), hard_negatives.bit_planes(rows))
    assert (got == rows @ anchors.T).all()


def test_subset_sums_are_those_of_every_byte():
    anchor = np.array([[3, -5, 7, 11, -13, 17, 19, 23, 29]])
    table = hard_negatives.subset_sums(anchor)
    for byte in range(256):
        assert table[0, byte, 0] == sum(int(anchor[0, k]) for k in range(8) if byte >> (7 - k) & 1)
        assert table[1, byte, 0] == (29 if byte >> 7 else 0)


def test_the_hot_vector_is_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST_ROWS", 100)
    df = spark.range(4_000).select(F.lit(7).cast("bigint").alias("id"))
    per = [r["count"] for r in df.select(vectors.shard_of_row(8).alias("s")).groupBy("s").count().collect()]
    assert len(per) == 8 and max(per) < 2 * 4_000 / 8
