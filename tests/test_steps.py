"""As-of look-ups and monotone maps: skew, ties, nulls, and no group above its bound."""

import math
import random

import pytest
from pyspark.sql import functions as F

from oddsmill.operators import asof as A
from oddsmill.operators import calibration as CAL


def latest(build, key, at):
    past = [(t, v) for k, t, v in build if k is not None and k == key and t is not None and at is not None and t < at]
    return max(past)[1] if past else None


@pytest.mark.parametrize("instants", [5_000, 3, 1])
def test_one_key_with_nine_tenths_of_the_rows(spark, instants):
    """Also when all of them fall on three instants or one: ranges stay even, and answers are those of a plain scan."""
    rng = random.Random(instants)
    key = lambda: "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
    build = [(key(), rng.randrange(instants), i) for i in range(3_000)] + [("a", None, 9)]
    probe = [(i, key(), rng.choice([None, *range(instants + 1)]) if i % 50 == 0 else rng.randrange(instants + 1)) for i in range(3_000)]
    b, p = spark.createDataFrame(build, "k string, t int, v int"), spark.createDataFrame(probe, "id int, k string, at int")
    got = {r.id: r.v for r in A.asof_latest(p, b, ["k"], "at", "t", ["v"], inclusive=False, kind="int").collect()}
    best = {}
    for k, at in {(k, at) for _, k, at in probe}:
        best[k, at] = latest(build, k, at)
    assert got == {i: best[k, at] for i, k, at in probe}
    both = b.select("k", F.col("t").alias("at")).unionByName(p.select("k", "at")).withColumn("n", F.monotonically_increasing_id())
    sizes = [r["count"] for r in A.ranged(both, ["k", "at", "n"]).groupBy("_range").count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_look_ups_in_empty_tables(spark):
    b, p = spark.createDataFrame([], "k string, t int, v int"), spark.createDataFrame([(1, "a", 2)], "id int, k string, at int")
    assert [r.v for r in A.asof_latest(p, b, ["k"], "at", "t", ["v"], inclusive=True, kind="int").collect()] == [None]
    assert A.asof_latest(p.limit(0), b, ["k"], "at", "t", ["v"], inclusive=True, kind="int").count() == 0


def test_pooling_in_pieces_is_pooling_at_once(spark):
    """Falling values pool into one block across many windows, rising ones not at all, and no window exceeds its size."""
    rng, seen = random.Random(1), []
    pool = CAL._pool
    for values in ([1 - i / 200 for i in range(200)], [i / 200 for i in range(200)], [rng.random() for _ in range(200)]):
        cells = spark.createDataFrame([("s", 1.0, v, float(i), float(i)) for i, v in enumerate(values)], "scope string, w double, s double, lo double, hi double")
        got = CAL.pooled_blocks(cells, window=7).orderBy("lo").collect()
        want = pool(cells.toPandas())
        assert [(r.w, r.lo, r.hi) for r in got] == list(want[["w", "lo", "hi"]].itertuples(index=False, name=None))
        assert all(math.isclose(r.s, s, abs_tol=1e-9) for r, s in zip(got, want.s))
        seen.append(len(got))
    assert seen[0] == 1 and seen[1] == 200


def test_maps_are_flat_in_blocks_and_linear_between(spark):
    blocks = spark.createDataFrame([("s", 0.2, 0.3, 0.1, 0.4, 0.5), ("s", 0.4, 0.4, 0.5, 0.8, 0.9), ("s", 0.8, 0.8, 0.9, None, None)], "scope string, lo double, hi double, value double, next_lo double, next_value double")
    xs = [0.0, 0.2, 0.3, 0.35, 0.4, 0.6, 0.8, 1.0, None]
    probes = spark.createDataFrame([(i, "s", x) for i, x in enumerate(xs)] + [(99, "other", 0.5)], "id int, scope string, x double")
    got = {r.id: r.y for r in CAL.isotonic_at(probes, blocks, "x", "y").collect()}
    want = [0.1, 0.1, 0.1, 0.3, 0.5, 0.7, 0.9, 0.9]
    assert [got[i] for i in range(8)] == pytest.approx(want) and got[8] is None and got[99] is None


def test_platt_has_no_gradient_left(spark):
    rng = random.Random(3)
    data = [(p := rng.uniform(0.05, 0.95), int(rng.random() < p**1.5)) for _ in range(800)]
    df = spark.createDataFrame(data, "p double, y int")
    a, b = CAL.fit_platt(df, "p", "y")
    z = [math.log(p / (1 - p)) for p, _ in data]
    off = [y - 1 / (1 + math.exp(-(a * v + b))) for v, (_, y) in zip(z, data)]
    assert abs(sum(off)) < 1e-6 and abs(sum(o * v for o, v in zip(off, z))) < 1e-6
    assert CAL.fit_platt(df.limit(0), "p", "y") == (1.0, 0.0)
    assert all(map(math.isfinite, CAL.fit_platt(df.withColumn("y", F.lit(1)), "p", "y")))
