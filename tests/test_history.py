"""Counts over a line and streaks against plain Python; work near linear in days."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmill.operators import history as H


def questions(rng, days, n=300):
    start = rng.integers(0, days + 1, n)
    return start, start + (rng.random(n) * (days - start + 1)).astype(int)


def test_counts_and_runs_match_plain_python():
    rng = np.random.default_rng(3)
    for days in (0, 1, 2, 255, 256, 700):
        values = rng.integers(0, 9, days).astype(float)
        start, upto = questions(rng, days)
        lines = rng.integers(-1, 10, 300).astype(float)
        assert H.count_above(values, start, upto, lines).tolist() == [int((values[s:u] > x).sum()) for s, u, x in zip(start, upto, lines)]
        for above in (True, False):
            want = []
            for s, u, x in zip(start, upto, lines):
                n = 0
                while u - n > s and (values[u - n - 1] > x) == above:
                    n += 1
                want.append(n)
            assert H.run_length(values, start, upto, lines, above).tolist() == want


def test_long_histories_stay_near_linear():
    """Four times the days take less than nine times as long; quadratic work would take sixteen times."""
    rng = np.random.default_rng(4)

    def took(days):
        values, start, upto, lines = rng.normal(size=days), np.zeros(days, int), np.arange(days), rng.normal(size=days)
        steady = np.ones(days)   # one endless run
        return min(_timed(lambda: (H.count_above(values, start, upto, lines), H.run_length(steady, start, upto, lines * 0, True))) for _ in range(5))

    assert took(160_000) < 9 * took(40_000)


@pytest.mark.parametrize("scanned,most", [(1 << 16, 200_000), (5, 3)])
def test_many_keys_in_small_scans_and_parts(spark, monkeypatch, scanned, most):
    """Also where every scan cuts through a key, and questions of a key are dealt out; null keys match nothing."""
    monkeypatch.setattr(H, "SCANNED", scanned)
    monkeypatch.setattr(H, "QUESTIONS", most)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4" if scanned == 5 else "10000")
    rnd = random.Random(6)
    at = lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d)
    log = [(k, "m", at(d), rnd.choice([None, *map(float, range(6))])) for k in (1, 2, 3, 4, None) for d in range(30) if rnd.random() < 0.8]
    lines = [(rnd.choice([1, 1, 1, 2, 3, 9, None]), "m", at(rnd.randrange(32)), float(rnd.randrange(-1, 7))) for _ in range(200)]
    try:
        got = {tuple(r)[:4]: r.wins for r in H.line_wins(spark.createDataFrame(log, "player_id long, stat_type string, game_date date, value double"), spark.createDataFrame(lines, "player_id long, stat_type string, slate date, line_score double")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k, m, d, x): sum(v is not None and v > x for kk, _, g, v in log if k is not None and kk == k and g < d) for k, m, d, x in lines}


def _timed(f):
    start = time.perf_counter()
    f()
    return time.perf_counter() - start


def test_wins_and_streaks(spark):
    log = spark.createDataFrame([(1, "a", f"2024-01-{d:02d}", float(v)) for d, v in enumerate([3, 5, 9, 9, 1, 8, 8], 1)], "player_id long, stat_type string, game_date string, value double").withColumn("game_date", F.to_date("game_date"))
    lines = spark.createDataFrame([(1, "a", "2024-01-05", 4.0), (1, "a", "2024-01-08", 8.0), (1, "a", "2024-01-01", 1.0), (2, "a", "2024-01-05", 4.0)], "player_id long, stat_type string, slate string, line_score double").withColumn("slate", F.to_date("slate"))
    wins = {(r.player_id, str(r._cut)): r.wins for r in H.line_wins(log, lines).collect()}
    assert wins == {(1, "2024-01-05"): 3, (1, "2024-01-08"): 2, (1, "2024-01-01"): 0, (2, "2024-01-05"): 0}
    days = lines.select("player_id", "stat_type", F.col("slate").alias("_cut"), F.when(F.col("player_id") == 1, 4).otherwise(0).alias("n"), F.lit(6.0).alias("hist_mean"))
    runs = {(r.player_id, str(r._cut)): (r.hot_streak_count, r.cold_streak_count) for r in H.streaks(log, days).collect()}
    assert runs == {(1, "2024-01-05"): (2.0, 0.0), (1, "2024-01-08"): (2.0, 0.0), (1, "2024-01-01"): (0.0, 0.0), (2, "2024-01-05"): (0.0, 0.0)}
