"""The movement job gives the same table however its input is cut into micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from oddsmill.operators.snapshots import previous_snapshot
from oddsmill.session import durable
from oddsmill.sources.files import scratch_path
from oddsmill.streaming import jobs as ST

SHAPE = "player_id bigint, stat_type string, snapshot_id bigint, line_score double"


@pytest.fixture(scope="module")
def lines():
    rnd = random.Random(9)
    return [(p, s, snap, float(rnd.randrange(5, 9))) for snap in range(1, 6) for p in range(3) for s in ("a", "b") for _ in range(rnd.randrange(0, 4))]


def expected(lines):
    low = {}
    for p, s, snap, line in lines:
        low[p, s, snap] = min(line, low.get((p, s, snap), line))
    out = []
    for (p, s, snap), line in low.items():
        old = low.get((p, s, snap - 2))  # odd and even snapshots are two leagues
        out.append((p, s, snap, line, old, "new" if old is None else "up" if line > old else "down" if line < old else "same"))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_files", [1, 2, 1000])
def test_movement_does_not_depend_on_batches(spark, lines, max_files):
    root = scratch_path(spark, "moves")
    shuffled = lines[:]
    random.Random(max_files).shuffle(shuffled)  # snapshots arrive split and out of order
    spark.createDataFrame(shuffled, SHAPE).repartition(6).write.parquet(f"{root}/in")
    snapshots = spark.createDataFrame([(i, i, i % 2) for i in range(1, 6)], "snapshot_id bigint, fetched_at bigint, league int")
    stream = ST.read_stream(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema, max_files=max_files)
    state = ST.latest_updates(ST.materialise(spark, ST.line_minima(stream), "update", root), ["player_id", "stat_type", "snapshot_id"])
    out = ST.line_moves(durable(state), previous_snapshot(snapshots).select("snapshot_id", "prev_snapshot_id"))
    got = [tuple(r) for r in out.select("player_id", "stat_type", "snapshot_id", "line_score", "prev_line", "movement").collect()]
    assert sorted(got, key=str) == expected(lines)


def test_asof_ties_go_to_the_tie_column_near_and_far(spark):
    from oddsmill.operators.asof import asof_latest

    build = spark.createDataFrame([("k", "2024-01-01 10:00:00", 1, 5), ("k", "2024-01-01 10:00:00", 2, 4), ("k", "2024-01-01 09:00:00", 3, 9)], "key string, t string, value int, tie int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    probe = spark.createDataFrame([(1, "k", "2024-01-01 11:00:00"), (2, "k", "2024-01-03 11:00:00"), (3, "k", "2024-01-01 10:00:00"), (4, "z", "2024-01-03 11:00:00")], "id int, key string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    out = asof_latest(probe, build, ["key"], "at", "t", ["value"], inclusive=False, tie=["tie"]).orderBy("id").collect()
    assert [(r.id, r.value) for r in out] == [(1, 1), (2, 1), (3, 3), (4, None)]


def test_no_query_plan_limits_rows_without_being_a_top_list():
    """Limits are the feature of these queries; anywhere else a limit would drop rows."""
    import pathlib
    import re

    named = {"topk_global", "snap_list", "agg_nn_cap", "rep_weight_history", "rep_health", "fallback_windows"}
    found = set()
    for path in pathlib.Path(__file__).parent.parent.joinpath("oddsmill", "plans").glob("q_*.py"):
        text = path.read_text()
        for m in re.finditer(r"\.limit\((?!0\))", text):
            found.add(re.findall(r"^def (\w+)", text[: m.start()], re.M)[-1])
    assert found <= named, found


# --- order of arrival ------------------------------------------------------------------------------------------
DAY = 24 * 3600


def stamp(seconds):
    import datetime as dt

    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def landed(spark, rows, shape, folder, seed, files=6):
    """Rows shuffled within a few days only, file by file, so that they are out of order but not beyond the watermark."""
    rnd = random.Random(seed)
    rows = sorted(rows, key=lambda r: (r[-1] + rnd.uniform(-2, 2) * DAY))
    rows = [(*r[:-1], stamp(r[-1])) for r in rows]
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], shape).coalesce(1).write.mode("append").parquet(folder)
    return ST.read_stream(spark, folder, spark.read.parquet(folder).schema, max_files=seed)


@pytest.mark.parametrize("max_files", [1, 2, 1000])
def test_labels_do_not_depend_on_batches(spark, max_files):
    rnd = random.Random(5)
    decisions = [(i, i % 120, float(rnd.randrange(3, 8)), rnd.choice(["over", "UNDER", None]), rnd.randrange(60) * DAY) for i in range(200)]
    outcomes = [(rnd.randrange(130), rnd.choice([None, *map(float, range(3, 9))]), rnd.randrange(80) * DAY) for _ in range(300)]
    root = scratch_path(spark, "labels")
    d = landed(spark, decisions, "id bigint, key bigint, line_score double, pick string, decision_time timestamp", f"{root}/d", max_files)
    o = landed(spark, outcomes, "key bigint, value double, outcome_time timestamp", f"{root}/o", max_files)
    got = {r.id: r for r in ST.resolve(spark, d, o, late="10 days").collect()}
    newest = min(max(r[-1] for r in decisions), max(r[-1] for r in outcomes)) - 10 * DAY
    seen = set()
    for i, key, line, pick, at in decisions:
        met = [(t, v) for k, v, t in outcomes if k == key and at + 3 * 3600 <= t <= at + 21 * DAY]
        valued = [m for m in met if m[1] is not None]
        if valued:
            value = min(valued)[1]
            kind = "over" if value > line else "under" if value < line else "push"
        elif at + 21 * DAY < newest:
            kind, value = ("push", line) if met else ("unresolved", None)
        else:
            assert i not in got or at + 21 * DAY == newest
            continue
        r = got[i]
        assert (r.outcome, r.actual_value, r.forced_push) == (kind, value, bool(met) and not valued)
        assert r.over_label == {"over": 1, "under": 0}.get(kind)
        assert r.is_correct == (None if pick is None or kind not in ("over", "under") else pick.lower() == kind)
        seen.add(kind)
    assert seen == {"over", "under", "push", "unresolved"}


@pytest.mark.parametrize("max_files,late", [(1, "5 days"), (2, "5 days"), (1000, "5 days"), (2, None)])
def test_online_weights_do_not_depend_on_batches(spark, max_files, late):
    from oddsmill.functions import constants as K
    from oddsmill.operators.ensemble import hedge_step, initial_weights

    rnd, experts = random.Random(8), ["p_nn", "p_lr"]
    rows = [(i, rnd.choice("aab"), rnd.randrange(2), rnd.choice([None, rnd.random()]), rnd.random(), rnd.randrange(40) * DAY) for i in range(150)]
    stream = landed(spark, rows, "id bigint, ctx string, over_label int, p_nn double, p_lr double, decision_time timestamp", f"{scratch_path(spark, 'hedge')}/in", max_files)
    got = {r.id: r for r in ST.online_hedge(spark, stream, experts, late=late).collect()}
    assert len(got) == len(rows)
    state = {}
    for i, ctx, y, a, b, _ in sorted(rows, key=lambda r: (r[-1], r[0])):
        w, n = state.get(ctx, (initial_weights(experts), 0))
        pred, w = hedge_step(w, [a, b], y, K.ETA / (1 + K.ETA_DECAY * (n + 1)), [K.WEIGHT_CAP] * 2)
        state[ctx] = w, n + 1
        assert (got[i].n, got[i].p_hedge, got[i].w_p_nn, got[i].w_p_lr) == pytest.approx((n + 1, pred, *w))


def test_first_document_of_a_key_stays(spark, tmp_path):
    import os

    shape = spark.createDataFrame([], "k int, body string").schema
    root = scratch_path(spark, "ingest")
    for n, rows in enumerate([[(1, "b"), (1, "b"), (2, "x")], [(1, "a"), (3, "z"), (3, "y")]]):
        spark.createDataFrame(rows, shape).coalesce(1).write.json(f"{root}/landing/{n}")
        path = f"{root}/landing/{n}".removeprefix("file://")
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + n, 1_700_000_000 + n))
    for _ in range(2):
        got = sorted(map(tuple, ST.ingest(spark, f"{root}/landing/*", shape, ["k"], root, max_files=1).collect()))
        assert got[:2] == [(1, "b"), (2, "x")] and got[2] in [(3, "y"), (3, "z")] and len(got) == 3
        spark.createDataFrame([(2, "later"), (3, "later")], shape).coalesce(1).write.mode("append").json(f"{root}/landing/again")
