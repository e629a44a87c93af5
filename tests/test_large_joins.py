import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmill.operators import calibration as C
from oddsmill.operators import history as H
from oddsmill.operators import labels as L
from oddsmill.plans.adapters import Tables
from oddsmill.plans.catalogue import CATALOGUE

#: What stays small: days and team games, the thirty teams, one row a measure.
BROADCAST = re.compile(r"BroadcastHashJoin \[([^\]]*)\]")


def broadcast_keys(df, capsys) -> set[str]:
    capsys.readouterr()
    df.explain()
    return {re.sub(r"#\d+L?", "", k) for keys in BROADCAST.findall(capsys.readouterr().out) for k in keys.split(", ")}


@pytest.mark.parametrize("name", ["lab_backtest_set", "lab_resolve", "lab_update", "lab_resolve_summary"])
def test_no_table_of_lines_players_or_forecasts_is_broadcast(spark, capsys, name):
    """Tables of the smallest folder are below any threshold, as the files of the largest can be."""
    keys = broadcast_keys(CATALOGUE[name].plan(Tables(spark, "/root/testdata/sf0.001").pin_game_log()), capsys)
    assert not keys & {"id", "player_id", "official_player", "line_id", "name_key", "actual_value"}, keys


def test_merged_sides_keep_rows_without_a_match_and_null_keys(spark, capsys):
    lines = spark.sql("SELECT * FROM VALUES (1L, 'a', DATE '2024-01-01'), (1L, 'a', DATE '2024-01-02'), (null, 'a', DATE '2024-01-01'), (2L, null, DATE '2024-01-01') AS v(player_id, stat_type, slate)")
    days = spark.sql("SELECT 1L AS player_id, 'a' AS stat_type, DATE '2024-01-01' AS _cut, 7 AS n")
    out = H.attach(lines, days)
    assert not broadcast_keys(out, capsys)
    assert sorted(((r.player_id, r.stat_type, r.n) for r in out.collect()), key=str) == sorted([(1, "a", 7), (1, "a", None), (None, "a", None), (2, None, None)], key=str)


def test_labels_are_filled_without_a_broadcast(spark, capsys):
    log = spark.createDataFrame([(1, None), (2, 5.0), (None, None), (3, None)], "id bigint, actual_value double")
    out = L.fill_labels(log, spark.createDataFrame([(1, 9.0), (2, 8.0), (None, 7.0)], "id bigint, actual_value double"), "id", ["actual_value"])
    assert not broadcast_keys(out, capsys)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 9.0), (2, 5.0), (None, None), (3, None)], key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 511, 512, 1023, 1024, 2000])
def test_interpolation_looks_its_place_up_by_halving(spark, n):
    """Ties, both ends, maps of any size, null and NaN; the filter over all knots is evaluated for none of the usual sizes."""
    rnd = np.random.default_rng(n)
    kx, ky = np.sort(rnd.integers(0, n, n) / n), np.sort(rnd.random(n))
    u = [-1.0, 0.0, 1.0, 2.0, float("nan"), None, *rnd.random(40).tolist(), *rnd.choice(kx, 20).tolist()]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(u)], "i int, u double").crossJoin(spark.createDataFrame([(kx.tolist(), ky.tolist())], "kx array<double>, ky array<double>"))
    got = {r.i: r for r in rows.select("i", C._at_or_below("kx", F.col("u")).alias("at"), F.size(F.filter("kx", lambda k: k <= F.col("u"))).alias("want"), C.interpolate(F.col("u")).alias("y")).collect()}
    assert all(r.at == r.want for r in got.values())
    for i, v in enumerate(u):
        at = got[i].want
        if 0 < at < n and v == v:
            assert kx[at] > kx[at - 1] and abs(got[i].y - (ky[at - 1] + (v - kx[at - 1]) / (kx[at] - kx[at - 1]) * (ky[at] - ky[at - 1]))) < 1e-12
    assert got[0].y == 0.0 and got[5].y == 0.0 and got[3].y == 1.0


def test_without_knots_there_is_no_value(spark):
    r = spark.sql("SELECT CAST(null AS array<double>) AS kx, CAST(null AS array<double>) AS ky, 0.5D AS u").select(C.interpolate(F.col("u")).alias("y")).first()
    assert r.y is None
    assert str(C.interpolate(F.col("u"))).count("filter(") == 1   # once a row: ten times before


def test_fitted_scopes_are_broadcast_so_no_scope_fills_a_task(spark, capsys):
    """A join by shuffle sends every row of a scope, and with it half of all rows, to one task."""
    rows = spark.createDataFrame([(1, "a", 0.1), (2, "a", 0.2), (3, "b", 0.3), (4, None, 0.4)], "id int, scope string, u double")
    params = spark.createDataFrame([("a", 1.0), (None, 2.0)], "scope string, a double")
    out = C.with_params(rows, params)
    capsys.readouterr()
    out.explain()
    assert "hashpartitioning(scope" not in capsys.readouterr().out
    assert sorted((r.id, r.a) for r in out.collect()) == [(1, 1.0), (2, 1.0)]
    C.ks_uniform(rows, ["scope"], "u").explain()
    assert "BroadcastHashJoin [scope" in capsys.readouterr().out
    assert {(r.scope, r.j, r.x) for r in C.pit_knots(rows, ["scope"], "u").collect()} == {("a", 0, 0.1), ("a", 1, 0.2), ("b", 0, 0.3)}


def test_trees_are_fitted_on_partitions_of_bounded_size(spark):
    from oddsmill.plans import q_ensemble as Q

    cores = spark.sparkContext.defaultParallelism
    df = spark.range(0, 100 * cores, 1, 1).select(F.col("id").alias("idx"), (F.col("id") % 2).cast("double").alias("label"))
    assert Q.tree_partitions(df, 100) is df
    out = Q.tree_partitions(df, 20)
    parts = out.select("*", F.spark_partition_id().alias("p")).collect()
    assert sorted(r.idx for r in parts) == list(range(100 * cores))
    assert len({r.p for r in parts}) > 4 * cores and max(sum(r.p == k for r in parts) for k in {r.p for r in parts}) <= 60


def test_boosted_trees_deal_their_rows_out(spark, monkeypatch):
    from oddsmill.plans import q_ensemble as Q

    asked = []
    monkeypatch.setattr(Q, "tree_partitions", lambda df: asked.append(df.columns) or df)
    rows = spark.range(60).select(F.col("id").alias("idx"), (F.col("id") % 2).cast("double").alias("label"), F.col("id").cast("double").alias("x"))
    Q.fit_gbt(rows, ["x"], rounds=2)
    assert asked and "idx" in asked[0]
