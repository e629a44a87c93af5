"""The backtest of the strategies computes what they share once."""

import random

from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.operators import ensemble as E
from oddsmill.plans.adapters import Tables
from oddsmill.plans.q_policy import rep_backtest
from oddsmill.plans.registry import CATALOGUE


def orders(spark, folder):
    rnd = random.Random(4)
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    rows = [(i, rnd.randrange(1, 60), rnd.choice("FFOOP"), rnd.randrange(1_000, 90_000) / 1.0, f"199{rnd.randrange(2, 8)}-0{rnd.randrange(1, 10)}-1{rnd.randrange(10)}", rnd.choice(names)) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string")
    df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).write.parquet(f"{folder}/orders.parquet")


def test_rolling_rates_of_all_rows_are_computed_once(spark, tmp_path, monkeypatch):
    orders(spark, tmp_path)
    calls, old = [], E.rolled_hits
    monkeypatch.setattr(E, "rolled_hits", lambda df, experts, order, window, keys: calls.append(keys) or old(df, experts, order, window, keys))
    out = rep_backtest(Tables(spark, str(tmp_path)))
    assert sorted(calls) == [[], ["stat_type"]]
    n = {r.strategy: r.n for r in out.filter("slice = 'scored'").collect()}
    assert len(n) == 4 and n["recency_weighted"] == n["top_k"] == n["per_stat"] == n["logit_avg"] > 0


def test_shared_rates_give_the_same_probabilities(spark, tmp_path):
    orders(spark, tmp_path)
    t = Tables(spark, str(tmp_path))
    rows, order = t.resolved(), ["decision_time", "id"]
    for name, own, column in (("ens_recency", E.recency_weighted, "p_recency"), ("ens_top_k", E.top_k, "p_top_k")):
        alone = {r.id: round(r[column], 6) for r in own(rows, K.EXPERTS, order).collect()}
        assert {r.id: r.p for r in CATALOGUE[name].plan(t).collect()} == alone
