"""Streaming jobs over the given tables, read back as batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions.exprs import num, r6
from oddsmill.operators import ensemble as E
from oddsmill.operators import snapshots as S
from oddsmill.session import durable
from oddsmill.sources.files import scratch_path
from oddsmill.streaming import jobs as ST

from .adapters import LINE_SNAPSHOTS, RESOLVED, Tables, q_r6
from .q_aggregates import LOG, collection_log
from .q_ensemble import sql_hedge
from .q_ingest import SNAPS, payloads, snapshots
from .registry import query


class Streamed(Tables):
    """The same views with one base table read as a stream."""

    def __init__(self, t: Tables, name: str):
        super().__init__(t.spark, t.folder)
        self._streamed = name

    def base(self, name: str):
        if name != self._streamed:
            return super().base(name)
        # a pattern, because a stream source takes a single file only through one; a folder matches it as well
        schema = super().base(name).schema
        return ST.read_stream(self.spark, f"{self.folder}/{name}.parque[t]", schema)


@query("st_snapshot_ingest", f"WITH {LINE_SNAPSHOTS} SELECT snapshot_id, count(DISTINCT player_id) AS docs FROM ls GROUP BY 1")
def st_snapshot_ingest(t):
    """The same documents land twice, as compressed files: the second run must add nothing."""
    root = scratch_path(t.spark, "ingest")
    docs = payloads(t)
    for name in ("first", "again"):
        docs.write.option("compression", "gzip").json(f"{root}/landing/{name}")
        docs = t.spark.read.schema(docs.schema).json(f"{root}/landing/first")
        table = ST.ingest(t.spark, f"{root}/landing/*", docs.schema, ["snapshot_id", "player_id"], root)
    return table.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("docs"))


@query("st_line_move", f"""WITH {SNAPS} SELECT c.snapshot_id, c.player_id, c.stat_type, c.line_score, o.line_score AS prev_line, CASE WHEN o.line_score IS NULL THEN 'new' WHEN c.line_score > o.line_score THEN 'up' WHEN c.line_score < o.line_score THEN 'down' ELSE 'same' END AS movement
 FROM ls c JOIN pv ON pv.snapshot_id = c.snapshot_id LEFT JOIN ls o ON o.snapshot_id = pv.prev AND o.player_id = c.player_id AND o.stat_type = c.stat_type""")
def st_line_move(t):
    o = Streamed(t, "orders").base("orders")
    lines = o.select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("snapshot_id"), F.col("o_custkey").alias("player_id"), F.col("o_orderpriority").alias("stat_type"),
                     F.floor(F.col("o_totalprice") / 1000).cast("double").alias("line_score"))
    prev = S.previous_snapshot(snapshots(t)).select("snapshot_id", "prev_snapshot_id")
    state = ST.latest_updates(ST.materialise(t.spark, ST.line_minima(lines), "update"), ["player_id", "stat_type", "snapshot_id"])
    return ST.line_moves(durable(state), prev).select("snapshot_id", "player_id", "stat_type", "line_score", "prev_line", "movement")


@query("st_online_hedge", f"WITH RECURSIVE {RESOLVED}, {sql_hedge('n + 1')} SELECT id, ctx, n, {q_r6('pred')} AS p_hedge, {', '.join(f'{q_r6(f"w[{i + 1}]")} AS w_{e}' for i, e in enumerate(K.EXPERTS))} FROM hz WHERE n > 0")
def st_online_hedge(t):
    rows = E.context(Streamed(t, "orders").resolved()).select("id", "ctx", "decision_time", "over_label", *K.EXPERTS)
    out = ST.online_hedge(t.spark, rows, K.EXPERTS)
    return out.select("id", "ctx", "n", r6("p_hedge").alias("p_hedge"), *[r6(f"w_{e}").alias(f"w_{e}") for e in K.EXPERTS])


_pick = "CASE o_orderkey % 3 WHEN 0 THEN 'over' WHEN 1 THEN 'UNDER' END"


@query("st_resolve", f"""WITH d AS (SELECT o_orderkey AS id, o_totalprice / 4e0 AS line, {_pick} AS pick, o_orderdate AS ta FROM orders), o AS (SELECT l_orderkey AS k, l_shipdate AS ta, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS v FROM lineitem),
c AS (SELECT least((SELECT max(ta) FROM d), (SELECT max(ta) FROM o)) - INTERVAL 36 HOUR AS w),
m AS (SELECT id, o.ta, v FROM d JOIN o ON o.k = d.id AND o.ta >= d.ta + INTERVAL 3 HOUR AND o.ta <= d.ta + INTERVAL 21 DAY),
f AS (SELECT id, min(ta) FILTER (v IS NOT NULL) AS t, arg_min(v, (ta, v)) FILTER (v IS NOT NULL) AS v, count(*) > count(v) AS void FROM m GROUP BY 1),
g AS (SELECT d.*, f.t, f.t IS NULL AND coalesce(void, false) AND line IS NOT NULL AS forced_push, CASE WHEN f.t IS NULL AND coalesce(void, false) THEN line ELSE f.v END AS actual FROM d LEFT JOIN f ON f.id = d.id WHERE f.t IS NOT NULL OR d.ta + INTERVAL 21 DAY < (SELECT w FROM c)),
r AS (SELECT *, CASE WHEN forced_push OR actual = line THEN 'push' WHEN actual > line THEN 'over' WHEN actual < line THEN 'under' ELSE 'unresolved' END AS outcome FROM g)
SELECT id AS order_id, CAST(epoch_us(t) AS BIGINT) AS outcome_us, {q_r6('actual')} AS actual_value, outcome, CASE outcome WHEN 'over' THEN 1 WHEN 'under' THEN 0 END AS over_label, CASE WHEN outcome IN ('over', 'under') AND pick IS NOT NULL THEN lower(pick) = outcome END AS is_correct, forced_push FROM r""")
def st_resolve(t):
    at = lambda c: F.col(c).cast("timestamp")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double") / num(4)
    d = Streamed(t, "orders").base("orders").select(key.alias("id"), key.alias("key"), price.alias("line_score"), F.when(key % 3 == 0, "over").when(key % 3 == 1, "UNDER").alias("pick"), at("o_orderdate").alias("decision_time"))
    o = Streamed(t, "lineitem").base("lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice").cast("double")).alias("value"), at("l_shipdate").alias("outcome_time"))
    out = ST.resolve(t.spark, d, o)
    return out.select(F.col("id").alias("order_id"), F.unix_micros("outcome_time").alias("outcome_us"), r6("actual_value").alias("actual_value"), "outcome", "over_label", "is_correct", "forced_push")


_c = lambda k, n: f"count(CASE WHEN event = '{k}' THEN 1 END) AS {n}"


@query("st_window_counts", f"WITH {LOG} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, source, {_c('request_end', 'requests')}, {_c('request_error', 'errors')}, {_c('cache_hit', 'cache_hits')}, {_c('cache_miss', 'cache_misses')} FROM lg GROUP BY 1, 2")
def st_window_counts(t):
    log = collection_log(Streamed(t, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = ST.latest_updates(ST.materialise(t.spark, ST.window_counts(log), "update"), ["window_start", "source"])
    return out.select(F.to_date("window_start").cast("string").alias("day"), "source", "requests", "errors", "cache_hits", "cache_misses")
