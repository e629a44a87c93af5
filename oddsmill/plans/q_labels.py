"""Outcome resolution, training frame and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions import measures as M
from oddsmill.functions import names as N
from oddsmill.functions.exprs import big, num, r6
from oddsmill.operators import labels as L
from oddsmill.operators import matching as J
from oddsmill.session import merged

from .adapters import EPOCH_DAY, LINES, MEASURE_COLS, PREDICTIONS, q_r6, sql_list, union_sql
from .q_joins import RESOLVE, WORLD, World, flagged, resolve_sides
from .registry import query

ORDER = ["decision_time", "id"]
OPEN = PREDICTIONS + ", op AS (SELECT *, CASE WHEN id % 4 <> 0 THEN actual_value END AS av FROM pr)"


def open_log(t):
    """Prediction log in which every fourth row is still unresolved."""
    return t.predictions().withColumn("actual_value", F.when(F.col("id") % 4 != 0, F.col("actual_value")))


@query("lab_candidates", f"""WITH {OPEN}, c AS (SELECT max(decision_time) AS c FROM pr), k AS (SELECT id, decision_time FROM op, c
WHERE av IS NULL AND id % 17 <> 0 AND id % 23 <> 0 AND stat_type IS NOT NULL AND line_score IS NOT NULL AND decision_time >= c - INTERVAL 21 DAY AND decision_time <= c - INTERVAL 3 HOUR)
SELECT id, CAST(epoch_us(decision_time) AS BIGINT) AS decided_us, CAST(greatest((SELECT count(*) FROM k) - 10000, 0) AS BIGINT) AS remaining FROM k ORDER BY decision_time, id LIMIT 10000""")
def lab_candidates(t):
    i = F.col("id")
    log = open_log(t).select("id", "decision_time", "actual_value", F.when(i % 17 != 0, F.col("player_id")).alias("player_id"), F.when(i % 23 != 0, i).alias("game_id"), "stat_type", "line_score")
    c = L.candidates(log, ["player_id", "game_id", "stat_type", "line_score"])
    return c.select("id", F.unix_micros(F.col("decision_time").cast("timestamp")).alias("decided_us"), big("remaining").alias("remaining"))


RES = WORLD + ", " + RESOLVE + f""",
mapl AS (SELECT line_id AS player_id, player_id AS official_player FROM src JOIN dim ON src.name_key = dim.name_key),
bx AS (SELECT * FROM gl WHERE player_id % 11 <> 0),
bc AS (SELECT 90000000 + least(player_id % 30, 29 - player_id % 30) * 100000 + {EPOCH_DAY.format('game_date')} AS official_id, count(*) AS box_rows FROM bx GROUP BY 1),
cd AS (SELECT ft.*, CASE WHEN ln.p_final >= 5e-1 THEN 'OVER' ELSE 'UNDER' END AS pick FROM ft JOIN ln ON ln.id = ft.id),
r0 AS (SELECT cd.*, bx.player_id IS NOT NULL AS matched, bx.player_id IS NULL AND coalesce(box_rows, 0) > 0 AS forced_push,
   CASE cd.stat_type WHEN 'Points' THEN points WHEN 'Rebounds' THEN rebounds WHEN 'Assists' THEN assists ELSE turnovers END AS val
  FROM cd JOIN mapl ON mapl.player_id = cd.player_id JOIN games g ON g.game_id = cd.game_id LEFT JOIN gm ON gm.game_id = cd.game_id LEFT JOIN bc ON bc.official_id = gm.official_id
  LEFT JOIN bx ON bx.player_id = mapl.official_player AND bx.game_date = cd.slate),
r1 AS (SELECT *, CASE WHEN forced_push THEN line_score ELSE val END AS actual_value FROM r0),
r2 AS (SELECT *, CASE WHEN forced_push OR actual_value = line_score THEN 'push' WHEN actual_value > line_score THEN 'over' ELSE 'under' END AS outcome FROM r1 WHERE actual_value IS NOT NULL),
rz AS (SELECT id, matched, forced_push, {q_r6('actual_value')} AS actual_value, outcome, CASE outcome WHEN 'over' THEN 1 WHEN 'under' THEN 0 END AS over_label,
   CASE WHEN outcome <> 'push' THEN lower(pick) = outcome END AS is_correct FROM r2)"""


def resolved_lines(t, keep_open=False):
    w = World(t)
    src, dim = resolve_sides(t)
    players = src.join(merged(dim).withColumnRenamed("player_id", "official_player"), "name_key").select(F.col("line_id").alias("player_id"), "official_player")
    games = w.games.select("game_id", J.eastern_date(F.col("start_time").cast("timestamp")).alias("game_date")).join(w.game_map(), "game_id", "left")
    boxes = t.game_log().filter("player_id % 11 <> 0")
    a, b = F.col("player_id") % 30, 29 - F.col("player_id") % 30
    counts = boxes.groupBy((F.lit(90000000) + F.least(a, b) * 100000 + F.unix_date("game_date")).alias("official_id")).agg(F.count(F.lit(1)).alias("box_rows"))
    picks = t.lines().select("id", F.when(X.pick_over("p_final"), "OVER").otherwise("UNDER").alias("pick"))
    lines = w.features().join(merged(picks), "id")
    return L.resolve(lines, players, games, boxes.select(F.col("player_id").alias("official_player"), "game_date", *MEASURE_COLS), counts,
                     M.measure_value("stat_type", MEASURE_COLS), keep_open).withColumn("actual_value", r6("actual_value"))


RESULT = ["id", "matched", "forced_push", "actual_value", "outcome", "over_label", "is_correct"]


@query("lab_resolve", f"WITH {RES} SELECT * FROM rz")
def lab_resolve(t):
    return resolved_lines(t).select(*RESULT)


@query("lab_update", f"""WITH {RES}, lgx AS (SELECT id, CASE WHEN id % 3 = 0 THEN 1e0 END AS actual_value, CASE WHEN id % 3 = 0 THEN 'under' END AS outcome FROM ln)
SELECT l.id, CASE WHEN l.actual_value IS NULL THEN rz.actual_value ELSE l.actual_value END AS actual_value, CASE WHEN l.actual_value IS NULL THEN rz.outcome ELSE l.outcome END AS outcome FROM lgx l LEFT JOIN rz ON rz.id = l.id""")
def lab_update(t):
    log = t.lines().select("id", F.when(F.col("id") % 3 == 0, num(1)).alias("actual_value"), F.when(F.col("id") % 3 == 0, "under").alias("outcome"))
    return L.fill_labels(log, resolved_lines(t), "id", ["actual_value", "outcome"])


@query("lab_resolve_summary", f"""WITH {RES} SELECT (SELECT count(*) FROM ln) AS candidates, (SELECT count(CASE WHEN matched THEN 1 END) FROM r0) AS matched_boxscores, count(*) AS updated, count(CASE WHEN is_correct THEN 1 END) AS wins,
 count(CASE WHEN NOT is_correct THEN 1 END) AS losses, count(CASE WHEN outcome = 'push' THEN 1 END) AS pushes, count(CASE WHEN forced_push THEN 1 END) AS forced_push FROM rz""")
def lab_resolve_summary(t):
    return L.summary(resolved_lines(t, keep_open=True), t.lines().agg(F.count(F.lit(1))).scalar())


@query("lab_canonical_view", f"WITH {PREDICTIONS} SELECT id, stat_type, outcome, over_label, p_final, is_correct FROM pr WHERE outcome IN ('over', 'under') AND over_label IS NOT NULL AND actual_value IS NOT NULL")
def lab_canonical_view(t):
    view = L.canonical(t.predictions())
    view.createOrReplaceTempView("resolved_picks")
    return t.spark.table("resolved_picks").select("id", "stat_type", "outcome", "over_label", "p_final", "is_correct")


TF = PREDICTIONS + """, fl AS (SELECT id, player_id, decision_time, line_score, actual_value AS actual, CASE WHEN id % 6 <> 1 THEN stat_type END AS stat_type, CASE WHEN id % 10 = 3 THEN true END AS is_combo, CASE WHEN id % 4 = 1 THEN true WHEN id % 4 = 2 THEN false END AS is_live,
  CASE WHEN id % 9 = 1 THEN true END AS in_game, CASE WHEN id % 8 <> 0 THEN CAST(id % 30 - 3 AS DOUBLE) END AS minutes_to_start, CASE WHEN id % 50 = 7 THEN 'A + B' ELSE 'A' END AS player_name, CASE WHEN id % 7 <> 0 THEN CAST(id % 100 - 5 AS DOUBLE) END AS trending_count FROM pr),
tf AS (SELECT * FROM (SELECT *, CASE WHEN actual > line_score THEN 1 ELSE 0 END AS over, row_number() OVER (PARTITION BY player_id, line_score ORDER BY decision_time, id) AS rn FROM fl
  WHERE NOT coalesce(is_combo, false) AND NOT coalesce(is_live, false) AND NOT coalesce(in_game, false) AND player_name NOT LIKE '%+%' AND coalesce(minutes_to_start, 0) >= 0 AND actual IS NOT NULL) WHERE rn = 1)"""


@query("lab_train_frame", f"""WITH {TF} SELECT id, over, coalesce(stat_type, 'unknown') AS stat_type, coalesce(minutes_to_start, 0e0) AS minutes_to_start, {q_r6('ln(1e0 + greatest(coalesce(trending_count, 0e0), 0e0))')} AS trending_count FROM tf""")
def lab_train_frame(t):
    i = F.col("id")
    raw = t.predictions().select(
        "id", "player_id", "decision_time", "line_score", F.col("actual_value").alias("actual"), F.when(i % 6 != 1, F.col("stat_type")).alias("stat_type"),
        F.when(i % 10 == 3, True).alias("is_combo"), F.when(i % 4 == 1, True).when(i % 4 == 2, False).alias("is_live"), F.when(i % 9 == 1, True).alias("in_game"),
        F.when(i % 8 != 0, (i % 30 - 3).cast("double")).alias("minutes_to_start"), F.when(i % 50 == 7, "A + B").otherwise("A").alias("player_name"),
        F.when(i % 7 != 0, (i % 100 - 5).cast("double")).alias("trending_count"))
    f = L.training_frame(raw, ["player_id", "line_score"], "decision_time", ["stat_type"], ["minutes_to_start"], ["trending_count"])
    return f.select("id", "over", "stat_type", "minutes_to_start", r6("trending_count").alias("trending_count"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("lab_onehot", "SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderpriority = '{p}' THEN 1e0 ELSE 0e0 END AS o_orderpriority_{''.join(ch if ch.isalnum() else '_' for ch in p)}" for p in PRIORITIES)
       + ", " + ", ".join(f"CASE WHEN o_orderstatus = '{s}' THEN 1e0 ELSE 0e0 END AS o_orderstatus_{s}" for s in "FOP") + " FROM orders")
def lab_onehot(t):
    return t.base("orders").select("o_orderkey", *L.one_hot("o_orderpriority", PRIORITIES), *L.one_hot("o_orderstatus", list("FOP")))


@query("lab_category_index", """WITH ix AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS code FROM (SELECT DISTINCT p_brand || ' ' || p_type AS p_type FROM part WHERE p_partkey % 3 <> 0))
SELECT p_partkey, coalesce(code, 0) AS code FROM part LEFT JOIN ix ON ix.p_type = part.p_brand || ' ' || part.p_type""")
def lab_category_index(t):
    p = t.base("part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("kind"))
    return L.encode(p, L.category_index(p.filter("p_partkey % 3 <> 0"), "kind"), "kind").select("p_partkey", "code")


SEQ = PREDICTIONS + ", sq AS (SELECT id, decision_time, row_number() OVER (ORDER BY decision_time, id) - 1 AS idx, count(*) OVER () AS n FROM pr)"


def seq(t):
    return L.positions(t.predictions().select(*ORDER), ORDER)


@query("lab_time_split", f"WITH {SEQ} SELECT id, CASE WHEN idx >= CAST(floor(n * (1e0 - 2e-1)) AS BIGINT) THEN 'test' ELSE 'train' END AS part FROM sq")
def lab_time_split(t):
    return seq(t).select("id", L.holdout().alias("part"))


@query("lab_ts_folds", f"WITH {SEQ} SELECT id, CASE WHEN idx >= n - 5 * (n // 6) THEN (idx - (n - 5 * (n // 6))) // (n // 6) END AS test_fold FROM sq")
def lab_ts_folds(t):
    return seq(t).select("id", L.expanding_fold(5).alias("test_fold"))


@query("lab_prequential", f"WITH {SEQ} SELECT id, CASE WHEN idx < (n % 7) * (n // 7 + 1) THEN idx // (n // 7 + 1) ELSE n % 7 + (idx - (n % 7) * (n // 7 + 1)) // (n // 7) END AS fold FROM sq")
def lab_prequential(t):
    return seq(t).select("id", L.prequential_fold(7).alias("fold"))


@query("lab_walk_folds", f"""WITH {SEQ}, f AS (SELECT idx, CASE WHEN idx >= CAST(floor(n * 4e-1) AS BIGINT) THEN least((idx - CAST(floor(n * 4e-1) AS BIGINT)) // ((n - CAST(floor(n * 4e-1) AS BIGINT)) // 3), 2) END AS fold FROM sq)
SELECT 'rows' AS kind, fold, min(idx) AS train_n, count(*) AS test_n FROM f WHERE fold IS NOT NULL GROUP BY fold HAVING min(idx) >= 50 AND count(*) >= 20
UNION ALL SELECT 'days', i, (SELECT count(*) FROM pr WHERE decision_time >= t0 + INTERVAL (7 * i) DAY AND decision_time < t0 + INTERVAL (60 + 7 * i) DAY),
  (SELECT count(*) FROM pr WHERE decision_time >= t0 + INTERVAL (60 + 7 * i) DAY AND decision_time < t0 + INTERVAL (74 + 7 * i) DAY)
 FROM (SELECT min(decision_time) AS t0, max(decision_time) AS t1 FROM pr), (SELECT unnest(range(0, 1000)) AS i) WHERE t0 + INTERVAL (74 + 7 * i) DAY <= t1""")
def lab_walk_folds(t):
    by_rows = seq(t).withColumn("fold", L.walk_fold(3)).filter("fold IS NOT NULL").groupBy("fold").agg(
        F.min("idx").alias("train_n"), F.count(F.lit(1)).alias("test_n")).filter("train_n >= 50 AND test_n >= 20").withColumn("kind", F.lit("rows"))
    return by_rows.unionByName(day_windows(t.predictions().select("decision_time"), 60, 14, 7).withColumn("kind", F.lit("days")))


def day_windows(df, train: int, test: int, slide: int):
    """Train and test counts of every sliding window. Each row names the windows it belongs to; nothing is joined."""
    span = df.agg(F.struct(F.min("decision_time").alias("t0"), F.max("decision_time").alias("t1"))).scalar()
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    d = df.withColumn("_s", span).select(((us(F.col("decision_time")) - us(F.col("_s.t0"))) / num(86400e6)).alias("day"),
                                          F.floor(((us(F.col("_s.t1")) - us(F.col("_s.t0"))) / num(86400e6) - train - test) / slide).alias("last"))

    def covering(start: int, length: int):
        hi = F.least(F.floor((F.col("day") - start) / slide), F.col("last"))
        lo = F.greatest(F.floor((F.col("day") - start - length) / slide) + 1, F.lit(0))
        return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    marks = F.concat(F.transform(covering(0, train), lambda i: F.struct(i.alias("fold"), F.lit(0).alias("test"))),
                     F.transform(covering(train, test), lambda i: F.struct(i.alias("fold"), F.lit(1).alias("test"))))
    return d.select(F.explode(marks).alias("m")).groupBy("m.fold").agg(
        X.count_true(F.col("m.test") == 0).alias("train_n"), X.count_true(F.col("m.test") == 1).alias("test_n"))
