"""Grouped aggregates and stored reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsmill.functions import coerce as C
from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, count_true, num, r6
from oddsmill.operators import aggregates as AG
from oddsmill.operators import ensemble as E
from oddsmill.operators import matching as J
from oddsmill.operators import reports as R
from oddsmill.operators.distribution import exact_quantiles
from oddsmill.sources import inspect as IN

from .adapters import GAME_LOG, LINES, LINE_SNAPSHOTS, PREDICTIONS, RESOLVED, TEAM_GAMES, pick_from, pseudo_prob, q_hit, q_loss, q_pick, q_r6, q_sum, sql_list, union_sql
from .q_ensemble import CANDS, Q_CTX
from .q_ingest import payloads
from .q_reports import ALL, ORDER, TAIL, TIER_COLS, _tail, sql_bin
from .q_scalar import EDGE, edge_rows, q_grade
from .q_windows import LONG, LONG_SQL, logs
from .registry import query

EX = K.EXPERTS


@query("agg_team_game", f"WITH {TEAM_GAMES} SELECT team, CAST(game_date AS VARCHAR) AS game_date, opp, CAST(is_home AS INT) AS is_home, points, rebounds, assists, turnovers, blocks, fga, fta, oreb, fg3m, fgm FROM tg")
def agg_team_game(t):
    return t.team_games().withColumn("game_date", F.col("game_date").cast("string"))


@query("agg_league_means", f"WITH {GAME_LOG} SELECT {', '.join(f'{q_r6(f'avg({e})')} AS {n}' for n, e in {'points': 'points', 'ptsrebsasts': 'points + rebounds + assists', 'twopointersmade': 'fgm - fg3m', 'fgattempted': 'fga'}.items())} FROM gl")
def agg_league_means(t):
    from oddsmill.functions.measures import measure_column

    return AG.means(t.game_log(), {k: measure_column(k, missing_as_zero=True) for k in ("points", "ptsrebsasts", "twopointersmade", "fgattempted")})


@query("agg_count_distinct", """SELECT count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS pending_rows, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_custkey END) AS pending_games, (SELECT count(*) FROM lineitem) AS stats_rows,
 (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS stats_games, count(DISTINCT o_orderkey) AS game_rows FROM orders""")
def agg_count_distinct(t):
    """Exact distinct counts by grouping first: partial dedupe happens map-side."""
    o, l = t.base("orders"), t.base("lineitem").select("l_orderkey")
    distinct = lambda df, c: df.select(c).distinct().agg(F.count(c)).scalar()
    pend = o.filter("o_orderstatus = 'P'")
    return o.agg(count_true(F.col("o_orderstatus") == "P").alias("pending_rows"), distinct(pend, "o_custkey").alias("pending_games"), l.agg(F.count(F.lit(1))).scalar().alias("stats_rows"),
                 distinct(l, "l_orderkey").alias("stats_games"), distinct(o, "o_orderkey").alias("game_rows"))


@query("agg_grouping_sets", f"WITH {RESOLVED} SELECT coalesce(stat_type, '__all__') AS stat_type, count(*) AS n, {q_r6('avg(power(p_final - over_label, 2))')} AS brier, {q_r6('avg(CAST(is_correct AS DOUBLE))')} AS accuracy FROM rs GROUP BY GROUPING SETS ((stat_type), ())")
def agg_grouping_sets(t):
    g = t.resolved().groupingSets([["stat_type"], []], "stat_type").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.pow(F.col("p_final") - F.col("over_label"), num(2)))).alias("brier"), r6(F.avg(F.col("is_correct").cast("double"))).alias("accuracy"))
    return g.withColumn("stat_type", F.coalesce("stat_type", F.lit("__all__")))


@query("agg_value_counts", f"WITH {PREDICTIONS}, c AS (SELECT stat_type, count(*) AS n FROM pr GROUP BY 1) SELECT stat_type, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 4) AS share, round(max(n) OVER () / CAST(sum(n) OVER () AS DOUBLE), 4) AS top_share FROM c")
def agg_value_counts(t):
    return AG.top_share(t.predictions(), "stat_type")


@query("agg_coverage", f"WITH {PREDICTIONS} SELECT {', '.join(f'round(avg(CASE WHEN {e} IS NULL THEN 0e0 ELSE 1e0 END), 4) AS {e}' for e in EX)} FROM pr")
def agg_coverage(t):
    return AG.coverage(t.predictions(), EX)


_docs = f"""{LINE_SNAPSHOTS}, d AS (SELECT DISTINCT snapshot_id, player_id FROM ls), it AS (SELECT 'data' AS section, 'projection' AS type, snapshot_id || '-' || player_id || '-' || substr(stat_type, 1, 1) AS id, player_id FROM ls UNION ALL SELECT 'included', 'new_player', CAST(player_id AS VARCHAR), player_id FROM d)"""
_lacks = {"attribute_null": {"line_score": "player_id % 19 = 0", "stat_type": "false", "projection_type": "true", "status": "true", "start_time": "false"},
          "relationship_missing": {"new_player": "player_id % 23 = 0"} | {k: "true" for k in IN.LINE_RELATIONSHIPS[1:]}}
_checks = [("'total'", "items", "total", "true")] + [(f"'{s}'", "required_missing", k, "false") for s in IN.SECTIONS for k in IN.REQUIRED[s]] + [("'data'", p, k, test) for p, v in _lacks.items() for k, test in v.items()]


@query("agg_audit", f"""WITH {_docs} {' UNION ALL '.join(f"SELECT section, '{p}' AS part, '{k}' AS name, count(CASE WHEN {test} THEN 1 END) AS n FROM it WHERE {'true' if s == "'total'" else f'section = {s}'} GROUP BY 1" for s, p, k, test in _checks)}
UNION ALL SELECT section, 'duplicates', 'id,type', count(*) - count(DISTINCT id) FROM it GROUP BY 1 UNION ALL SELECT section, 'type', type, count(*) FROM it GROUP BY 1, 3""")
def agg_audit(t):
    return IN.audit(payloads(t))


@query("agg_inspect", f"""WITH {_docs}, a AS (SELECT 'data' AS section, 'projection' AS type, 'attribute' AS part, k AS name, count(*) AS n FROM ls, (SELECT unnest(['line_score', 'stat_type', 'odds_type', 'start_time', 'is_live']) AS k) WHERE k <> 'line_score' OR player_id % 19 <> 0 GROUP BY 4),
 b AS (SELECT 'data', 'projection', 'relationship:' || CASE WHEN k = 'new_player' THEN 'object' ELSE 'list' END, k, count(*) FROM ls, (SELECT unnest(['new_player', 'markets']) AS k) WHERE k <> 'new_player' OR player_id % 23 <> 0 GROUP BY 3, 4),
 c AS (SELECT 'included', 'new_player', 'attribute', k, count(*) FROM d, (SELECT unnest(['name', 'combo']) AS k) WHERE k <> 'combo' OR player_id % 5 = 0 GROUP BY 4),
 e AS (SELECT section, type, 'total', 'items', count(*) FROM it GROUP BY 1, 2), h AS (SELECT 'payload', CAST(NULL AS VARCHAR), 'top_level', k, count(*) FROM d, (SELECT unnest(['data', 'included']) AS k) GROUP BY 4),
 g AS (SELECT section, type, 'sample_id', id, count(*) FROM it GROUP BY 1, 2, 4 QUALIFY row_number() OVER (PARTITION BY section, type ORDER BY id) <= 3)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e UNION ALL SELECT * FROM h UNION ALL SELECT * FROM g""")
def agg_inspect(t):
    return IN.inspect(payloads(t))


KINDS = {"purchase": "request_end", "error": "request_error", "view": "cache_hit", "click": "cache_miss", "signup": "validation"}
LOG = f"""lg AS (SELECT event_id AS id, ts, 'src' || (user_id % 5) AS source, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS event, value AS elapsed_ms, 'e' || (event_id % 7) AS error, event_id % 3 = 0 AS valid FROM events)"""


def collection_log(t):
    e = t.base("events")
    return e.select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"), X.lookup(KINDS, F.col("event_type")).alias("event"), F.col("value").alias("elapsed_ms"),
                    F.concat(F.lit("e"), (F.col("event_id") % 7).cast("string")).alias("error"), (F.col("event_id") % 3 == 0).alias("valid"))


_n = lambda k: f"count(CASE WHEN event = '{k}' THEN 1 END)"
_rt = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} / CAST({b} AS DOUBLE), 3) ELSE 0e0 END"


@query("agg_collect_health", f"""WITH {LOG} SELECT source, {_n('request_end')} AS requests, {_n('request_error')} AS errors, {_n('cache_hit')} AS cache_hits, {_n('cache_miss')} AS cache_misses, {_n('circuit_open')} AS circuit_opens,
 count(CASE WHEN event = 'validation' AND NOT valid THEN 1 END) AS validation_failures, arg_max(error, ts) FILTER (WHERE event = 'request_error') AS last_error,
 {_rt("coalesce(sum(CASE WHEN event = 'request_end' THEN elapsed_ms END), 0e0)", _n('request_end'))} AS avg_elapsed_ms, {_rt(_n('cache_hit'), f"({_n('cache_hit')} + {_n('cache_miss')})")} AS cache_hit_rate, {_rt(_n('request_error'), f"({_n('request_end')} + {_n('request_error')})")} AS error_rate
FROM lg WHERE ts >= (SELECT max(ts) FROM lg) - INTERVAL 240 HOUR GROUP BY 1""")
def agg_collect_health(t):
    return AG.collection_health(collection_log(t), 240)


NUMERIC = ["minutes", "points", "rebounds", "assists", "fga"]


@query("agg_numeric_stats", f"WITH {GAME_LOG} {union_sql([f'''SELECT '{c}' AS feature, {q_r6(f'avg({c})')} AS mean, {q_r6(f'CASE WHEN coalesce(stddev_samp({c}), 0) < 1e-8 THEN 1e0 ELSE stddev_samp({c}) END')} AS std FROM gl''' for c in NUMERIC])}")
def agg_numeric_stats(t):
    return AG.numeric_stats(t.game_log(), NUMERIC)


LIMITS = {"points": 80, "rebounds": 40, "assists": 30, "turnovers": 20}   # fixed values: largest plausible value per measure


@query("agg_sanity", f"""WITH {LINES} SELECT '__all__' AS stat, count(*) AS n, {q_r6('avg(CASE WHEN actual > line_score THEN 1e0 ELSE 0e0 END)')} AS over_rate, CAST(0 AS BIGINT) AS above_limit, max(actual) AS max_value FROM ln
UNION ALL SELECT lower(stat_type), count(*), {q_r6('avg(CASE WHEN actual > line_score THEN 1e0 ELSE 0e0 END)')}, count(CASE WHEN actual > CASE lower(stat_type) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in LIMITS.items())} END THEN 1 END), max(actual) FROM ln GROUP BY 1""")
def agg_sanity(t):
    l = t.lines().select(F.lower("stat_type").alias("stat"), "actual", "line_score").withColumn("stat", F.explode(F.array("stat", F.lit("__all__"))))
    limit = X.lookup({k: float(v) for k, v in LIMITS.items()}, F.col("stat"))
    return l.groupBy("stat").agg(F.count(F.lit(1)).alias("n"), r6(X.share(F.col("actual") > F.col("line_score"))).alias("over_rate"), count_true(F.coalesce(F.col("actual") > limit, F.lit(False))).alias("above_limit"), F.max("actual").alias("max_value"))


CORR = ["minutes", "points", "rebounds", "assists", "fga", "fta", "oreb", "fg3m", "fgm"]


@query("agg_corr_pairs", f"WITH {GAME_LOG}, c AS ({union_sql([f'''SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM gl''' for i, a in enumerate(CORR) for b in CORR[i + 1:]])}) SELECT a, b, {q_r6('r')} AS r FROM c WHERE abs(r) >= 6e-1")
def agg_corr_pairs(t):
    return AG.correlated_pairs(t.game_log(), CORR, 0.6)


@query("agg_bias", f"""WITH {EDGE} SELECT 'direction' AS part, CASE WHEN p_final >= 5e-1 THEN 'OVER' ELSE 'UNDER' END AS name, count(*) AS n, {q_r6('avg(p_final)')} AS mean, NULL AS share_under FROM ed GROUP BY 2
UNION ALL SELECT 'overall', 'median', count(*), {q_r6('quantile_cont(p_final, 0.5)')}, {q_r6('avg(CASE WHEN p_final < 5e-1 THEN 1e0 ELSE 0e0 END)')} FROM ed
UNION ALL {union_sql([f"SELECT 'expert', '{e}', count({e}), {q_r6(f'avg({e})')}, {q_r6(f'avg(CASE WHEN {e} < 5e-1 THEN 1e0 WHEN {e} IS NOT NULL THEN 0e0 END)')} FROM ed" for e in EX])}
UNION ALL SELECT 'stat', stat_type, count(*), {q_r6('avg(p_final)')}, {q_r6('avg(CASE WHEN p_final < 5e-1 THEN 1e0 ELSE 0e0 END)')} FROM ed GROUP BY 2
UNION ALL SELECT 'grade', {q_grade('edge')}, count(*), NULL, NULL FROM ed GROUP BY 2""")
def agg_bias(t):
    d = edge_rows(t)
    under = lambda c: X.share(F.col(c) < 0.5)
    none = F.lit(None).cast("double")
    way = d.groupBy(F.when(X.pick_over("p_final"), "OVER").otherwise("UNDER").alias("name")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p_final")).alias("mean")).select(F.lit("direction").alias("part"), "name", "n", "mean", none.alias("share_under"))
    med = exact_quantiles(d, [], "p_final", {"m": 0.5}).withColumn("share_under", r6(d.agg(under("p_final")).scalar())).select(F.lit("overall").alias("part"), F.lit("median").alias("name"), "n", r6("m").alias("mean"), "share_under")
    ex = R.unpivot(d, EX, ["id"]).groupBy(F.col("expert").alias("name")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("mean"), r6(under("p")).alias("share_under")).withColumn("part", F.lit("expert"))
    st = d.groupBy(F.col("stat_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p_final")).alias("mean"), r6(under("p_final")).alias("share_under")).withColumn("part", F.lit("stat"))
    gr = d.groupBy(X.grade("edge").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumns({"part": F.lit("grade"), "mean": none, "share_under": none})
    return way.unionByName(med).unionByName(ex).unionByName(st).unionByName(gr)


# --- stored weights and runs --------------------------------------------------------------------------------------
CW = RESOLVED + f""", cx AS (SELECT *, {Q_CTX} AS ctx FROM rs), wt AS ({union_sql([f"SELECT ctx, '{e}' AS expert, coalesce(avg({q_hit(e, 'over_label')}), 0e0) AS w FROM cx GROUP BY 1" for e in EX])})"""


def weight_state(t):
    """Fitted weights as one JSON map per context key, the way a learner stores them."""
    rows = E.context(t.resolved())
    w = E.accuracy_weights(rows, ["ctx"], EX)
    key = F.to_json(F.split("ctx", r"\|"))
    return w.select(key.alias("context_key"), F.to_json(F.struct(*[F.coalesce(F.col(f"w_{e}"), num(0)).alias(e) for e in EX])).alias("weights"))


def weight_rows(state):
    parts = F.from_json("context_key", "array<string>")
    s = state.withColumn("_k", parts).filter(F.size("_k") == 3)
    return s.select(F.get("_k", 0).alias("stat_type"), F.get("_k", 1).alias("regime"), F.get("_k", 2).alias("neff_bucket"), F.explode(F.from_json("weights", "map<string,double>")).alias("expert", "weight"))


@query("rep_context_weights", f"WITH {CW} SELECT split_part(ctx, '|', 1) AS stat_type, split_part(ctx, '|', 2) AS regime, split_part(ctx, '|', 3) AS neff_bucket, expert, {q_r6('w')} AS weight FROM wt ORDER BY 1, 2, 3, 4")
def rep_context_weights(t):
    return weight_rows(weight_state(t)).withColumn("weight", r6("weight")).orderBy("stat_type", "regime", "neff_bucket", "expert")


@query("agg_weight_summary", f"WITH {CW}, m AS (SELECT expert, avg(w) AS m FROM wt GROUP BY 1) SELECT expert, {q_r6('m')} AS mean_weight, {q_r6('m / sum(m) OVER ()')} AS ratio, m / sum(m) OVER () > 8e-1 AS collapsed FROM m")
def agg_weight_summary(t):
    m = weight_rows(weight_state(t)).groupBy("expert").agg(F.avg("weight").alias("m"))
    ratio = F.col("m") / F.sum("m").over(Window.partitionBy())   # one row per expert
    return m.select("expert", r6("m").alias("mean_weight"), r6(ratio).alias("ratio"), (ratio > 0.8).alias("collapsed"))


MODELS = ["lr", "xgb", "nn_gru_attention", "tabdl"]
RUNS = f"""rn AS (SELECT o_orderkey AS id, o_orderdate AS created_at, ({sql_list(MODELS)})[CAST(o_custkey % 4 + 1 AS INT)] AS model_name, CAST(floor(o_totalprice) AS BIGINT) AS train_rows,
 CASE WHEN o_orderkey % 5 = 0 THEN '{{}}' ELSE '{{"roc_auc":0.' || (40 + o_orderkey % 25) || ',"accuracy":0.' || (45 + o_custkey % 20) || '}}' END AS metrics FROM orders)"""


def runs(t):
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    m = F.when(k % 5 == 0, "{}").otherwise(F.concat(F.lit('{"roc_auc":0.'), text(40 + k % 25), F.lit(',"accuracy":0.'), text(45 + F.col("o_custkey") % 20), F.lit("}")))
    return t.base("orders").select(k.alias("id"), F.col("o_orderdate").alias("created_at"), pick_from(MODELS, F.col("o_custkey") % 4).alias("model_name"), F.floor("o_totalprice").cast("bigint").alias("train_rows"), m.alias("metrics"))


@query("agg_nn_cap", f"""WITH {RUNS}, l AS (SELECT TRY_CAST(metrics->>'$.roc_auc' AS DOUBLE) AS auc FROM rn WHERE model_name = 'nn_gru_attention' AND metrics->>'$.roc_auc' IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 5)
SELECT max(auc) AS best_auc, CASE WHEN max(auc) >= 6e-1 THEN NULL WHEN max(auc) >= 55e-2 THEN 2e-1 ELSE 1e-1 END AS cap FROM l""")
def agg_nn_cap(t):
    auc = C.json_text("metrics", "roc_auc").try_cast("double")
    last = runs(t).filter("model_name = 'nn_gru_attention'").withColumn("auc", auc).filter("auc IS NOT NULL").orderBy(F.desc("created_at"), F.desc("id")).limit(5)
    best = F.max("auc")
    return last.agg(best.alias("best_auc")).withColumn("cap", F.when(F.col("best_auc") >= 0.60, F.lit(None)).when(F.col("best_auc") >= 0.55, num(0.20)).otherwise(num(0.10)))


@query("rep_training_history", f"""WITH {RUNS}, x AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, id DESC) AS rk FROM rn)
SELECT id, model_name, train_rows, TRY_CAST(metrics->>'$.accuracy' AS DOUBLE) AS accuracy, TRY_CAST(metrics->>'$.roc_auc' AS DOUBLE) AS roc_auc, rk = 1 AS is_latest FROM x""")
def rep_training_history(t):
    """All runs with their metrics; the latest per model is found by a map-side maximum, not a window."""
    r = runs(t)
    latest = r.groupBy("model_name").agg(F.max(F.struct("created_at", "id")).alias("m")).select("model_name", F.col("m.id").alias("_l"))
    get = lambda k: C.json_text("metrics", k).try_cast("double")
    return r.join(latest, "model_name").select("id", "model_name", "train_rows", get("accuracy").alias("accuracy"), get("roc_auc").alias("roc_auc"), (F.col("id") == F.col("_l")).alias("is_latest"))


WH = RESOLVED + f""", wh AS (SELECT snapshot_id, max(decision_time) AS seen, {', '.join(f"round(avg({q_hit(e, 'over_label')}), 4) AS {e}" for e in EX)} FROM rs GROUP BY 1), wl AS (SELECT *, row_number() OVER (ORDER BY seen DESC, snapshot_id DESC) AS rn FROM wh)"""


@query("rep_weight_history", f"WITH {WH} {union_sql([f'''SELECT snapshot_id, '{e}' AS expert, {e} AS weight, rn = 1 AS is_latest FROM wl WHERE rn <= 12 AND {e} IS NOT NULL''' for e in EX])}")
def rep_weight_history(t):
    """Weight snapshots as JSON entries: the latest twelve, exploded to one row per expert."""
    entries = t.resolved().groupBy("snapshot_id").agg(F.max("decision_time").alias("seen"), F.to_json(F.struct(*[F.round(F.avg(X.hit(e, "over_label")), 4).alias(e) for e in EX])).alias("entry"))
    last = entries.orderBy(F.desc("seen"), F.desc("snapshot_id")).limit(12)
    newest = Window.partitionBy().orderBy(F.desc("seen"), F.desc("snapshot_id"))   # twelve rows
    last = last.withColumn("is_latest", F.row_number().over(newest) == 1)
    return last.select("snapshot_id", F.explode(F.from_json("entry", "map<string,double>")).alias("expert", "weight"), "is_latest")


# --- health: one row per alert --------------------------------------------------------------------------------------
LATEST = PREDICTIONS + ", lt AS (SELECT *, greatest(p_final, 1e0 - p_final) >= 57e-2 AS pub FROM pr WHERE snapshot_id = (SELECT max(snapshot_id) FROM pr))"


@query("rep_health", f"""WITH {TAIL}, em AS (SELECT expert, avg({q_hit('p', 'over_label')}) AS acc, avg({q_loss('over_label', 'p')}) AS ll, count(*) AS n FROM tl GROUP BY 1), {LATEST[LATEST.index('lt AS'):]},
 cx AS (SELECT *, {Q_CTX} AS ctx FROM rs), {CW[CW.index('wt AS'):]}, wm AS (SELECT expert, avg(w) AS m FROM wt GROUP BY 1),
 ps AS (SELECT max(c) / CAST(sum(c) AS DOUBLE) AS top, sum(c) AS n FROM (SELECT count(*) AS c FROM lt WHERE pub GROUP BY stat_type)),
 rc AS (SELECT snapshot_id, avg(CASE WHEN greatest(p_final, 1e0 - p_final) >= 57e-2 THEN 1e0 ELSE 0e0 END) AS ratio FROM pr GROUP BY 1 ORDER BY 1 DESC LIMIT 2)
SELECT 'low_accuracy' AS alert, expert, {q_r6('acc')} AS value, 48e-2 AS threshold FROM em WHERE acc < 48e-2 AND n >= 50
UNION ALL SELECT 'high_logloss', expert, {q_r6('ll')}, 75e-2 FROM em WHERE ll > 75e-2 AND n >= 50
UNION ALL SELECT 'weight_collapse', expert, {q_r6('m / (SELECT sum(m) FROM wm)')}, 8e-1 FROM wm WHERE m / (SELECT sum(m) FROM wm) > 8e-1
UNION ALL SELECT 'stat_concentration', NULL, {q_r6('top')}, 7e-1 FROM ps WHERE top > 7e-1 AND n >= 50
UNION ALL {union_sql([f"SELECT * FROM (SELECT 'expert_coverage_low', '{e}', {q_r6(f'avg(CASE WHEN {e} IS NULL THEN 0e0 ELSE 1e0 END)')} AS v, 9e-1 FROM lt) WHERE v < 9e-1" for e in EX])}
UNION ALL SELECT * FROM (SELECT 'low_publishable_ratio', NULL, {q_r6('max(ratio)')} AS v, 15e-2 FROM rc HAVING count(*) = 2) WHERE v < 15e-2""")
def rep_health(t):
    tail = R.expert_summary(_tail(t)).filter("n >= 50")
    row = lambda df, name, expert, value, limit: df.select(F.lit(name).alias("alert"), expert.cast("string").alias("expert"), value.alias("value"), num(limit).alias("threshold"))
    none = F.lit(None)
    p = t.predictions().withColumn("publishable", F.greatest(F.col("p_final"), num(1) - F.col("p_final")) >= K.PUBLISH_THRESHOLD)
    last = p.filter(F.col("snapshot_id") == p.agg(F.max("snapshot_id")).scalar())
    cov = AG.coverage(last, EX).unpivot([], EX, "expert", "v")
    top = last.filter("publishable").groupBy("stat_type").agg(F.count(F.lit(1)).alias("c")).agg((F.max("c") / F.sum("c")).alias("top"), F.sum("c").alias("n"))
    ratio = p.groupBy("snapshot_id").agg(X.share(F.col("publishable")).alias("r")).orderBy(F.desc("snapshot_id")).limit(2).agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n"))
    collapse = agg_weight_summary(t).filter("collapsed")
    parts = [
        row(tail.filter(F.col("accuracy") < 0.48), "low_accuracy", F.col("expert"), F.col("accuracy"), 0.48),
        row(tail.filter(F.col("logloss") > 0.75), "high_logloss", F.col("expert"), F.col("logloss"), 0.75),
        row(collapse, "weight_collapse", F.col("expert"), F.col("ratio"), 0.80),
        row(top.filter((F.col("top") > 0.70) & (F.col("n") >= 50)), "stat_concentration", none, r6("top"), 0.70),
        row(cov.filter(F.col("v") < 0.90), "expert_coverage_low", F.col("expert"), r6("v"), 0.90),
        row(ratio.filter((F.col("n") == 2) & (F.col("r") < 0.15)), "low_publishable_ratio", none, r6("r"), 0.15),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
