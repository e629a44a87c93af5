"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.functions import coerce as C
from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions import measures as M
from oddsmill.functions import names as N
from oddsmill.functions.exprs import big, num, r6
from oddsmill.operators import matching as J

from .adapters import GAME_LOG, LINES, LINE_SNAPSHOTS, PREDICTIONS, q_case, q_cdf, q_logit, q_loss, q_pick, q_r6, q_shrink, q_sig, q_sum, sql_list
from .adapters import pick_from
from .registry import query

def r9(x):
    """Products of a six- and a two-decimal number tie at six places, so these keep nine."""
    return F.round(x, 9)


def q_r9(x):
    return f"(round({x}, 9) + 0e0)"


RAW_FLAGS = [" True ", "0", "yes", "No", "maybe", ""]
RAW_NUMBERS = ["12.0", " -3.7", "1e3", "abc", "", "0.5d"]
RAW_DATES = ["2024-01-05T10:00:00", "2024-02-30", "", "1999-12-31", "soon"]


@query("fn_coerce", f"""WITH s AS (SELECT o_orderkey, ({sql_list(RAW_FLAGS)})[CAST(o_orderkey % 6 + 1 AS INT)] AS f,
   CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) || '.0' ELSE ({sql_list(RAW_NUMBERS)})[CAST(o_orderkey % 6 + 1 AS INT)] END AS n,
   ({sql_list(RAW_DATES)})[CAST(o_orderkey % 5 + 1 AS INT)] AS d FROM orders),
 v AS (SELECT *, CASE WHEN regexp_matches(trim(n), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(n) AS DOUBLE) END AS x FROM s)
SELECT o_orderkey, CASE WHEN lower(trim(f)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(f)) IN ('false', '0', 'no') THEN false END AS as_bool,
  x AS as_double, CAST(trunc(x) AS BIGINT) AS as_int,
  CAST(TRY_CAST(CASE WHEN regexp_matches(split_part(d, 'T', 1), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN split_part(d, 'T', 1) END AS DATE) AS VARCHAR) AS as_date,
  CASE WHEN regexp_matches(trim(n), '^[0-9]+[.]0$') THEN regexp_replace(trim(n), '[.]0$', '') ELSE nullif(trim(n), '') END AS as_id FROM v""")
def fn_coerce(t):
    k = F.col("o_orderkey")
    s = t.base("orders").select(
        k, pick_from(RAW_FLAGS, k % 6).alias("f"), pick_from(RAW_DATES, k % 5).alias("d"),
        F.when(k % 4 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).otherwise(pick_from(RAW_NUMBERS, k % 6)).alias("n"))
    return s.select("o_orderkey", C.parse_bool("f").alias("as_bool"), C.parse_double("n").alias("as_double"), C.parse_int("n").alias("as_int"),
                    C.parse_date("d").cast("string").alias("as_date"), C.normalize_id("n").alias("as_id"))


SUFFIX_TAIL = ["", " Jr.", " III", " sr v", " - II"]
_clean = "trim(regexp_replace(lower(regexp_replace(strip_accents(n), '[^a-zA-Z0-9\\s]', ' ', 'g')), '\\s+', ' ', 'g'))"
_bare = "regexp_replace(c, '(^|\\s)(jr|sr|ii|iii|iv|v)(\\s(jr|sr|ii|iii|iv|v))*$', '')"


@query("fn_name_key", f"""WITH s AS (SELECT doc_id, text || ({sql_list(SUFFIX_TAIL)})[CAST(doc_id % 5 + 1 AS INT)] AS n FROM documents
  UNION ALL SELECT 1000000000 + c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'Tristán  Silva' WHEN c_custkey % 9 = 1 THEN 'Jr. II' ELSE c_name || ' Jr' END FROM customer),
c AS (SELECT doc_id, {_clean} AS c FROM s), b AS (SELECT doc_id, {_bare} AS b FROM c)
SELECT doc_id, md5({q_case(K.NAME_OVERRIDES, 'b', 'b')}) AS canonical_md5,
  md5(nullif(regexp_replace({q_case(K.NAME_OVERRIDES, 'b', 'b')}, '[^a-z0-9]', '', 'g'), '')) AS key_md5 FROM b""")
def fn_name_key(t):
    docs = t.base("documents").select("doc_id", F.concat("text", pick_from(SUFFIX_TAIL, F.col("doc_id") % 5)).alias("n"))
    ck = F.col("c_custkey")
    cust = t.base("customer").select(
        (F.lit(1000000000) + ck).alias("doc_id"),
        F.when(ck % 9 == 0, "Tristán  Silva").when(ck % 9 == 1, "Jr. II").otherwise(F.concat("c_name", F.lit(" Jr"))).alias("n"))
    folded = docs.unionByName(cust).withColumn("n", N.fold_marks("n"))
    return folded.select("doc_id", F.md5(N.canonical_name("n", True)).alias("canonical_md5"), F.md5(N.name_key("n", True)).alias("key_md5"))


RAW_TEAMS = ["brk", " gs ", "PHO", "lal", "", "no", "UTAH", "wsh", "MIA", "cho"]


@query("fn_team_abbrev", f"""WITH s AS (SELECT c_custkey, ({sql_list(RAW_TEAMS)})[CAST(c_custkey % 10 + 1 AS INT)] AS a FROM customer), u AS (SELECT c_custkey, nullif(upper(trim(a)), '') AS a FROM s)
SELECT c_custkey, {q_case(K.TEAM_OVERRIDES, 'a', 'a')} AS team, {q_case(K.MARKET_TEAM_OVERRIDES, 'a', 'a')} AS market_team FROM u""")
def fn_team_abbrev(t):
    s = t.base("customer").select("c_custkey", pick_from(RAW_TEAMS, F.col("c_custkey") % 10).alias("a"))
    return s.select("c_custkey", X.team_code("a").alias("team"), X.team_code("a", K.MARKET_TEAM_OVERRIDES).alias("market_team"))


@query("fn_stat_key", "SELECT p_partkey, nullif(regexp_replace(lower(trim(p_type || '+' || p_name)), '[^a-z0-9]', '', 'g'), '') AS stat_key FROM part")
def fn_stat_key(t):
    return t.base("part").select("p_partkey", M.measure_key(F.concat_ws("+", "p_type", "p_name")).alias("stat_key"))


STATS = ["Points", "Pts+Rebs+Asts", "Two Pointers Made", "FG Attempted", "Offensive Rebounds", "Steals", "Turnovers", "Rebs+Asts"]


@query("fn_stat_value", f"""WITH {GAME_LOG}, s AS (SELECT *, ({sql_list(STATS)})[CAST((player_id + day(game_date)) % 8 + 1 AS INT)] AS stat_type FROM gl)
SELECT player_id, CAST(game_date AS VARCHAR) AS game_date, stat_type, {q_r6("""CASE stat_type WHEN 'Points' THEN points WHEN 'Pts+Rebs+Asts' THEN points + rebounds + assists
 WHEN 'Two Pointers Made' THEN fgm - fg3m WHEN 'FG Attempted' THEN fga WHEN 'Offensive Rebounds' THEN oreb WHEN 'Turnovers' THEN turnovers WHEN 'Rebs+Asts' THEN rebounds + assists END""")} AS value FROM s""")
def fn_stat_value(t):
    g = t.game_log().withColumn("stat_type", pick_from(STATS, (F.col("player_id") + F.dayofmonth("game_date")) % 8))
    return g.select("player_id", F.col("game_date").cast("string").alias("game_date"), "stat_type", r6(M.measure_value("stat_type", g.columns)).alias("value"))


@query("fn_logit_sigmoid", f"""WITH {PREDICTIONS} SELECT id, {q_r6(q_logit('p_lr'))} AS logit, {q_r6(q_sig('p_xgb * 20e0 - 10e0'))} AS sigmoid,
 greatest(1e-6, least(1e0 - 1e-6, p_nn)) AS clipped, {q_r6(q_loss('coalesce(over_label, 0)', 'p_lgbm'))} AS loss FROM pr""")
def fn_logit_sigmoid(t):
    return t.predictions().select("id", r6(X.logit("p_lr")).alias("logit"), r6(X.sigmoid(F.col("p_xgb") * 20 - 10)).alias("sigmoid"),
                                  X.clip("p_nn", 1e-6, 1 - 1e-6).alias("clipped"), r6(X.log_loss(F.coalesce("over_label", F.lit(0)), "p_lgbm")).alias("loss"))


_p = f"(1e0 - {q_cdf('(line_score - actual) / greatest(minutes, 5e-1)')})"


@query("fn_normal_prob", f"""WITH {LINES}, n AS (SELECT id, {_p} AS p FROM ln) SELECT id, {q_r6('p')} AS prob_over, {q_r6(q_pick('p'))} AS confidence FROM n""")
def fn_normal_prob(t):
    p = X.prob_over("line_score", "actual", "minutes")
    return t.lines().select("id", p.alias("p")).select("id", r6("p").alias("prob_over"), r6(X.confidence("p")).alias("confidence"))


@query("fn_neff_bucket", f"""WITH {PREDICTIONS}, n AS (SELECT id, stat_type, CASE WHEN id % 11 <> 0 THEN n_eff END AS n_eff FROM pr)
SELECT id, CASE WHEN n_eff IS NULL THEN 'neff_unknown' WHEN n_eff < 5 THEN 'neff_lt5' WHEN n_eff < 15 THEN 'neff_5_15' ELSE 'neff_ge15' END AS bucket,
 stat_type || '|' || CASE WHEN id % 2 = 0 THEN 'live' ELSE 'pregame' END AS context FROM n""")
def fn_neff_bucket(t):
    n = F.when(F.col("id") % 11 != 0, F.col("n_eff"))
    return t.predictions().select("id", X.neff_bucket(n).alias("bucket"), F.concat_ws("|", "stat_type", F.when(F.col("id") % 2 == 0, "live").otherwise("pregame")).alias("context"))


def q_geo(i: int, team: str) -> str:
    return q_case({k: v[i] for k, v in K.TEAM_GEO.items()}, team, "NULL")


def q_haversine(a1, o1, a2, o2):
    h = f"(power(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * power(sin(radians({o2} - {o1}) / 2), 2))"
    return f"(6371e0 * 2 * atan2(sqrt({h}), sqrt(1e0 - {h})))"


def geo(i: int, team):
    return X.lookup({k: float(v[i]) for k, v in K.TEAM_GEO.items()}, team)


@query("fn_haversine", f"""WITH {GAME_LOG}, s AS (SELECT player_id, game_date, CAST({q_geo(0, 'team')} AS DOUBLE) AS a1, CAST({q_geo(1, 'team')} AS DOUBLE) AS o1, CAST({q_geo(0, 'opp')} AS DOUBLE) AS a2, CAST({q_geo(1, 'opp')} AS DOUBLE) AS o2 FROM gl)
SELECT player_id, CAST(game_date AS VARCHAR) AS game_date, {q_r6(q_haversine('a1', 'o1', 'a2', 'o2'))} AS km FROM s""")
def fn_haversine(t):
    g = t.game_log()
    km = X.haversine_km(geo(0, F.col("team")), geo(1, F.col("team")), geo(0, F.col("opp")), geo(1, F.col("opp")))
    return g.select("player_id", F.col("game_date").cast("string").alias("game_date"), r6(km).alias("km"))


@query("fn_season", """SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0')
   ELSE (year(o_orderdate) - 1) || '-' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') END AS season,
  CAST(CAST(((o_orderdate + to_hours(o_orderkey % 24)) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS VARCHAR) AS et_date FROM orders""")
def fn_season(t):
    o = t.base("orders")
    at = (F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_orderkey") % 24)).cast("timestamp")
    return o.select("o_orderkey", season_label(F.col("o_orderdate")).alias("season"), J.eastern_date(at).cast("string").alias("et_date"))


def season_label(day):
    """Season that starts in October, as '2023-24'."""
    start = F.year(day) - F.when(F.month(day) >= 10, 0).otherwise(1)
    return F.concat_ws("-", start.cast("string"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


@query("fn_json_get", """SELECT event_id, TRY_CAST(nullif(props->>'$.k', '') AS BIGINT) AS k, coalesce(nullif(props->>'$.missing', ''), 'none') AS missing FROM events""")
def fn_json_get(t):
    return t.base("events").select("event_id", C.json_text("props", "k").try_cast("bigint").alias("k"), F.coalesce(C.json_text("props", "missing"), F.lit("none")).alias("missing"))


@query("fn_line_feats", f"""WITH {LINES}, z AS (SELECT id, line_score, CASE WHEN id % 5 <> 0 THEN actual - line_score END AS delta, CASE WHEN id % 7 <> 0 THEN CAST(id % 500 AS DOUBLE) END AS mins, actual AS opp, minutes AS lm FROM ln)
SELECT id, {q_r6('CASE WHEN line_score > 0 THEN coalesce(delta, 0e0) / line_score ELSE 0e0 END')} AS line_move_pct,
 {q_r6('abs(coalesce(delta, 0e0)) * greatest(0e0, least(1e0, 1e0 - coalesce(mins, 360e0) / 360e0))')} AS line_move_late,
 {q_r6('line_score - opp')} AS line_vs_opp_def, {q_r6('CASE WHEN lm > 0 THEN opp / lm ELSE 1e0 END')} AS opp_def_ratio FROM z""")
def fn_line_feats(t):
    z = t.lines().select("id", "line_score", F.when(F.col("id") % 5 != 0, F.col("actual") - F.col("line_score")).alias("delta"),
                         F.when(F.col("id") % 7 != 0, (F.col("id") % 500).cast("double")).alias("mins"), F.col("actual").alias("opp"), F.col("minutes").alias("lm"))
    return z.select("id", *[r6(v).alias(k) for k, v in line_features("line_score", "delta", "mins", "opp", "lm").items()])


def line_features(line, delta, minutes, opp, league):
    d = F.coalesce(F.col(delta), num(0))
    near = X.clip(num(1) - F.coalesce(F.col(minutes), num(360)) / num(360), 0.0, 1.0)
    return {
        "line_move_pct": F.when(F.col(line) > 0, d / F.col(line)).otherwise(num(0)), "line_move_late": F.abs(d) * near,
        "line_vs_opp_def": F.col(line) - F.coalesce(F.col(opp), num(0)),
        "opp_def_ratio": F.when(F.col(league) > 0, F.coalesce(F.col(opp), num(0)) / F.col(league)).otherwise(num(1)),
    }


@query("fn_usage", f"""WITH {GAME_LOG}, t AS (SELECT team, game_date, sum(fga) AS tfga, sum(fta) AS tfta, sum(turnovers) AS tto FROM gl GROUP BY 1, 2)
SELECT gl.player_id, CAST(gl.game_date AS VARCHAR) AS game_date, {q_r6('CASE WHEN tfga + 44e-2 * tfta + tto = 0 THEN 0e0 ELSE (fga + 44e-2 * fta + turnovers) / (tfga + 44e-2 * tfta + tto) END')} AS usage
FROM gl JOIN t ON gl.team = t.team AND gl.game_date = t.game_date""")
def fn_usage(t):
    g = t.game_log()
    team = g.groupBy("team", "game_date").agg(F.sum("fga").alias("tfga"), F.sum("fta").alias("tfta"), F.sum("turnovers").alias("tto"))
    return g.join(team, ["team", "game_date"]).select("player_id", F.col("game_date").cast("string").alias("game_date"),
                                                        r6(usage("fga", "fta", "turnovers", "tfga", "tfta", "tto")).alias("usage"))


def usage(fga, fta, to, tfga, tfta, tto):
    part, whole = [X.c(a) + num(0.44) * X.c(b) + X.c(d) for a, b, d in [(fga, fta, to), (tfga, tfta, tto)]]
    return F.when(whole == 0, num(0)).otherwise(part / whole)


@query("fn_shrink", f"WITH {PREDICTIONS} SELECT id, {q_r6(q_shrink('p_lr', 'n_eff', 'CASE WHEN id % 5 <> 0 THEN p_xgb END'))} AS p FROM pr")
def fn_shrink(t):
    return t.predictions().select("id", r6(X.shrink("p_lr", "n_eff", F.when(F.col("id") % 5 != 0, F.col("p_xgb")))).alias("p"))


def q_edge(p, experts, size, n, mu, line, s):
    gap = f"abs({mu} - {line})"
    m = q_sum([f"CASE WHEN {e} IS NULL THEN 0 ELSE 1 END" for e in experts])
    same = q_sum([f"CASE WHEN {e} IS NOT NULL AND ({e} >= 5e-1) = ({p} >= 5e-1) THEN 1 ELSE 0 END" for e in experts])
    ag = f"(CAST({same} AS DOUBLE) / {m})"
    cf = q_pick(p)
    return f"""round(greatest(0e0, least(100e0,
  CASE WHEN {mu} IS NULL OR {line} IS NULL THEN 0e0 WHEN {gap} <= 1 THEN {gap} * 8e0 WHEN {gap} <= 3 THEN 8e0 + ({gap} - 1e0) / 2e0 * 17e0
    WHEN {gap} <= 4 THEN 25e0 - ({gap} - 3e0) * 15e0 ELSE greatest(0e0, 10e0 - ({gap} - 4e0) * 5e0) END
  + CASE WHEN {n} IS NULL OR {n} < 5 THEN 0e0 WHEN {n} < 10 THEN ({n} - 5) / 5e0 * 8e0 WHEN {n} <= 20 THEN 20e0 WHEN {n} <= 30 THEN 20e0 - ({n} - 20) / 10e0 * 5e0 ELSE 15e0 END
  + CASE WHEN {m} < 2 THEN 0e0 WHEN {ag} <= 5e-1 THEN 25e0 WHEN {ag} <= 67e-2 THEN 25e0 - ({ag} - 5e-1) / 17e-2 * 10e0 WHEN {ag} <= 84e-2 THEN 15e0 - ({ag} - 67e-2) / 17e-2 * 5e0 ELSE 10e0 - ({ag} - 84e-2) / 16e-2 * 5e0 END
  + CASE WHEN {cf} <= 55e-2 THEN ({cf} - 5e-1) / 5e-2 * 5e0 WHEN {cf} <= 65e-2 THEN 5e0 + ({cf} - 55e-2) / 1e-1 * 10e0 WHEN {cf} <= 75e-2 THEN 15e0 - ({cf} - 65e-2) / 1e-1 * 10e0 ELSE greatest(0e0, 5e0 - ({cf} - 75e-2) / 25e-2 * 5e0) END
  + CASE WHEN {s} IS NULL THEN 0e0 WHEN {s} <= 2 THEN {s} / 2e0 * 4e0 WHEN {s} <= 6 THEN 4e0 + ({s} - 2) / 4e0 * 6e0 WHEN {s} <= 8 THEN 10e0 - ({s} - 6) / 2e0 * 4e0 ELSE greatest(0e0, 6e0 - ({s} - 8)) END
  + CASE WHEN {size} = 1 THEN 5e0 ELSE 0e0 END)), 1)"""


def q_grade(e):
    return f"CASE WHEN {e} >= 75 THEN 'A+' WHEN {e} >= 60 THEN 'A' WHEN {e} >= 45 THEN 'B' WHEN {e} >= 30 THEN 'C' WHEN {e} >= 18 THEN 'D' ELSE 'F' END"


EDGE = PREDICTIONS + f""", ed AS (SELECT *, {q_edge('p_final', K.EXPERTS, 'conformal_set_size', 'n_eff', '(line_score + (id % 13) / 2e0 - 3)', 'line_score', '(id % 19) / 2e0')} AS edge FROM pr)"""


def edge_rows(t):
    mu = F.col("line_score") + (F.col("id") % 13) / num(2) - 3
    return X.with_edge(t.predictions(), "p_final", K.EXPERTS, "conformal_set_size", "n_eff", mu, "line_score", (F.col("id") % 19) / num(2))


@query("fn_edge_score", f"WITH {EDGE} SELECT id, edge FROM ed")
def fn_edge_score(t):
    return edge_rows(t).select("id", "edge")


@query("fn_grade", f"WITH {EDGE} SELECT {q_grade('edge')} AS grade, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM ed GROUP BY 1")
def fn_grade(t):
    return edge_rows(t).groupBy(X.grade("edge").alias("grade")).agg(F.count(F.lit(1)).alias("n"), big(F.sum("id")).alias("id_sum"))


STATUS = ["raw", "fallback_global", "per_stat"]


@query("fn_risk_adj", f"""WITH {PREDICTIONS}, s AS (SELECT *, ({sql_list(STATUS)})[CAST(id % 3 + 1 AS INT)] AS st FROM pr),
r AS (SELECT id, p_final, st, CASE WHEN n_eff < 5 THEN 65e-2 ELSE 85e-2 END AS rho FROM s)
SELECT id, {q_r9("5e-1 + CASE st WHEN 'raw' THEN least(rho, 6e-1) WHEN 'fallback_global' THEN least(rho, 75e-2) ELSE rho END * (" + q_pick('p_final') + " - 5e-1)")} AS confidence FROM r""")
def fn_risk_adj(t):
    return t.predictions().select("id", r9(X.risk_adjusted("p_final", "n_eff", pick_from(STATUS, F.col("id") % 3))).alias("confidence"))


@query("fn_ev_rank", f"""WITH {PREDICTIONS}, o AS (SELECT id, {q_pick('p_final')} AS p, 15e-1 + (id % 100) / 100e0 AS odds FROM pr)
SELECT id, {q_r9('p - 1e0 / odds')} AS edge_over_breakeven, {q_r9('p * odds - 1e0')} AS ev FROM o""")
def fn_ev_rank(t):
    odds = num(1.5) + (F.col("id") % 100) / num(100)
    p = X.p_pick("p_final")
    return t.predictions().select("id", r9(p - num(1) / odds).alias("edge_over_breakeven"), r9(p * odds - num(1)).alias("ev"))


@query("fn_clip_experts", f"""WITH {PREDICTIONS} SELECT id, {', '.join(f'CASE WHEN {e} IS NOT NULL THEN greatest(25e-2, least(75e-2, {e})) END AS {e}' for e in K.EXPERTS)} FROM pr""")
def fn_clip_experts(t):
    return t.predictions().select("id", *[X.clip_expert(e).alias(e) for e in K.EXPERTS])
