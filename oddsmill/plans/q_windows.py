"""History, opponent, pace, travel and market features."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, num, r6
from oddsmill.operators import asof as A
from oddsmill.operators import context as CX
from oddsmill.operators import history as H
from oddsmill.operators import matching as J
from oddsmill.operators.aggregates import long_log
from oddsmill.session import merged

from .adapters import GAME_LOG, LINES, LINE_SNAPSHOTS, MARKET, MARKET_PROBES, MEASURE_COLS, MEASURES, TEAM_GAMES, q_case, q_r6, union_sql
from .q_scalar import q_geo, q_haversine, q_r9, r9, usage
from .registry import query

LONG = dict(zip(MEASURE_COLS, MEASURES))
LONG_SQL = ", lg AS (" + union_sql([f"SELECT player_id, game_date, minutes, '{n}' AS stat_type, {c} AS value FROM gl" for c, n in LONG.items()]) + ")"
# every (line, earlier log row) pair, newest first
HIST = LINES + LONG_SQL + """,
hp AS (SELECT l.id, l.player_id, l.stat_type, l.line_score, l.slate, g.game_date, g.value AS v, g.minutes AS mi, row_number() OVER (PARTITION BY l.id ORDER BY g.game_date DESC) AS rn
  FROM ln l LEFT JOIN lg g ON g.player_id = l.player_id AND g.stat_type = l.stat_type AND g.game_date < l.slate)"""


def logs(t):
    return long_log(t.game_log(), LONG)


def probes(t):
    return t.lines().select("id", "player_id", "stat_type", "slate", "line_score")


def days(t):
    return H.day_features(logs(t), probes(t))


def out(t, columns):
    """Per-line columns of the day-level features."""
    joined = H.attach(probes(t), days(t).select(*H.KEYS, "_cut", *columns))
    return joined.select("id", *[r6(c).alias(c) for c in columns])


_n, _mean = "count(v)", "coalesce(avg(v), 0e0)"
BASE = HIST + f""", hb AS (SELECT id, stat_type, line_score, slate, count(v) AS n, coalesce(avg(v), 0e0) AS hist_mean, CASE WHEN count(v) > 1 THEN stddev_pop(v) ELSE 1e0 END AS hist_std,
  count(CASE WHEN v > line_score THEN 1 END) AS wins, max(game_date) AS last_day FROM hp GROUP BY 1, 2, 3, 4)"""


@query("win_hist_base", f"WITH {BASE} SELECT id, n, {q_r6('hist_mean')} AS hist_mean, {q_r6('hist_std')} AS hist_std, wins, {q_r6('(wins + 1e0) / (n + 2e0)')} AS p_hist_over FROM hb")
def win_hist_base(t):
    l, log = probes(t), logs(t)
    d = H.attach(l, days(t).select(*H.KEYS, "_cut", "n", "hist_mean", "hist_std"))
    w = H.line_wins(log, l).withColumnRenamed("_cut", "slate")
    return d.join(merged(w), [*H.KEYS, "slate", "line_score"], "left").select(
        "id", big("n").alias("n"), r6("hist_mean").alias("hist_mean"), r6("hist_std").alias("hist_std"), big("wins").alias("wins"),
        r6((F.col("wins") + num(1)) / (F.col("n") + num(2))).alias("p_hist_over"))


@query("win_hist_rest", f"""WITH {BASE} SELECT id, CAST(coalesce(greatest(date_diff('day', last_day, slate) - 1, 0), 0) AS DOUBLE) AS rest_days,
 CASE WHEN last_day IS NOT NULL AND greatest(date_diff('day', last_day, slate) - 1, 0) = 0 THEN 1e0 ELSE 0e0 END AS is_back_to_back FROM hb""")
def win_hist_rest(t):
    return out(t, ["rest_days", "is_back_to_back"])


LEAGUE = """, ld AS (SELECT stat_type, game_date, sum(value) AS s, count(*) AS c FROM lg GROUP BY 1, 2),
lc AS (SELECT d.slate, m.stat_type, coalesce((SELECT sum(s) / sum(c) FROM ld WHERE ld.stat_type = m.stat_type AND ld.game_date < d.slate), 0e0) AS league_mean
  FROM (SELECT DISTINCT slate FROM ln) d, (SELECT DISTINCT stat_type FROM ln) m)"""
_k = q_case(K.STABILIZATION_GAMES, "hb.stat_type", "10e0")
STAB = BASE + LEAGUE + f""", st AS (SELECT hb.*, league_mean, (n * hist_mean + {_k} * league_mean) / (n + {_k}) AS mu_stab FROM hb JOIN lc ON lc.slate = hb.slate AND lc.stat_type = hb.stat_type)"""


@query("win_hist_stab", f"""WITH {STAB} SELECT id, {q_r9('league_mean')} AS league_mean, {q_r9('mu_stab')} AS mu_stab, {q_r6('greatest(-10e0, least(10e0, (line_score - mu_stab) / (hist_std + 1e-6)))')} AS z_line,
 {q_r9('mu_stab - line_score')} AS forecast_edge FROM st""")
def win_hist_stab(t):
    d = H.attach(probes(t), days(t).select(*H.KEYS, "_cut", "n", "hist_mean", "hist_std"))
    s = H.stabilised(A.attach_prior(d, H.league_prior(logs(t), probes(t)), ["stat_type"], "slate"))
    return s.select("id", r6("z_line").alias("z_line"), *[r9(F.col(c)).alias(c) for c in ("league_mean", "mu_stab", "forecast_edge")])


_avg = lambda c, k: f"coalesce(avg(CASE WHEN rn <= {k} THEN {c} END), 0e0)"


@query("win_hist_roll", f"WITH {HIST} SELECT id, {', '.join(f'{q_r6(_avg(c, k))} AS {n}_mean_{k}' for c, n in [('v', 'stat'), ('mi', 'minutes')] for k in (3, 5, 10))} FROM hp GROUP BY id")
def win_hist_roll(t):
    return out(t, [f"{n}_mean_{k}" for n in ("stat", "minutes") for k in (3, 5, 10)])


@query("win_hist_trend", f"WITH {HIST} SELECT id, {q_r6('CASE WHEN count(v) >= 3 THEN regr_slope(CASE WHEN rn <= 10 THEN v END, CAST(-rn AS DOUBLE)) ELSE 0e0 END')} AS trend_slope FROM hp GROUP BY id")
def win_hist_trend(t):
    return out(t, ["trend_slope"])


DISP = HIST + f""", dd AS (SELECT id, count(v) AS n, coalesce(avg(v), 0e0) AS mu, CASE WHEN count(v) > 1 THEN stddev_pop(v) ELSE 1e0 END AS sd, CASE WHEN count(v) >= 2 THEN stddev_pop(CASE WHEN rn <= 5 THEN v END) ELSE 0e0 END AS s5,
  CASE WHEN count(v) >= 2 THEN stddev_pop(CASE WHEN rn <= 10 THEN mi END) ELSE 0e0 END AS m10, coalesce(sum(CASE WHEN rn <= 3 THEN mi END), 0e0) AS load3 FROM hp GROUP BY id)"""


@query("win_hist_disp", f"""WITH {DISP} SELECT id, {q_r6('CASE WHEN n >= 3 AND mu > 0 THEN sd / mu ELSE 0e0 END')} AS stat_cv, {q_r6('s5')} AS stat_std_5, {q_r6('m10')} AS minutes_std_10, load3 AS recent_load_3, {q_r6('1e0 / (1e0 + m10)')} AS role_stability FROM dd""")
def win_hist_disp(t):
    return out(t, ["stat_cv", "stat_std_5", "minutes_std_10", "recent_load_3", "role_stability"])


@query("win_hist_ratio", f"""WITH {HIST}, r AS (SELECT id, line_score, {_mean} AS mu, {', '.join(f'{_avg(c, k)} AS {c}{k}' for c in ('v', 'mi') for k in (3, 5, 10))} FROM hp GROUP BY 1, 2)
SELECT id, {q_r6('CASE WHEN mu > 0 AND v3 > 0 THEN v3 / mu ELSE 1e0 END')} AS recent_vs_season, {q_r6('CASE WHEN mi10 > 0 AND mi3 > 0 THEN mi3 / mi10 ELSE 1e0 END')} AS minutes_trend,
 {q_r6('CASE WHEN v5 > 0 AND mi5 > 0 THEN v5 / mi5 ELSE 0e0 END')} AS stat_rate_per_min, {q_r6('CASE WHEN mu > 0 THEN line_score / mu ELSE 1e0 END')} AS line_vs_mean_ratio FROM r""")
def win_hist_ratio(t):
    d = H.attach(probes(t), days(t).select(*H.KEYS, "_cut", "hist_mean", "recent_vs_season", "minutes_trend", "stat_rate_per_min"))
    ratio = F.when(F.col("hist_mean") > 0, F.col("line_score") / F.col("hist_mean")).otherwise(num(1))
    return d.select("id", *[r6(c).alias(c) for c in ("recent_vs_season", "minutes_trend", "stat_rate_per_min")], r6(ratio).alias("line_vs_mean_ratio"))


@query("win_hist_streak", f"""WITH {HIST}, m AS (SELECT *, avg(v) OVER (PARTITION BY id) AS mu, count(v) OVER (PARTITION BY id) AS n FROM hp),
s AS (SELECT id, max(n) AS n, max(mu) AS mu, min(CASE WHEN v <= mu THEN rn END) AS stop_hot, min(CASE WHEN v > mu THEN rn END) AS stop_cold FROM m GROUP BY id)
SELECT id, CAST(CASE WHEN n > 0 AND mu > 0 THEN coalesce(stop_hot - 1, n) ELSE 0 END AS DOUBLE) AS hot_streak_count, CAST(CASE WHEN n > 0 AND mu > 0 THEN coalesce(stop_cold - 1, n) ELSE 0 END AS DOUBLE) AS cold_streak_count FROM s""")
def win_hist_streak(t):
    log = logs(t)
    joined = H.attach(probes(t), H.streaks(log, days(t)))
    return joined.select("id", "hot_streak_count", "cold_streak_count")


@query("win_hist_seq", f"""WITH {HIST} SELECT l.id, g.range AS pos, coalesce(v, 0e0) AS value, coalesce(mi, 0e0) AS minutes FROM ln l CROSS JOIN range(10) g LEFT JOIN hp ON hp.id = l.id AND hp.rn = 10 - g.range AND hp.v IS NOT NULL""")
def win_hist_seq(t):
    d = days(t)
    s = d.select(*H.KEYS, "_cut", H.sequence(d).alias("seq"))
    j = H.attach(probes(t), s)
    return j.select("id", F.posexplode("seq").alias("pos", "e")).select("id", big("pos").alias("pos"), "e.value", "e.minutes")


@query("win_league_timeline", f"""WITH {GAME_LOG}{LONG_SQL}, d AS (SELECT stat_type, game_date, sum(value) AS s, count(*) AS c FROM lg GROUP BY 1, 2)
SELECT stat_type, CAST(game_date AS VARCHAR) AS game_date, {q_r6('coalesce(sum(s) OVER w / sum(c) OVER w, 0e0)')} AS mean_before, CAST(coalesce(sum(c) OVER w, 0) AS BIGINT) AS n_before FROM d
WINDOW w AS (PARTITION BY stat_type ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def win_league_timeline(t):
    from pyspark.sql import Window

    d = logs(t).groupBy("stat_type", "game_date").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("stat_type").orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)   # one row per day
    return d.select("stat_type", F.col("game_date").cast("string").alias("game_date"), r6(F.coalesce(F.sum("s").over(w) / F.sum("c").over(w), num(0))).alias("mean_before"),
                    F.coalesce(F.sum("c").over(w), F.lit(0)).alias("n_before"))


_roll = lambda x, key: f"CASE WHEN count({x}) OVER (PARTITION BY {key} ORDER BY game_date ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) >= 3 THEN avg({x}) OVER (PARTITION BY {key} ORDER BY game_date ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) END"
TEAM = TEAM_GAMES + f""", tp AS (SELECT team, game_date, {_roll('(fga - oreb + turnovers + 44e-2 * fta)', 'team')} AS team_pace FROM tg),
od AS (SELECT opp AS team, game_date, {', '.join(f"{_roll(m, 'opp')} AS opp_def_{m}" for m in CX.ALLOWED)} FROM tg)"""
_date = "CAST(game_date AS VARCHAR) AS game_date"


def s_date(df, c="game_date"):
    return df.withColumn(c, F.col(c).cast("string"))


@query("win_team_pace", f"WITH {TEAM} SELECT team, {_date}, {q_r6('team_pace')} AS team_pace FROM tp")
def win_team_pace(t):
    return s_date(CX.team_pace(t.team_games())).withColumn("team_pace", r6("team_pace"))


@query("win_opp_def", f"WITH {TEAM} SELECT team, {_date}, {', '.join(f'{q_r6(f'opp_def_{m}')} AS opp_def_{m}' for m in CX.ALLOWED)} FROM od")
def win_opp_def(t):
    return s_date(CX.allowed(t.team_games())).withColumns({f"opp_def_{m}": r6(f"opp_def_{m}") for m in CX.ALLOWED})


RANKS = TEAM + f""", lt AS (SELECT d.slate, o.team, o.game_date AS gd, {', '.join(f'opp_def_{m}' for m in CX.RANKED)}, row_number() OVER (PARTITION BY d.slate, o.team ORDER BY o.game_date DESC) AS rn
  FROM (SELECT DISTINCT game_date AS slate FROM gl) d JOIN od o ON o.game_date < d.slate),
rk AS ({union_sql([f"SELECT slate, team, 'opp_def_{m}' AS measure, row_number() OVER (PARTITION BY slate ORDER BY opp_def_{m}, team) AS rank FROM lt WHERE rn = 1 AND opp_def_{m} IS NOT NULL" for m in CX.RANKED])}),
ll AS (SELECT team, {', '.join(f'max_by(coalesce(opp_def_{m}, -1e0), game_date) AS opp_def_{m}' for m in CX.RANKED)} FROM od GROUP BY team)"""


@query("win_opp_rank", f"""WITH {RANKS} SELECT CAST(slate AS VARCHAR) AS as_of, team, measure, rank FROM rk UNION ALL
 {union_sql([f"SELECT 'latest', team, 'opp_def_{m}', row_number() OVER (ORDER BY opp_def_{m}, team) FROM ll WHERE opp_def_{m} >= 0" for m in CX.RANKED])}""")
def win_opp_rank(t):
    defence = CX.allowed(t.team_games())
    cols = [f"opp_def_{m}" for m in CX.RANKED]
    dated = CX.ranks_as_of(defence, t.game_log().select(F.col("game_date").alias("_cut")).distinct(), cols)
    now = CX.latest_ranks(defence, cols)
    return dated.select(F.col("_cut").cast("string").alias("as_of"), "team", "measure", big("rank").alias("rank")).unionByName(
        now.select(F.lit("latest").alias("as_of"), "team", "measure", big("rank").alias("rank")))


OPP = RANKS + """, pl AS (SELECT DISTINCT player_id, team, opp, game_date AS slate FROM gl),
oj AS (SELECT pl.player_id, pl.team, pl.opp, pl.slate, lt.opp_def_points, lt.opp_def_rebounds, lt.opp_def_assists, lt.opp_def_turnovers, tg.is_home
  FROM pl LEFT JOIN lt ON lt.slate = pl.slate AND lt.team = pl.opp AND lt.rn = 1 LEFT JOIN tg ON tg.team = pl.team AND tg.game_date = pl.slate)"""
_own = {n: f"opp_def_{c}" for c, n in LONG.items()}


@query("win_opp_features", f"""WITH {OPP}, m AS ({union_sql([f"SELECT oj.*, '{n}' AS stat_type, {c} AS own, '{c}' AS measure FROM oj" for n, c in _own.items()])})
SELECT m.player_id, CAST(m.slate AS VARCHAR) AS slate, stat_type, CASE WHEN m.player_id % 17 = 0 THEN 5e-1 ELSE CAST(is_home AS DOUBLE) END AS is_home, {q_r6('coalesce(own, 0e0)')} AS opp_def_stat_avg,
 {', '.join(f'{q_r6(f"coalesce(opp_def_{c}, 0e0)")} AS opp_def_{c}_avg' for c in ('points', 'rebounds', 'assists'))}, CAST(coalesce(rank, 15) AS DOUBLE) AS opp_def_rank
FROM m LEFT JOIN rk ON rk.slate = m.slate AND rk.team = m.opp AND rk.measure = m.measure""")
def win_opp_features(t):
    games, g = t.team_games(), t.game_log().select("player_id", "team", "opp", F.col("game_date").alias("slate"))
    return opponent_features(games, g)


def opponent_features(games, rows):
    """Home flag, allowed averages, the measure's own average and the rank, per (player, day, measure)."""
    defence = CX.allowed(games)
    cols = [f"opp_def_{m}" for m in CX.RANKED]
    probe = rows.select(F.col("opp").alias("team"), F.col("slate").alias("cutoff"))
    latest = CX.latest_before(defence, probe, "cutoff", cols).withColumnsRenamed({"team": "opp", "_cut": "slate"})
    ranks = CX.ranks_as_of(defence, rows.select(F.col("slate").alias("_cut")).distinct(), cols).withColumnsRenamed({"team": "opp", "_cut": "slate"})
    home = games.select("team", F.col("game_date").alias("slate"), F.col("is_home").alias("_home"))
    j = rows.join(latest, ["opp", "slate"], "left").join(home, ["team", "slate"], "left")
    legs = F.explode(F.array(*[F.struct(F.lit(n).alias("stat_type"), F.lit(c).alias("measure"), F.col(c).alias("own")) for n, c in _own.items()]))
    long = j.withColumn("_l", legs).select("player_id", "slate", "opp", "_home", "_l.*", *cols)
    long = long.join(ranks, ["opp", "slate", "measure"], "left")
    zero = lambda c: r6(F.coalesce(F.col(c), num(0)))
    return long.select("player_id", F.col("slate").cast("string").alias("slate"), "stat_type",
                       F.when((F.col("player_id") % 17 == 0) | F.col("_home").isNull(), num(0.5)).otherwise(F.col("_home").cast("double")).alias("is_home"),
                       zero("own").alias("opp_def_stat_avg"), *[zero(f"opp_def_{c}").alias(f"opp_def_{c}_avg") for c in ("points", "rebounds", "assists")],
                       F.coalesce(F.col("rank"), F.lit(15)).cast("double").alias("opp_def_rank"))


_means = lambda cols: ", ".join(f"coalesce(avg({c}), 0e0) AS m_{c}" for c in cols)
PACE = TEAM + f""", pl AS (SELECT player_id, team, opp, game_date AS slate FROM gl),
lp AS (SELECT p.slate, p.team, (SELECT max_by(coalesce(team_pace, 0e0), game_date) FROM tp WHERE tp.team = p.team AND tp.game_date < p.slate) AS pace FROM (SELECT DISTINCT slate, t.team FROM pl, (SELECT DISTINCT team FROM tg) t) p),
po AS (SELECT player_id, slate, {_means(['fga', 'fta', 'turnovers'])} FROM (SELECT p.player_id, p.slate, g.fga, g.fta, g.turnovers, row_number() OVER (PARTITION BY p.player_id, p.slate ORDER BY g.game_date DESC) AS rn FROM pl p JOIN gl g ON g.player_id = p.player_id AND g.game_date < p.slate) WHERE rn <= 10 GROUP BY 1, 2),
tm AS (SELECT team, slate, {_means(['fga', 'fta', 'turnovers'])} FROM (SELECT p.team, p.slate, g.fga, g.fta, g.turnovers, row_number() OVER (PARTITION BY p.team, p.slate ORDER BY g.game_date DESC) AS rn FROM (SELECT DISTINCT team, slate FROM pl) p JOIN tg g ON g.team = p.team AND g.game_date < p.slate) WHERE rn <= 10 GROUP BY 1, 2)"""


@query("win_pace_usage", f"""WITH {PACE}, z AS (SELECT pl.player_id, pl.slate, coalesce(a.pace, 0e0) AS tp, coalesce(b.pace, 0e0) AS op, po.m_fga AS pf, po.m_fta AS pt, po.m_turnovers AS pz, tm.m_fga AS tf, tm.m_fta AS tt, tm.m_turnovers AS tz
 FROM pl LEFT JOIN lp a ON a.team = pl.team AND a.slate = pl.slate LEFT JOIN lp b ON b.team = pl.opp AND b.slate = pl.slate LEFT JOIN po ON po.player_id = pl.player_id AND po.slate = pl.slate LEFT JOIN tm ON tm.team = pl.team AND tm.slate = pl.slate)
SELECT player_id, CAST(slate AS VARCHAR) AS slate, {q_r6('tp')} AS team_pace, {q_r6('op')} AS opp_pace, {q_r6('CASE WHEN tp <> 0 AND op <> 0 THEN (tp + op) / 2e0 WHEN tp <> 0 THEN tp ELSE op END')} AS game_pace,
 {q_r6('CASE WHEN pf IS NULL OR tf IS NULL OR tf + 44e-2 * tt + tz = 0 THEN 0e0 ELSE (pf + 44e-2 * pt + pz) / (tf + 44e-2 * tt + tz) END')} AS player_usage FROM z""")
def win_pace_usage(t):
    return pace_usage(t.game_log(), t.team_games())


def tail_means(df, key, cols, k=10):
    """Mean of the last k rows of a series up to and including each row."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("game_date").rowsBetween(-(k - 1), 0)
    return df.select(key, "game_date", *[F.avg(c).over(w).alias(c) for c in cols])


def pace_usage(log, games):
    cols = ["fga", "fta", "turnovers"]
    rows = log.select("player_id", "team", "opp", F.col("game_date").alias("slate"))
    pace = CX.team_pace(games)
    sides = rows.select("team", "slate").unionByName(rows.select(F.col("opp").alias("team"), "slate"))
    latest = CX.latest_before(pace, sides, "slate", ["team_pace"]).withColumnRenamed("_cut", "slate")
    own = CX.latest_before(tail_means(log, "player_id", cols), rows, "slate", cols, "player_id").withColumnsRenamed({"_cut": "slate", **{c: f"p_{c}" for c in cols}})
    team = CX.latest_before(tail_means(games, "team", cols), rows, "slate", cols).withColumnsRenamed({"_cut": "slate", **{c: f"t_{c}" for c in cols}})
    opp = latest.withColumnsRenamed({"team": "opp", "team_pace": "opp_pace"})
    j = rows.join(latest, ["team", "slate"], "left").join(opp, ["opp", "slate"], "left").join(merged(own), ["player_id", "slate"], "left").join(team, ["team", "slate"], "left")
    tp, op = F.coalesce("team_pace", num(0)), F.coalesce("opp_pace", num(0))
    return j.select("player_id", F.col("slate").cast("string").alias("slate"), r6(tp).alias("team_pace"), r6(op).alias("opp_pace"),
                    r6(F.when((tp != 0) & (op != 0), (tp + op) / num(2)).when(tp != 0, tp).otherwise(op)).alias("game_pace"),
                    r6(F.coalesce(usage("p_fga", "p_fta", "p_turnovers", "t_fga", "t_fta", "t_turnovers"), num(0))).alias("player_usage"))


_at = lambda i: f"CAST({q_geo(i, 'CASE WHEN is_home = 1 THEN team ELSE opp END')} AS DOUBLE)"
TRAVEL = TEAM_GAMES + f""", v AS (SELECT team, game_date, {_at(0)} AS la, {_at(1)} AS lo, {_at(2)} AS tz FROM tg),
lv AS (SELECT *, lag(la) OVER w AS pla, lag(lo) OVER w AS plo, lag(tz) OVER w AS ptz FROM v WINDOW w AS (PARTITION BY team ORDER BY game_date)),
lk AS (SELECT team, game_date, {q_haversine('pla', 'plo', 'la', 'lo')} AS km, abs(tz - ptz) AS sh FROM lv)"""


@query("win_travel", f"""WITH {TRAVEL}, p AS (SELECT DISTINCT team, game_date AS slate FROM gl), j AS (SELECT p.team, p.slate, km, sh, row_number() OVER (PARTITION BY p.team, p.slate ORDER BY lk.game_date DESC) AS rn FROM p LEFT JOIN lk ON lk.team = p.team AND lk.game_date < p.slate)
SELECT team, CAST(slate AS VARCHAR) AS slate, {q_r6('coalesce(sum(CASE WHEN rn <= 6 THEN km END), 0e0)')} AS travel_km_7d, {q_r6('coalesce(sum(CASE WHEN rn <= 6 THEN sh END), 0e0)')} AS circadian_shift_hours FROM j GROUP BY 1, 2""")
def win_travel(t):
    games = t.team_games()
    p = t.game_log().select("team", F.col("game_date").alias("slate")).distinct()
    cols = ["travel_km_7d", "circadian_shift_hours"]
    latest = CX.latest_before(CX.travel(games), p, "slate", cols)
    return latest.select("team", F.col("_cut").cast("string").alias("slate"), *[r6(F.coalesce(F.col(c), num(0))).alias(c) for c in cols])


@query("win_market", f"""WITH {MARKET}, {MARKET_PROBES}, j AS (SELECT p.game_id, p.cutoff, m.captured_on, m.total_points, m.home_spread AS hs, coalesce(m.home_spread, m.away_spread) AS sp FROM mp p LEFT JOIN mk m ON m.game_id = p.game_id AND m.captured_on <= p.cutoff),
a AS (SELECT game_id, cutoff, count(captured_on) AS n, count(sp) AS ns, stddev_pop(sp) AS vol, max_by(total_points, captured_on) AS tot, arg_min(total_points, captured_on) AS tot0, max(captured_on) AS lastc FROM j GROUP BY 1, 2),
z AS (SELECT a.*, j.hs, j.sp FROM a LEFT JOIN j ON j.game_id = a.game_id AND j.cutoff = a.cutoff AND j.captured_on = a.lastc)
SELECT game_id, CAST(cutoff AS VARCHAR) AS cutoff, coalesce(tot, 0e0) AS market_total_points, coalesce(abs(sp), 0e0) AS market_spread_abs, CASE WHEN n >= 2 THEN tot - tot0 ELSE 0e0 END AS market_total_move,
 {q_r6('CASE WHEN n >= 2 AND ns >= 2 THEN vol ELSE 0e0 END')} AS market_volatility, {q_r6('coalesce(tot / 2e0 - hs / 2e0, 0e0)')} AS market_home_implied_total, {q_r6('coalesce(tot - (tot / 2e0 - hs / 2e0), 0e0)')} AS market_away_implied_total FROM z""")
def win_market(t):
    m = CX.market_features(t.market(), t.market_probes())
    return s_date(m, "cutoff").withColumns({c: r6(c) for c in ("market_volatility", "market_home_implied_total", "market_away_implied_total")})


@query("win_first_seen", f"WITH {LINE_SNAPSHOTS} SELECT player_id, stat_type, min(snapshot_id) AS snapshot_id, arg_min(line_score, snapshot_id) AS line_score FROM ls GROUP BY 1, 2")
def win_first_seen(t):
    return J.best_per_key(t.line_snapshots(), ["player_id", "stat_type"], ["snapshot_id"], newest=False)
