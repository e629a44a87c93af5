"""Joins, filters, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions import measures as M
from oddsmill.functions import names as N
from oddsmill.functions.exprs import big, num, r6
from oddsmill.operators import asof as A
from oddsmill.operators import matching as J
from oddsmill.operators.ordering import sorted_positions
from oddsmill.session import merged

from .adapters import EPOCH_DAY, GAME_LOG, LINE_SNAPSHOTS, LINES, MARKET, MARKET_PROBES, MEASURE_COLS, MEASURES, PREDICTIONS, TEAM_GAMES, pick_from, q_case, q_r6, q_sum, sql_list
from .registry import query

# --- an eight-way schema over the star tables: lines, features, players, games, teams, official games --------
# games: one per (team pair, day) of the game log, start time = that day 23:30 UTC (so the Eastern date is the same day)
SOURCE_CODES = ["PHO" if t == "PHX" else "NO" if t == "NOP" else "WSH" if t == "WAS" else t for t in K.TEAMS]   # source spelling
WORLD = LINES + f""",
teams AS (SELECT CAST(u.range AS BIGINT) AS team_id, ({sql_list(SOURCE_CODES)})[CAST(u.range + 1 AS INT)] AS abbreviation FROM range(30) u),
games AS (SELECT DISTINCT least(player_id % 30, 29 - player_id % 30) * 100000 + {EPOCH_DAY.format('game_date')} AS game_id,
   CASE WHEN day(game_date) % 2 = 0 THEN least(player_id % 30, 29 - player_id % 30) ELSE greatest(player_id % 30, 29 - player_id % 30) END AS home_team_id,
   CASE WHEN day(game_date) % 2 = 0 THEN greatest(player_id % 30, 29 - player_id % 30) ELSE least(player_id % 30, 29 - player_id % 30) END AS away_team_id,
   CAST(game_date AS TIMESTAMP) + INTERVAL '23 hours 30 minutes' AS start_time FROM gl),
official AS (SELECT DISTINCT 90000000 + least(player_id % 30, 29 - player_id % 30) * 100000 + {EPOCH_DAY.format('game_date')} AS official_id, game_date,
   ({sql_list(K.TEAMS)})[CAST(CASE WHEN day(game_date) % 2 = 0 THEN least(player_id % 30, 29 - player_id % 30) ELSE greatest(player_id % 30, 29 - player_id % 30) END + 1 AS INT)] AS home,
   ({sql_list(K.TEAMS)})[CAST(CASE WHEN day(game_date) % 2 = 0 THEN greatest(player_id % 30, 29 - player_id % 30) ELSE least(player_id % 30, 29 - player_id % 30) END + 1 AS INT)] AS away
   FROM gl WHERE {EPOCH_DAY.format('game_date')} % 9 <> 0),
nm AS (SELECT source_abbr, normalized_abbr FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in sorted(K.TEAM_OVERRIDES.items()))}) v(source_abbr, normalized_abbr)),
ft AS (SELECT id, player_id, stat_type, line_score, slate, least(player_id % 30, 29 - player_id % 30) * 100000 + {EPOCH_DAY.format('slate')} AS game_id, CAST(id % 4 AS INT) AS odds_type,
   CASE WHEN id % 13 = 0 THEN 'combo' END AS event_type FROM ln),
gm AS (SELECT g.game_id, o.official_id FROM games g LEFT JOIN teams ht ON ht.team_id = g.home_team_id LEFT JOIN teams aw ON aw.team_id = g.away_team_id
   LEFT JOIN nm hm ON hm.source_abbr = upper(ht.abbreviation) LEFT JOIN nm am ON am.source_abbr = upper(aw.abbreviation)
   JOIN official o ON o.game_date = CAST((g.start_time AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE)
     AND o.home = upper(coalesce(hm.normalized_abbr, ht.abbreviation)) AND o.away = upper(coalesce(am.normalized_abbr, aw.abbreviation)))"""


class World:
    """DataFrame twin of the SQL above."""

    def __init__(self, t):
        self.t = t
        g = t.game_log()
        a, b = F.col("player_id") % 30, 29 - F.col("player_id") % 30
        lo, hi, even = F.least(a, b), F.greatest(a, b), F.dayofmonth("game_date") % 2 == 0
        pair = g.select(lo.alias("lo"), hi.alias("hi"), "game_date").distinct()
        home, away = F.when(F.dayofmonth("game_date") % 2 == 0, F.col("lo")).otherwise(F.col("hi")), F.when(F.dayofmonth("game_date") % 2 == 0, F.col("hi")).otherwise(F.col("lo"))
        self.games = pair.select((F.col("lo") * 100000 + F.unix_date("game_date")).alias("game_id"), home.alias("home_team_id"), away.alias("away_team_id"),
                                 (F.col("game_date").cast("timestamp_ntz") + F.expr("interval '23:30' hour to minute")).alias("start_time"))
        self.official = pair.filter(F.unix_date("game_date") % 9 != 0).select(
            (F.lit(90000000) + F.col("lo") * 100000 + F.unix_date("game_date")).alias("official_id"), "game_date",
            pick_from(K.TEAMS, home).alias("home"), pick_from(K.TEAMS, away).alias("away"))
        self.teams = t.spark.range(30).select(F.col("id").alias("team_id"), pick_from(SOURCE_CODES, F.col("id")).alias("abbreviation"))

    def game_map(self):
        """Source game id -> official game id on (Eastern date, home code, away code). The override map is a constant
        expression; the thirty-row team table is a fixed-size dimension."""
        side = lambda c: self.teams.select(F.col("team_id").alias(f"{c}_team_id"), X.team_code("abbreviation").alias(c))
        keyed = (
            self.games.join(F.broadcast(side("home")), "home_team_id", "left").join(F.broadcast(side("away")), "away_team_id", "left")
            .withColumn("game_date", J.eastern_date(F.col("start_time").cast("timestamp")))
        )
        return keyed.join(self.official, ["game_date", "home", "away"]).select("game_id", "official_id")

    def features(self):
        l = self.t.lines()
        a, b = F.col("player_id") % 30, 29 - F.col("player_id") % 30
        return l.select("id", "player_id", "stat_type", "line_score", "slate", (F.least(a, b) * 100000 + F.unix_date("slate")).alias("game_id"),
                        (F.col("id") % 4).cast("int").alias("odds_type"), F.when(F.col("id") % 13 == 0, "combo").alias("event_type"))


@query("join_training_base", f"""WITH {WORLD} SELECT ft.id, ft.player_id, ft.stat_type, ft.line_score, c.c_name AS player_name, gm.official_id
FROM ft JOIN customer c ON c.c_custkey = ft.player_id JOIN gm ON gm.game_id = ft.game_id WHERE coalesce(nullif(odds_type, 3), 0) = 0 AND lower(coalesce(event_type, '')) <> 'combo'""")
def join_training_base(t):
    w = World(t)
    f = w.features().filter((F.coalesce(F.nullif("odds_type", F.lit(3)), F.lit(0)) == 0) & (F.lower(F.coalesce("event_type", F.lit(""))) != "combo"))
    players = t.base("customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("player_name"))
    return f.join(merged(players), "player_id").join(w.game_map(), "game_id").select("id", "player_id", "stat_type", "line_score", "player_name", "official_id")


@query("join_values_map", f"""WITH {WORLD} SELECT team_id, abbreviation, coalesce(nm.normalized_abbr, abbreviation) AS code, count(*) AS players FROM teams
 JOIN customer ON c_custkey % 30 = team_id LEFT JOIN nm ON nm.source_abbr = upper(abbreviation) GROUP BY 1, 2, 3""")
def join_values_map(t):
    c = t.base("customer").withColumn("team_id", F.col("c_custkey") % 30)
    return c.groupBy("team_id", pick_from(SOURCE_CODES, F.col("team_id")).alias("abbreviation")).agg(F.count(F.lit(1)).alias("players")).withColumn("code", X.team_code("abbreviation"))


_nkey = "nullif(regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace({0}, '[^a-zA-Z0-9\\s]', ' ', 'g')), '\\s+', ' ', 'g')), '(^|\\s)(jr|sr|ii|iii|iv|v)(\\s(jr|sr|ii|iii|iv|v))*$', ''), '[^a-z0-9]', '', 'g'), '')"
SPELLED = "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN upper(c_name) || ' Jr.' ELSE c_name END"
RESOLVE = f"""src AS (SELECT c_custkey AS line_id, {_nkey.format('(' + SPELLED + ')')} AS name_key FROM customer),
dim AS (SELECT c_custkey AS player_id, {_nkey.format('c_name')} AS name_key FROM customer WHERE c_custkey % 4 <> 0)"""


def resolve_sides(t):
    c, k = t.base("customer"), F.col("c_custkey")
    spelled = F.when(k % 7 == 0, None).when(k % 3 == 0, F.concat(F.upper("c_name"), F.lit(" Jr."))).otherwise(F.col("c_name"))
    src = c.select(k.alias("line_id"), spelled.alias("n")).withColumn("name_key", N.name_key("n")).drop("n")
    dim = c.filter(k % 4 != 0).select(k.alias("player_id"), N.name_key("c_name").alias("name_key"))
    return src, dim


@query("join_name_resolve", f"WITH {RESOLVE} SELECT line_id, src.name_key, player_id, player_id IS NOT NULL AS matched FROM src LEFT JOIN dim ON src.name_key = dim.name_key")
def join_name_resolve(t):
    src, dim = resolve_sides(t)
    return J.resolve_by_key(src, dim, "name_key", ["player_id"]).select("line_id", "name_key", "player_id", "matched")


@query("join_game_resolve", f"WITH {WORLD} SELECT game_id, official_id FROM gm")
def join_game_resolve(t):
    return World(t).game_map()


COMBO = GAME_LOG + f""", cl AS (SELECT event_id AS line_id, CAST(ts AS DATE) AS game_date, 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') ||
  CASE WHEN event_id % 3 = 0 THEN ' + Customer#' || lpad(CAST(user_id + 1 AS VARCHAR), 9, '0') ELSE '' END AS name FROM events WHERE event_type = 'click'),
ex AS (SELECT line_id, game_date, unnest(string_split(name, ' + ')) AS part FROM cl),
ky AS (SELECT line_id, game_date, {_nkey.format('part')} AS name_key FROM ex),
pl AS (SELECT c_custkey AS player_id, {_nkey.format('c_name')} AS name_key FROM customer)
SELECT line_id, count(*) AS expected, count(gl.player_id) AS matched, {q_r6('sum(points)')} AS points, {q_r6('sum(rebounds)')} AS rebounds
FROM ky LEFT JOIN pl ON pl.name_key = ky.name_key LEFT JOIN gl ON gl.player_id = pl.player_id AND gl.game_date = ky.game_date
GROUP BY line_id HAVING count(*) = count(gl.player_id)"""


@query("join_combo_decompose", "WITH " + COMBO)
def join_combo_decompose(t):
    full = lambda k: F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    e = t.base("events").filter("event_type = 'click'")
    u = F.col("user_id")
    lines = e.select(F.col("event_id").alias("line_id"), F.to_date("ts").alias("game_date"),
                     F.concat(full(u), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" + "), full(u + 1))).otherwise("")).alias("name"))
    players = t.base("customer").select(F.col("c_custkey").alias("player_id"), N.name_key("c_name").alias("name_key"))
    out = J.decompose_combos(lines, players, t.game_log(), "line_id", "name", "game_date", ["points", "rebounds"], N.name_key)
    return out.select("line_id", "expected", "matched", r6("points").alias("points"), r6("rebounds").alias("rebounds"))


# --- as-of ------------------------------------------------------------------------------------------------------
@query("join_asof_log", f"""WITH {GAME_LOG}, p AS (SELECT event_id, user_id AS player_id, CAST(ts AS DATE) AS cutoff FROM events WHERE event_type = 'purchase')
SELECT event_id, count(gl.player_id) AS n, {q_r6('avg(points)')} AS mean_points, CAST(max(game_date) AS VARCHAR) AS last_day
FROM p LEFT JOIN gl ON gl.player_id = p.player_id AND gl.game_date < p.cutoff GROUP BY event_id""")
def join_asof_log(t):
    probes = t.base("events").filter("event_type = 'purchase'").select("event_id", F.col("user_id").alias("player_id"), F.to_date("ts").alias("cutoff"))
    prior = A.strict_prior(t.game_log().select("player_id", "game_date", "points"), probes, ["player_id"], "game_date", "cutoff", {
        "n": lambda w: F.count("points").over(w), "mean_points": lambda w: F.avg("points").over(w),
        "last_day": lambda w: F.max(F.when(F.col("_probe") == 0, F.col("game_date"))).over(w)})
    return A.attach_prior(probes, prior, ["player_id"], "cutoff").select(
        "event_id", F.coalesce("n", F.lit(0)).alias("n"), r6("mean_points").alias("mean_points"), F.col("last_day").cast("string").alias("last_day"))


@query("join_asof_latest", f"""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts, value, event_id AS vid FROM events WHERE event_type = 'view')
SELECT p.event_id, (SELECT max_by(b.value, (b.ts, b.vid)) FROM b WHERE b.user_id = p.user_id AND b.ts < p.ts) AS value,
 (SELECT max_by(b.vid, (b.ts, b.vid)) FROM b WHERE b.user_id = p.user_id AND b.ts < p.ts) AS source_event FROM p""")
def join_asof_latest(t):
    e = t.base("events")
    probe = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    build = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("bts"), "value", F.col("event_id").alias("source_event"))
    return A.asof_latest(probe, build, ["user_id"], "ts", "bts", ["value", "source_event"], inclusive=False, tie=["source_event"]).select("event_id", "value", "source_event")


@query("join_market_fallback", f"""WITH {MARKET}, a AS (SELECT game_id, captured_on, total_points FROM mk WHERE game_id % 3 <> 0),
b AS (SELECT game_id % 50 AS grp, captured_on, max(total_points) AS total_points FROM mk GROUP BY 1, 2),
q AS (SELECT DISTINCT l_partkey AS game_id, l_partkey % 50 AS grp, CAST(l_shipdate AS DATE) AS captured_on FROM lineitem)
SELECT q.game_id, CAST(q.captured_on AS VARCHAR) AS captured_on, CASE WHEN a.game_id IS NOT NULL THEN a.total_points ELSE b.total_points END AS total_points,
 CASE WHEN a.game_id IS NOT NULL THEN 'primary' WHEN b.grp IS NOT NULL THEN 'secondary' ELSE 'none' END AS source
FROM q LEFT JOIN a ON a.game_id = q.game_id AND a.captured_on = q.captured_on LEFT JOIN b ON b.grp = q.grp AND b.captured_on = q.captured_on""")
def join_market_fallback(t):
    m = t.market()
    grp = (F.col("game_id") % 50).alias("grp")
    q = t.base("lineitem").select(F.col("l_partkey").alias("game_id"), F.to_date("l_shipdate").alias("captured_on")).distinct().withColumn("grp", F.col("game_id") % 50)
    a = m.filter("game_id % 3 <> 0").select("game_id", "captured_on", "total_points")
    b = m.groupBy(grp, "captured_on").agg(F.max("total_points").alias("total_points"))
    out = J.with_fallback(q, a, ["game_id", "captured_on"], b, ["grp", "captured_on"], ["total_points"])
    return out.select("game_id", F.col("captured_on").cast("string").alias("captured_on"), "total_points", "source")


@query("join_semi_anti", """SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def join_semi_anti(t):
    o, l = t.base("orders").select("o_orderkey"), t.base("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    # one pass over the fact table answers both questions: any row at all, and any row with the flag
    facts = l.groupBy("o_orderkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("bad"))
    return o.join(facts.filter("bad = 0"), "o_orderkey", "left_semi")


@query("join_indicator", f"""WITH {GAME_LOG} SELECT e.event_id, CASE WHEN gl.player_id IS NULL THEN 'left_only' ELSE 'both' END AS indicator, points FROM events e
 LEFT JOIN (SELECT * FROM gl WHERE player_id % 3 <> 0) gl ON gl.player_id = e.user_id AND gl.game_date = CAST(e.ts AS DATE)""")
def join_indicator(t):
    g = t.game_log().filter("player_id % 3 <> 0").select("player_id", "game_date", "points", F.lit(True).alias("_hit"))
    e = t.base("events").select("event_id", F.col("user_id").alias("player_id"), F.to_date("ts").alias("game_date"))
    return e.join(merged(g), ["player_id", "game_date"], "left").select("event_id", F.when(F.col("_hit"), "both").otherwise("left_only").alias("indicator"), "points")


@query("join_market_diag", f"""WITH {MARKET}, o AS (SELECT DISTINCT game_id, captured_on FROM mk WHERE game_id % 2 = 0 AND day(captured_on) <> 13), p AS (SELECT DISTINCT game_id, captured_on FROM mk WHERE game_id % 5 <> 0),
d AS (SELECT DISTINCT captured_on FROM o), f AS (SELECT o.game_id AS a, d.captured_on AS dd, p.game_id AS b FROM mk LEFT JOIN o ON o.game_id = mk.game_id AND o.captured_on = mk.captured_on
  LEFT JOIN d ON d.captured_on = mk.captured_on LEFT JOIN p ON p.game_id = mk.game_id AND p.captured_on = mk.captured_on)
SELECT count(*) AS rows_with_keys, count(a) AS rows_matching_official, count(dd) AS rows_on_covered_days, count(b) AS rows_matching_planned,
 round(count(a) / CAST(count(*) AS DOUBLE), 4) AS match_rate, round(count(a) / CAST(count(dd) AS DOUBLE), 4) AS match_rate_covered, round(count(b) / CAST(count(*) AS DOUBLE), 4) AS planned_match_rate FROM f""")
def join_market_diag(t):
    m = t.market().select("game_id", "captured_on")
    return J.match_rates(m, ["game_id", "captured_on"], "captured_on", m.filter((F.col("game_id") % 2 == 0) & (F.dayofmonth("captured_on") != 13)), m.filter("game_id % 5 <> 0"))


TWO = GAME_LOG + f""", sa AS (SELECT user_id AS player_id, CAST(ts AS DATE) AS game_date, round(sum(value), 2) AS points FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
sb AS (SELECT user_id AS player_id, CAST(ts AS DATE) AS game_date, round(sum(value), 2) AS points FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)"""


def two_sources(t):
    src = lambda r: t.base("events").filter(F.col("event_id") % 2 == r).groupBy(F.col("user_id").alias("player_id"), F.to_date("ts").alias("game_date")).agg(F.round(F.sum("value"), 2).alias("points"))
    return src(0), src(1)


def day_text(df):
    return df.withColumn("game_date", F.col("game_date").cast("string"))


@query("join_priority_merge", f"""WITH {TWO}, u AS (SELECT *, 0 AS pri FROM sa UNION ALL SELECT *, 1 FROM sb), r AS (SELECT *, row_number() OVER (PARTITION BY player_id, game_date ORDER BY pri) AS rn FROM u)
SELECT player_id, CAST(game_date AS VARCHAR) AS game_date, points FROM r WHERE rn = 1""")
def join_priority_merge(t):
    a, b = two_sources(t)
    return day_text(J.priority_merge(a, b, ["player_id", "game_date"]))


@query("join_outcome_find", f"""WITH {LINES} SELECT l.id, CASE WHEN v > line_score THEN 'over' WHEN v < line_score THEN 'under' WHEN v IS NOT NULL THEN 'push' END AS outcome FROM (
 SELECT ln.id, ln.line_score, CASE ln.stat_type WHEN 'Points' THEN points WHEN 'Rebounds' THEN rebounds WHEN 'Assists' THEN assists ELSE turnovers END AS v
 FROM ln LEFT JOIN (SELECT player_id, game_date, points, rebounds, assists, turnovers FROM gl WHERE player_id % 11 <> 0) g ON g.player_id = ln.player_id AND g.game_date = ln.slate) l""".replace("gl.turnovers", "turnovers"))
def join_outcome_find(t):
    box = t.game_log().filter("player_id % 11 <> 0").select("player_id", F.col("game_date").alias("slate"), *MEASURE_COLS)
    l = t.lines().select("id", "player_id", "slate", "stat_type", "line_score").join(merged(box), ["player_id", "slate"], "left")
    return l.select("id", J.outcome(M.measure_value("stat_type", MEASURE_COLS), F.col("line_score")).alias("outcome"))


@query("join_line_players", """WITH l AS (SELECT o_orderkey, o_custkey, o_orderkey % 5 = 0 AS nonstd, 'desc ' || o_orderkey AS description FROM orders),
p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS display_name, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' alt' END AS name, c_custkey % 10 = 0 AS combo FROM customer)
SELECT player_name, count(*) AS lines FROM (SELECT coalesce(display_name, name, description) AS player_name FROM l LEFT JOIN p ON c_custkey = o_custkey WHERE NOT nonstd AND NOT coalesce(combo, false)) GROUP BY 1""")
def join_line_players(t):
    k = F.col("c_custkey")
    p = t.base("customer").select(k.alias("o_custkey"), F.when(k % 3 == 0, F.col("c_name")).alias("display_name"), F.when(k % 2 == 0, F.concat("c_name", F.lit(" alt"))).alias("name"), (k % 10 == 0).alias("combo"))
    l = t.base("orders").select("o_custkey", (F.col("o_orderkey") % 5 == 0).alias("nonstandard"), F.concat(F.lit("desc "), F.col("o_orderkey").cast("string")).alias("description"))
    j = l.filter(~F.col("nonstandard")).join(p, "o_custkey", "left").filter(~F.coalesce("combo", F.lit(False)))
    return j.groupBy(F.coalesce("display_name", "name", "description").alias("player_name")).agg(F.count(F.lit(1)).alias("lines"))


# --- filters, sorts, limits, sets -----------------------------------------------------------------------------------
def eligible(df):
    """Null-tolerant slate eligibility over flag columns."""
    off = lambda c: F.col(c).isNull() | ~F.col(c)
    return df.filter(off("combo") & off("is_live") & off("in_game") & F.coalesce("today", F.lit(True))
                     & (F.col("minutes_to_start").isNull() | (F.col("minutes_to_start") >= 0)) & (F.lower(F.coalesce("event_type", F.lit(""))) != "combo"))


FLAGS = f"""fl AS (SELECT id, CASE WHEN id % 4 = 1 THEN true WHEN id % 4 = 2 THEN false END AS is_live, CASE WHEN id % 9 = 1 THEN true END AS in_game,
 CASE WHEN id % 10 = 3 THEN true END AS combo, CASE WHEN id % 6 = 0 THEN false WHEN id % 6 = 1 THEN true END AS today, CASE WHEN id % 8 <> 0 THEN CAST(id % 30 - 3 AS DOUBLE) END AS minutes_to_start,
 CASE WHEN id % 13 = 0 THEN 'Combo' END AS event_type FROM pr)"""


def flagged(t):
    i = F.col("id")
    return t.predictions().select(
        "id", F.when(i % 4 == 1, True).when(i % 4 == 2, False).alias("is_live"), F.when(i % 9 == 1, True).alias("in_game"), F.when(i % 10 == 3, True).alias("combo"),
        F.when(i % 6 == 0, False).when(i % 6 == 1, True).alias("today"), F.when(i % 8 != 0, (i % 30 - 3).cast("double")).alias("minutes_to_start"), F.when(i % 13 == 0, "Combo").alias("event_type"))


@query("flt_eligible", f"""WITH {PREDICTIONS}, {FLAGS} SELECT id FROM fl WHERE (combo IS NULL OR NOT combo) AND (is_live IS NULL OR NOT is_live) AND (in_game IS NULL OR NOT in_game)
 AND coalesce(today, true) AND (minutes_to_start IS NULL OR minutes_to_start >= 0) AND lower(coalesce(event_type, '')) <> 'combo'""")
def flt_eligible(t):
    return eligible(flagged(t)).select("id")


MIXED = ["Points", "Dunks", "Blocked Shots", "Pts+Rebs", "Quarters Won", "3-PT Made", "FANTASY score", ""]


@query("flt_supported", f"""WITH {PREDICTIONS}, s AS (SELECT id, ({sql_list(MIXED)})[CAST(id % 8 + 1 AS INT)] AS stat FROM pr) SELECT id, stat FROM s WHERE stat IN ('Points', 'Pts+Rebs', '3-PT Made', 'FANTASY score')""")
def flt_supported(t):
    s = t.predictions().select("id", pick_from(MIXED, F.col("id") % 8).alias("stat"))
    return s.filter(M.measure_key("stat").isin(*M.supported_keys()) & ~F.col("stat").isin(*K.EXCLUDED_STATS))


@query("flt_date_range", """SELECT event_id FROM events WHERE event_id % 10 <> 0 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""")
def flt_date_range(t):
    from oddsmill.operators.ingest import within_dates

    e = t.base("events").withColumn("d", F.when(F.col("event_id") % 10 != 0, F.to_date("ts")))
    return within_dates(e, "d", "2024-01-05", "2024-01-12").select("event_id")


@query("flt_min_experts", f"WITH {PREDICTIONS} SELECT id FROM pr WHERE {q_sum([f'CASE WHEN {e} IS NULL THEN 0 ELSE 1 END' for e in K.EXPERTS])} >= 6")
def flt_min_experts(t):
    return t.predictions().filter(X.present(K.EXPERTS) >= 6).select("id")


@query("sort_nulls_last", f"""WITH {PREDICTIONS} SELECT id, rank_score, confidence, CAST(row_number() OVER (ORDER BY rank_score DESC NULLS LAST, confidence DESC NULLS LAST, id) - 1 AS BIGINT) AS position FROM (SELECT id, CASE WHEN id % 6 <> 0 THEN p_final END AS rank_score, CASE WHEN id % 5 <> 0 THEN p_raw END AS confidence FROM pr)""")
def sort_nulls_last(t):
    d = t.predictions().select("id", F.when(F.col("id") % 6 != 0, F.col("p_final")).alias("rank_score"), F.when(F.col("id") % 5 != 0, F.col("p_raw")).alias("confidence"))
    return sorted_positions(d, [F.desc_nulls_last("rank_score"), F.desc_nulls_last("confidence"), F.col("id")], "position")


@query("topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_global(t):
    return t.base("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("topk_per_group", """SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS BIGINT) AS rn FROM events) WHERE rn <= 5""")
def topk_per_group(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.base("events").select("user_id", "event_id", "ts", big(F.row_number().over(w)).alias("rn")).filter("rn <= 5").drop("ts")


@query("set_intersect", f"WITH {TWO} SELECT player_id, CAST(game_date AS VARCHAR) AS game_date FROM (SELECT player_id, game_date FROM sa INTERSECT SELECT player_id, game_date FROM sb)")
def set_intersect(t):
    a, b = two_sources(t)
    return day_text(a.select("player_id", "game_date").intersect(b.select("player_id", "game_date")))


@query("set_except", f"WITH {RESOLVE} SELECT DISTINCT name_key FROM src WHERE name_key IS NOT NULL AND name_key NOT IN (SELECT name_key FROM dim)")
def set_except(t):
    src, dim = resolve_sides(t)
    return src.select("name_key").filter("name_key IS NOT NULL").distinct().join(dim, "name_key", "left_anti")


@query("set_union", f"WITH {TWO} SELECT player_id, CAST(game_date AS VARCHAR) AS game_date, points, 'official' AS source FROM sa UNION ALL SELECT player_id, CAST(game_date AS VARCHAR), points, 'fallback' FROM sb")
def set_union(t):
    a, b = two_sources(t)
    return day_text(a.withColumn("source", F.lit("official")).unionByName(b.withColumn("source", F.lit("fallback"))))


@query("set_distinct", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def set_distinct(t):
    """drop-duplicates that always keeps the same row: the smallest by the remaining order column."""
    l = t.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return J.best_per_key(l, ["l_orderkey", "l_linenumber"], ["l_partkey"], newest=False)
