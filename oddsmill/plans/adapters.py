"""Views that give the star-schema tables the roles the operators need (players, lines, outcomes, markets).

Each view exists twice: as a DataFrame here and as a SQL common table expression for the oracle, so both
engines start from the same rows. Measures are two-decimal sums, so rounding them is exact in both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import num
from oddsmill.session import durable, pin_runtime

# Deterministic pseudo-probabilities: column -> (a, b) of round(0.02 + 0.96 * ((id * a + key * b) % 997) / 996, 6)
PROB_COEFS = {
    "p_forecast_cal": (15485863, 7), "p_nn": (32452843, 19), "p_tabdl": (1299709, 13),
    "p_lr": (7919, 31), "p_xgb": (104729, 17), "p_lgbm": (49979687, 23), "p_final": (86028157, 3),
    "p_raw": (67867967, 5),
}
MEASURES = ["Points", "Rebounds", "Assists", "Turnovers"]
MEASURE_COLS = ["points", "rebounds", "assists", "turnovers"]


def pseudo_prob(name: str, key: str, other: str) -> Column:
    a, b = PROB_COEFS[name]
    return F.expr(f"round(2e-2D + 96e-2D * cast(({key} * {a}L + {other} * {b}L) % 997 as double) / 996e0D, 6)")


def _sql_prob(name: str, key: str, other: str) -> str:
    a, b = PROB_COEFS[name]
    return f"round(2e-2 + 96e-2 * CAST(({key} * {a} + {other} * {b}) % 997 AS DOUBLE) / 996e0, 6) AS {name}"


def pick_from(values: list[str], index: Column) -> Column:
    return F.element_at(X.constant_array(values), (index + 1).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


class Tables:
    """The base tables of one folder plus the role views over them. Scans are lazy and column-pruned."""

    def __init__(self, spark: SparkSession, folder: str):
        pin_runtime(spark)
        self.spark, self.folder = spark, folder.rstrip("/")
        self._views: dict[str, DataFrame] = {}

    def _view(self, name: str, build) -> DataFrame:
        """Plans are built once per query, however many steps start from them."""
        if name not in self._views:
            self._views[name] = build()
        return self._views[name]

    def pin_game_log(self) -> "Tables":
        """Store the game log once for queries that start from it many times: the raw events are then scanned a single
        time, and every step reads the far smaller one-row-per-player-and-day table."""
        self._views["game_log"] = durable(self._game_log())
        return self

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- player game log: one row per player and day ---------------------------------------------
    def game_log(self) -> DataFrame:
        return self._view("game_log", self._game_log)

    def _game_log(self) -> DataFrame:
        e = self.base("events")

        def measure(kind: str) -> Column:
            return F.round(F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(num(0))), 2)

        def count_of(*kinds: str) -> Column:
            return F.sum(F.col("event_type").isin(*kinds).cast("double"))

        daily = e.groupBy(F.col("user_id").alias("player_id"), F.to_date("ts").alias("game_date")).agg(
            F.count(F.lit(1)).cast("double").alias("minutes"),
            measure("purchase").alias("points"), measure("click").alias("rebounds"),
            measure("view").alias("assists"), measure("error").alias("turnovers"),
            measure("signup").alias("blocks"),
            count_of("purchase", "click").alias("fga"), count_of("view").alias("fta"),
            count_of("signup").alias("oreb"), count_of("purchase").alias("fg3m"), count_of("click").alias("fgm"),
        )
        return daily.withColumns({
            "team": pick_from(K.TEAMS, F.col("player_id") % 30),
            "opp": pick_from(K.TEAMS, 29 - F.col("player_id") % 30),
        })

    # --- resolved predictions: one row per order --------------------------------------------------
    def predictions(self) -> DataFrame:
        return self._view("predictions", self._predictions)

    def _predictions(self) -> DataFrame:
        o = self.base("orders")
        probs = {p: pseudo_prob(p, "o_orderkey", "o_custkey") for p in PROB_COEFS}
        probs["p_tabdl"] = F.when(F.col("o_orderkey") % 7 != 0, probs["p_tabdl"])
        label = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
        line = F.floor(F.col("o_totalprice") / 1000).cast("double")
        return o.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("player_id"),
            F.col("o_custkey").alias("cust"),
            F.col("o_orderpriority").alias("stat_type"), F.col("o_orderdate").alias("decision_time"),
            (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("snapshot_id"),
            line.alias("line_score"),
            F.when(F.col("o_orderstatus") == "F", "over").when(F.col("o_orderstatus") == "O", "under")
            .otherwise("push").alias("outcome"),
            label.alias("over_label"),
            (line + F.when(F.col("o_orderstatus") == "F", num(3)).when(F.col("o_orderstatus") == "O", num(-2))
             .otherwise(num(0))).alias("actual_value"),
            *[v.alias(k) for k, v in probs.items()],
            (F.col("o_custkey") % 40).cast("double").alias("n_eff"),
            F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(1).alias("conformal_set_size"),
            F.when(label.isNotNull(), ((probs["p_final"] >= 0.5) == (label == 1)).cast("int")).alias("is_correct"),
        )

    def resolved(self) -> DataFrame:
        return self.predictions().filter(F.col("over_label").isNotNull())

    # --- line snapshots ---------------------------------------------------------------------------
    def line_snapshots(self) -> DataFrame:
        o = self.base("orders")
        return (
            o.groupBy(
                (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("snapshot_id"),
                F.col("o_custkey").alias("player_id"), F.col("o_orderpriority").alias("stat_type"),
            )
            .agg(F.floor(F.min("o_totalprice") / 1000).cast("double").alias("line_score"))
        )

    # --- lines with outcomes: one row per game-log row and measure ---------------------------------
    def lines(self) -> DataFrame:
        return self._view("lines", self._lines)

    def _lines(self) -> DataFrame:
        g = self.game_log()
        legs = F.array(*[
            F.struct(F.lit(i).alias("m"), F.lit(name).alias("stat_type"), F.col(col).alias("actual"))
            for i, (name, col) in enumerate(zip(MEASURES, MEASURE_COLS))
        ])
        base = g.select("player_id", "team", "opp", "game_date", "minutes", F.explode(legs).alias("leg")).select(
            "player_id", "team", "opp", F.col("game_date").alias("slate"), "minutes",
            F.col("leg.stat_type").alias("stat_type"), F.col("leg.actual").alias("actual"),
            (num(10) + num(5) * (F.col("player_id") % 5)).alias("line_score"),
            ((F.col("player_id") * 100000 + F.unix_date("game_date")) * 4 + F.col("leg.m")).alias("id"),
        )
        probs = {p: pseudo_prob(p, "id", "player_id") for p in PROB_COEFS}
        probs["p_tabdl"] = F.when(F.col("id") % 7 != 0, probs["p_tabdl"])
        return base.withColumns(probs)

    # --- market captures: one row per part and ship date -------------------------------------------
    def market(self) -> DataFrame:
        l = self.base("lineitem")
        return l.groupBy(F.col("l_partkey").alias("game_id"), F.to_date("l_shipdate").alias("captured_on")).agg(
            (F.sum("l_quantity") + 180).alias("total_points"),
            F.when(F.col("l_partkey") % 4 != 0, F.round(F.max("l_discount") * 100 - 5, 1)).alias("home_spread"),
            F.when(F.col("l_partkey") % 5 != 0, F.round(F.max("l_tax") * 100 - 4, 1)).alias("away_spread"),
        )

    def market_probes(self) -> DataFrame:
        """One cut-off per part and order month: the first order date of the month the part was ordered in."""
        l, o = self.base("lineitem"), self.base("orders")
        return (
            l.join(o, l.l_orderkey == o.o_orderkey)
            .groupBy(F.col("l_partkey").alias("game_id"), F.trunc("o_orderdate", "month").alias("m"))
            .agg(F.to_date(F.min("o_orderdate")).alias("cutoff"))
            .select("game_id", "cutoff")
        )

    def team_games(self) -> DataFrame:
        """Sum per team and day, with home/away codes."""
        from oddsmill.operators.aggregates import team_game_stats

        return team_game_stats(self.game_log())


# --- SQL twins -----------------------------------------------------------------------------------

#: Days since 1970, so ids made of them never come back in a later year; below 100,000 until the year 2243.
EPOCH_DAY = "(CAST({} AS DATE) - DATE '1970-01-01')"


def _measure_sql(kind: str, name: str) -> str:
    return f"round(sum(CASE WHEN event_type = '{kind}' THEN value ELSE 0e0 END), 2) AS {name}"


def _count_sql(name: str, *kinds: str) -> str:
    inside = ", ".join(f"'{k}'" for k in kinds)
    return f"CAST(sum(CASE WHEN event_type IN ({inside}) THEN 1 ELSE 0 END) AS DOUBLE) AS {name}"


GAME_LOG = f"""gl AS (
  SELECT *, ({sql_list(K.TEAMS)})[CAST(player_id % 30 + 1 AS INT)] AS team,
         ({sql_list(K.TEAMS)})[CAST(29 - player_id % 30 + 1 AS INT)] AS opp
  FROM (SELECT user_id AS player_id, CAST(ts AS DATE) AS game_date, CAST(count(*) AS DOUBLE) AS minutes,
         {_measure_sql('purchase', 'points')}, {_measure_sql('click', 'rebounds')}, {_measure_sql('view', 'assists')},
         {_measure_sql('error', 'turnovers')}, {_measure_sql('signup', 'blocks')},
         {_count_sql('fga', 'purchase', 'click')}, {_count_sql('fta', 'view')}, {_count_sql('oreb', 'signup')},
         {_count_sql('fg3m', 'purchase')}, {_count_sql('fgm', 'click')}
  FROM events GROUP BY 1, 2))"""

_probs = ", ".join(
    _sql_prob(p, "o_orderkey", "o_custkey") for p in PROB_COEFS if p != "p_tabdl"
)
PREDICTIONS = f"""pr AS (
  SELECT *, CASE WHEN over_label IS NOT NULL THEN CASE WHEN (p_final >= 5e-1) = (over_label = 1) THEN 1 ELSE 0 END END AS is_correct
  FROM (SELECT o_orderkey AS id, o_custkey AS player_id, o_custkey AS cust, o_orderpriority AS stat_type,
    o_orderdate AS decision_time,
    CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS snapshot_id,
    CAST(floor(o_totalprice / 1000) AS DOUBLE) AS line_score,
    CASE o_orderstatus WHEN 'F' THEN 'over' WHEN 'O' THEN 'under' ELSE 'push' END AS outcome,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS over_label,
    CAST(floor(o_totalprice / 1000) AS DOUBLE) + CASE o_orderstatus WHEN 'F' THEN 3e0 WHEN 'O' THEN -2e0 ELSE 0e0 END AS actual_value,
    {_probs},
    CASE WHEN o_orderkey % 7 <> 0 THEN {_sql_prob('p_tabdl', 'o_orderkey', 'o_custkey').rsplit(' AS ', 1)[0]} END AS p_tabdl,
    CAST(o_custkey % 40 AS DOUBLE) AS n_eff,
    CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS conformal_set_size
  FROM orders))"""
RESOLVED = PREDICTIONS + ",\nrs AS (SELECT * FROM pr WHERE over_label IS NOT NULL)"

LINE_SNAPSHOTS = """ls AS (
  SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS snapshot_id, o_custkey AS player_id,
         o_orderpriority AS stat_type, CAST(floor(min(o_totalprice) / 1000) AS DOUBLE) AS line_score
  FROM orders GROUP BY 1, 2, 3)"""

_legs = "\n UNION ALL ".join(
    f"SELECT player_id, team, opp, game_date AS slate, minutes, '{name}' AS stat_type, {col} AS actual, "
    f"10e0 + 5e0 * (player_id % 5) AS line_score, (player_id * 100000 + {EPOCH_DAY.format('game_date')}) * 4 + {i} AS id FROM gl"
    for i, (name, col) in enumerate(zip(MEASURES, MEASURE_COLS))
)
_line_probs = ", ".join(_sql_prob(p, "id", "player_id") for p in PROB_COEFS if p != "p_tabdl")
LINES = GAME_LOG + f""",
ln AS (SELECT *, {_line_probs},
   CASE WHEN id % 7 <> 0 THEN {_sql_prob('p_tabdl', 'id', 'player_id').rsplit(' AS ', 1)[0]} END AS p_tabdl
  FROM ({_legs}))"""

MARKET = """mk AS (
  SELECT l_partkey AS game_id, CAST(l_shipdate AS DATE) AS captured_on, sum(l_quantity) + 180 AS total_points,
    CASE WHEN l_partkey % 4 <> 0 THEN round(max(l_discount) * 100 - 5, 1) END AS home_spread,
    CASE WHEN l_partkey % 5 <> 0 THEN round(max(l_tax) * 100 - 4, 1) END AS away_spread
  FROM lineitem GROUP BY 1, 2)"""
MARKET_PROBES = """mp AS (
  SELECT l_partkey AS game_id, CAST(min(o_orderdate) AS DATE) AS cutoff
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, date_trunc('month', o_orderdate))"""

TEAM_GAMES = GAME_LOG + """,
tg AS (SELECT team, game_date, min(opp) AS opp,
    CASE WHEN (list_position(%s, team) - 1 + day(game_date)) %% 2 = 0 THEN 1 ELSE 0 END AS is_home,
    round(sum(points), 2) AS points, round(sum(rebounds), 2) AS rebounds, round(sum(assists), 2) AS assists,
    round(sum(turnovers), 2) AS turnovers, round(sum(blocks), 2) AS blocks,
    sum(fga) AS fga, sum(fta) AS fta, sum(oreb) AS oreb, sum(fg3m) AS fg3m, sum(fgm) AS fgm
  FROM gl GROUP BY team, game_date)""" % sql_list(K.TEAMS)


# --- SQL fragments for the oracle ------------------------------------------------------------------

def q_logit(p: str, eps: str = "1e-7") -> str:
    q = f"greatest({eps}, least(1e0 - {eps}, {p}))"
    return f"ln({q} / (1e0 - {q}))"


def q_sig(z: str) -> str:
    return f"(1e0 / (1e0 + exp(-({z}))))"


def q_loss(y: str, p: str, eps: str = "1e-7") -> str:
    q = f"greatest({eps}, least(1e0 - {eps}, {p}))"
    return f"(-({y} * ln({q}) + (1e0 - {y}) * ln(1e0 - {q})))"


def q_cdf(z: str) -> str:
    t = f"(1e0 / (1e0 + 0.3275911e0 * abs({z}) / sqrt(2e0)))"
    poly = f"((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t}"
    erf = f"(1e0 - {poly} * exp(-({z}) * ({z}) / 2e0))"
    return f"(CASE WHEN ({z}) >= 0 THEN 5e-1 * (1e0 + {erf}) ELSE 5e-1 * (1e0 - {erf}) END)"


def q_sum(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def q_logit_mean(cols: list[str], eps: str = "1e-7") -> str:
    total = q_sum([f"CASE WHEN {x} IS NULL THEN 0e0 ELSE {q_logit(x, eps)} END" for x in cols])
    n = q_sum([f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in cols])
    return f"(CASE WHEN {n} > 0 THEN {q_sig(f'{total} / {n}')} ELSE 5e-1 END)"


def q_shrink(p: str, n: str, prior: str) -> str:
    k = f"(CASE WHEN {n} > 0 THEN 25e-2 - 2e-1 * least(1e0, {n} / 30e0) ELSE 25e-2 END)"
    return q_sig(f"(1e0 - {k}) * {q_logit(p)} + {k} * {q_logit(f'coalesce({prior}, 5e-1)')}")


def q_pick(p: str) -> str:
    return f"greatest({p}, 1e0 - {p})"


def q_hit(p: str, y: str) -> str:
    return f"(CASE WHEN {p} IS NOT NULL AND {y} IS NOT NULL THEN CASE WHEN ({p} >= 5e-1) = ({y} = 1) THEN 1e0 ELSE 0e0 END END)"


def q_r6(x: str) -> str:
    return f"(round({x}, 6) + 0e0)"


def q_case(mapping: dict, key: str, default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items())
    return f"(CASE {key} {arms} ELSE {default} END)"


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def reduce_sum(cols):
    return reduce(lambda a, b: a + b, cols)
