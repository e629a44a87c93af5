"""Team and market context: rolling team series attached to lines strictly before the cut-off day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import num

from . import asof as A

WINDOW, MIN_GAMES = 15, 3
ALLOWED = ["points", "rebounds", "assists", "turnovers", "blocks", "fg3m", "fgm", "fga", "fta"]
RANKED = ["points", "rebounds", "assists", "turnovers", "blocks", "fg3m", "fgm"]


def rolling_mean(col: Column, keys: list[str], size: int = WINDOW, need: int = MIN_GAMES) -> Column:
    w = Window.partitionBy(*keys).orderBy("game_date").rowsBetween(-(size - 1), 0)
    return F.when(F.count(col).over(w) >= need, F.avg(col).over(w))


def team_pace(games: DataFrame) -> DataFrame:
    poss = F.col("fga") - F.col("oreb") + F.col("turnovers") + num(0.44) * F.col("fta")
    return games.select("team", "game_date", rolling_mean(poss, ["team"]).alias("team_pace"))


def allowed(games: DataFrame) -> DataFrame:
    """What each team let its opponents score: the other side's numbers, keyed by the defender."""
    return games.select(F.col("opp").alias("team"), "game_date", *[rolling_mean(F.col(m), ["opp"]).alias(f"opp_def_{m}") for m in ALLOWED])


def latest_before(series: DataFrame, probes: DataFrame, cutoff: str, columns: list[str], key: str = "team") -> DataFrame:
    """Latest row of a team series strictly before each distinct (team, cut-off day)."""
    packed = series.withColumn("_row", F.struct(*columns)).select(key, "game_date", "_row")
    prior = A.strict_prior(packed, probes, [key], "game_date", cutoff, {"_r": lambda w: F.last("_row", ignorenulls=True).over(w)})
    return prior.select(key, "_cut", *[F.col("_r")[c].alias(c) for c in columns])


def ranks_as_of(defence: DataFrame, days: DataFrame, columns: list[str]) -> DataFrame:
    """Ordinal rank of every team's latest value as of each day (1 = fewest allowed); ties go to the smaller code.

    ``days`` has one column ``_cut``; the team list is constant, so a day expands to at most thirty rows.
    """
    probes = days.select(F.col("_cut").alias("cutoff"), F.explode(F.array(*[F.lit(t) for t in K.TEAMS])).alias("team"))
    latest = latest_before(defence, probes, "cutoff", columns)
    long = latest.unpivot(["team", "_cut"], columns, "measure", "value").filter(F.col("value").isNotNull())
    w = Window.partitionBy("_cut", "measure").orderBy("value", "team")
    return long.select("team", "_cut", "measure", F.row_number().over(w).alias("rank"))


def latest_ranks(defence: DataFrame, columns: list[str]) -> DataFrame:
    last = defence.groupBy("team").agg(F.max_by(F.struct(*columns), "game_date").alias("r")).select("team", "r.*")
    long = last.unpivot(["team"], columns, "measure", "value").filter(F.col("value").isNotNull())
    return long.select("team", "measure", F.row_number().over(Window.partitionBy("measure").orderBy("value", "team")).alias("rank"))


def travel(games: DataFrame, lookback: int = 7) -> DataFrame:
    """Kilometres and clock shift between the last ``lookback`` venues; the venue is the home team's city."""
    place = F.when(F.col("is_home") == 1, F.col("team")).otherwise(F.col("opp"))
    at = lambda i: X.lookup({k: float(v[i]) for k, v in K.TEAM_GEO.items()}, place)
    w = Window.partitionBy("team").orderBy("game_date")
    legs = games.withColumns({"_la": at(0), "_lo": at(1), "_tz": at(2)})
    legs = legs.withColumns({
        "_km": X.haversine_km(F.lag("_la").over(w), F.lag("_lo").over(w), "_la", "_lo"),
        "_sh": F.abs(F.col("_tz") - F.lag("_tz").over(w))})
    span = w.rowsBetween(-(lookback - 2), 0)
    return legs.select("team", "game_date", F.coalesce(F.sum("_km").over(span), num(0)).alias("travel_km_7d"),
                       F.coalesce(F.sum("_sh").over(span), num(0)).alias("circadian_shift_hours"))


def market_features(captures: DataFrame, probes: DataFrame, key: str = "game_id", cutoff: str = "cutoff") -> DataFrame:
    """State of a market at a cut-off: captures on the cut-off day count."""
    marks = A.probe_spine(captures, probes, [key], "captured_on", cutoff)
    w = Window.partitionBy(key).orderBy("_day").rangeBetween(Window.unboundedPreceding, 0)
    spread = F.coalesce("home_spread", "away_spread")
    row = F.when(F.col("_probe") == 0, F.struct(F.col("total_points"), F.col("home_spread").alias("hs"), spread.alias("sp")))
    seen = marks.withColumns({
        "_now": F.last(row, ignorenulls=True).over(w), "_first": F.first(row, ignorenulls=True).over(w),
        "_n": F.count(row).over(w), "_ns": F.count(F.when(F.col("_probe") == 0, spread)).over(w),
        "_vol": F.stddev_pop(F.when(F.col("_probe") == 0, spread)).over(w)}).filter("_probe = 1")
    total, hs, many = F.col("_now.total_points"), F.col("_now.hs"), F.col("_n") >= 2
    implied = total / num(2) - hs / num(2)
    return seen.select(
        key, F.col("captured_on").alias(cutoff), F.coalesce(total, num(0)).alias("market_total_points"),
        F.coalesce(F.abs(F.col("_now.sp")), num(0)).alias("market_spread_abs"),
        F.when(many, F.coalesce(total - F.col("_first.total_points"), num(0))).otherwise(num(0)).alias("market_total_move"),
        F.when(many & (F.col("_ns") >= 2), F.col("_vol")).otherwise(num(0)).alias("market_volatility"),
        F.coalesce(implied, num(0)).alias("market_home_implied_total"),
        F.coalesce(total - implied, num(0)).alias("market_away_implied_total"))
