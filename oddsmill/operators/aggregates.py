"""Grouped aggregates: team games, league means, audits, coverage, health counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, count_true, num, r6

from .distribution import rank_auc  # noqa: F401  (re-exported for report users)

TWO_DP = ["points", "rebounds", "assists", "turnovers", "blocks"]
WHOLE = ["fga", "fta", "oreb", "fg3m", "fgm"]


def team_game_stats(log: DataFrame) -> DataFrame:
    """Box scores summed per team and day, with opponent and home flag (home on even team index + day)."""
    index = F.array_position(F.array(*[F.lit(x) for x in K.TEAMS]), F.col("team")) - 1
    return (
        log.groupBy("team", "game_date")
        .agg(F.min("opp").alias("opp"), *[F.round(F.sum(m), 2).alias(m) for m in TWO_DP], *[F.sum(m).alias(m) for m in WHOLE])
        .withColumn("is_home", F.when((index + F.dayofmonth("game_date")) % 2 == 0, 1).otherwise(0))
    )


def long_log(log: DataFrame, measures: dict[str, str], extra: list[str] = ()) -> DataFrame:
    """Unpivot a game log into one row per (player, day, measure): column name -> display name."""
    legs = F.explode(F.array(*[F.struct(F.lit(n).alias("stat_type"), F.col(c).cast("double").alias("value")) for c, n in measures.items()]))
    return log.select("player_id", "game_date", "minutes", *extra, legs.alias("_l")).select(
        "player_id", "game_date", "minutes", *extra, "_l.stat_type", "_l.value")


def means(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.agg(*[r6(F.avg(v)).alias(k) for k, v in columns.items()])


def top_share(df: DataFrame, key: str) -> DataFrame:
    """Counts per value plus each value's share of the total; the window runs over one row per value."""
    from pyspark.sql import Window

    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    return counts.withColumns({"share": F.round(F.col("n") / F.sum("n").over(everything), 4),
                               "top_share": F.round(F.max("n").over(everything) / F.sum("n").over(everything), 4)})


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.round(X.share(F.col(c).isNotNull()), 4).alias(c) for c in columns])


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule in one pass, returned as rows. A null passes, as a CHECK constraint would."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[count_true(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()])
    return one.unpivot(["_n"], list(rules), "rule", "violations").select("rule", "violations", F.col("_n").alias("rows"))


def collection_health(log: DataFrame, hours: int) -> DataFrame:
    """Per-source counters of an event log inside the last ``hours`` before the newest event."""
    clock = log.agg(F.max("ts")).scalar()
    e = F.col("event")
    recent = log.withColumn("_clock", clock).filter(F.col("ts") >= F.col("_clock") - F.make_dt_interval(hours=F.lit(hours)))
    n = lambda kind: count_true(e == kind)
    out = recent.groupBy("source").agg(
        n("request_end").alias("requests"), n("request_error").alias("errors"), n("cache_hit").alias("cache_hits"),
        n("cache_miss").alias("cache_misses"), n("circuit_open").alias("circuit_opens"),
        count_true((e == "validation") & ~F.coalesce("valid", F.lit(False))).alias("validation_failures"),
        F.coalesce(F.sum(F.when(e == "request_end", F.col("elapsed_ms"))), num(0)).alias("_ms"),
        F.max_by("error", F.when(e == "request_error", F.struct("ts", "id"))).alias("last_error"))
    ratio = lambda a, b, d: F.when(b > 0, F.round(a / b, d)).otherwise(num(0))
    hits, misses, req, err = F.col("cache_hits"), F.col("cache_misses"), F.col("requests"), F.col("errors")
    return out.withColumns({"avg_elapsed_ms": ratio(F.col("_ms"), req, 3), "cache_hit_rate": ratio(hits, hits + misses, 3),
                            "error_rate": ratio(err, req + err, 3)}).drop("_ms")


def correlated_pairs(df: DataFrame, columns: list[str], floor: float) -> DataFrame:
    """All pairs with |r| at or above ``floor``: every correlation comes from one aggregate over the table."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    parts = F.split("pair", r"\|")
    return long.filter(F.abs("r") >= floor).select(parts[0].alias("a"), parts[1].alias("b"), r6("r").alias("r"))


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample deviation per column (deviation 1 when it is missing or below 1e-8)."""
    one = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns])
    safe = F.col("v.s").isNull() | (F.col("v.s") < 1e-8)
    return one.unpivot([], columns, "feature", "v").select(
        "feature", r6("v.m").alias("mean"), r6(F.when(safe, num(1)).otherwise(F.col("v.s"))).alias("std"))


def key_audit(df: DataFrame, keys: list[str]) -> tuple[Column, Column]:
    return F.count(F.lit(1)), F.count_distinct(*keys)


__all__ = [n for n in dir() if not n.startswith("_")] + ["big"]
