"""Equi-join operators: entity resolution, fallbacks, indicators, decomposition and set operations.

Dimension sides (teams, override maps) are constants held in the expression, so no broadcast depends on data
size; every other side is left to Catalyst and AQE, which check sizes and split skewed keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, count_true, num, r6


def eastern_date(ts: Column) -> Column:
    """Calendar date in New York of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """First n rows per key. Spark keeps at most n rows per key and task before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def best_per_key(df: DataFrame, keys: list[str], order: list[str], newest: bool = True) -> DataFrame:
    """One row per key by a map-side combined max/min over a struct that starts with the order columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    pick = F.max(packed) if newest else F.min(packed)
    return df.groupBy(*keys).agg(pick.alias("_s")).select(*keys, "_s.*")


def resolve_by_key(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join on a normalised key, with a ``matched`` flag that is null-proof."""
    r = right.select(key, *columns, F.lit(True).alias("matched"))
    return left.join(r, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def with_fallback(left: DataFrame, primary: DataFrame, primary_keys: list[str], secondary: DataFrame,
                  secondary_keys: list[str], columns: list[str]) -> DataFrame:
    """Two equi joins; values of the first win as a whole row."""
    a = primary.select(*primary_keys, F.struct(*columns).alias("_a"))
    b = secondary.select(*secondary_keys, F.struct(*columns).alias("_b"))
    out = left.join(a, primary_keys, "left").join(b, secondary_keys, "left")
    best = F.coalesce("_a", "_b")
    source = F.when(F.col("_a").isNotNull(), "primary").when(F.col("_b").isNotNull(), "secondary").otherwise("none")
    return out.withColumns({c: best[c] for c in columns} | {"source": source}).drop("_a", "_b")


def decompose_combos(lines: DataFrame, players: DataFrame, stats: DataFrame, line_id: str, name: str,
                     game: str, measures: list[str], key_of) -> DataFrame:
    """'A + B' lines: every part must resolve to a player with a box score in the game; measures are summed."""
    parts = lines.select(line_id, game, F.explode(F.split(name, r"\s*\+\s*")).alias("_part")).filter(F.trim("_part") != "")
    keyed = parts.withColumn("name_key", key_of(F.col("_part"))).filter(F.col("name_key").isNotNull())
    found = (
        keyed.join(players.select("name_key", "player_id"), "name_key", "left")
        .join(stats.select(game, "player_id", *measures, F.lit(1).alias("_has")), [game, "player_id"], "left")
    )
    return (
        found.groupBy(line_id)
        .agg(F.count(F.lit(1)).alias("expected"), F.count("_has").alias("matched"), *[F.sum(m).alias(m) for m in measures])
        .filter(F.col("expected") == F.col("matched"))
    )


def priority_merge(official: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which an official row hides every fallback row of its key. No window: an anti join."""
    return official.unionByName(fallback.join(official.select(*keys), keys, "left_anti"))


def match_rates(rows: DataFrame, keys: list[str], day: str, official: DataFrame, planned: DataFrame) -> DataFrame:
    """Share of rows whose keys exist in two game tables, and in the official one among days it covers."""
    a = official.select(*keys).distinct().withColumn("_a", F.lit(True))
    d = official.select(day).distinct().withColumn("_d", F.lit(True))
    b = planned.select(*keys).distinct().withColumn("_b", F.lit(True))
    flagged = rows.join(a, keys, "left").join(d, day, "left").join(b, keys, "left")
    out = flagged.agg(
        F.count(F.lit(1)).alias("rows_with_keys"), F.count("_a").alias("rows_matching_official"),
        F.count("_d").alias("rows_on_covered_days"), F.count("_b").alias("rows_matching_planned"))
    n = F.col("rows_with_keys")
    return out.withColumns({
        "match_rate": F.when(n > 0, F.round(F.col("rows_matching_official") / n, 4)).otherwise(num(0)),
        "match_rate_covered": F.when(F.col("rows_on_covered_days") > 0, F.round(F.col("rows_matching_official") / F.col("rows_on_covered_days"), 4)),
        "planned_match_rate": F.when(n > 0, F.round(F.col("rows_matching_planned") / n, 4)).otherwise(num(0)),
    })


def outcome(actual: Column, line: Column) -> Column:
    return F.when(actual.isNull() | line.isNull(), F.lit(None)).when(actual > line, "over").when(actual < line, "under").otherwise("push")


def sum_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
