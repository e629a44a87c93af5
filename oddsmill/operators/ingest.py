"""Load-time operators: dedupe, upsert, insert-ignore, split, purge. Updates are rewrites by key: the result is a
new frame, and a caller writes it to a new path, never over the files it was read from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.functions import coerce as C
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import num


def within_dates(df: DataFrame, day: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive range with either bound optional; rows without a date drop out once a bound is set."""
    out = df.filter(F.col(day).isNotNull()) if start or end else df
    if start:
        out = out.filter(F.col(day) >= F.lit(start).cast("date"))
    return out.filter(F.col(day) <= F.lit(end).cast("date")) if end else out


def merge_duplicates(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per key; per column the last non-null value in order. Map-side combined, no window."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_when_null: list[str] | None = None) -> DataFrame:
    """Full outer merge. Columns in ``keep_old_when_null`` (all, by default) keep the stored value when the new one
    is null; the others take the new row's value even when it is null."""
    cols = [c for c in old.columns if c not in keys]
    soft = set(cols if keep_old_when_null is None else keep_old_when_null)
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols])
    n = new.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    j = o.join(n, keys, "full_outer")
    value = lambda c: F.coalesce(f"_n_{c}", f"_o_{c}") if c in soft else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
    return j.select(*keys, *[value(c).alias(c) for c in cols])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def first_keyed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per complete key; rows with a missing key pass through."""
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rest = [c for c in df.columns if c not in keys]
    packed = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    kept = df.filter(complete).groupBy(*keys).agg(packed.alias("_s")).select(*keys, "_s.*")
    return kept.unionByName(df.filter(~complete))


def split_matchup(text: Column) -> dict[str, Column]:
    """'A vs. B' has A at home, 'A @ B' has B at home."""
    home, away = F.split(text, r" vs\. "), F.split(text, " @ ")
    side = lambda c: X.team_code(F.trim(c))
    return {"home": F.when(F.size(home) == 2, side(F.get(home, 0))).when(F.size(away) == 2, side(F.get(away, 1))),
            "away": F.when(F.size(home) == 2, side(F.get(home, 1))).when(F.size(away) == 2, side(F.get(away, 0)))}


def split_game_log(wide: DataFrame) -> dict[str, DataFrame]:
    """Wide log rows to players, games and stats. Rows carry ``seq``, their order in the load."""
    sides = split_matchup(F.coalesce("matchup", F.lit("")))
    rows = wide.withColumns({k: v for k, v in sides.items()} | {"team_code": X.team_code("team")})
    rows = rows.withColumns({"player_id": C.normalize_id(F.col("player_id").cast("string")), "game_id": C.normalize_id(F.col("game_id").cast("string"))})
    measures = ["minutes", "points", "rebounds", "assists"]
    return {
        "players": merge_duplicates(rows.filter("player_id IS NOT NULL"), ["player_id"], ["seq"], ["player_name", "team_code"]),
        "games": merge_duplicates(rows.filter("game_id IS NOT NULL"), ["game_id"], ["seq"], ["game_date", "home", "away"]),
        "stats": merge_duplicates(rows.filter("game_id IS NOT NULL AND player_id IS NOT NULL"), ["game_id", "player_id"], ["seq"], [*measures, "team_code"]),
    }


def odds_label(code: Column, raw: Column) -> Column:
    return F.when(F.coalesce(code, F.lit(0)) == 0, "standard").when(code == 1, "goblin").when(code == 2, "demon").otherwise(F.lower(F.coalesce(raw, F.lit("unknown"))))


def effective_odds(code: Column, raw: Column) -> Column:
    t = F.lower(F.coalesce(raw, F.lit("standard")))
    return F.coalesce(code, F.when(t == "goblin", 1).when(t == "demon", 2).otherwise(0))


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes, rounded down, null when either is missing."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / num(6e7))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5): SHA-1 of namespace bytes and name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    variant = F.substring(F.lit("89ab"), nibble + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def prediction_rows(raw: DataFrame) -> DataFrame:
    """Log rows from loosely typed input: probability and time fall back, the pick is normalised, the row itself is kept as JSON."""
    p = F.coalesce(C.parse_double("prob_over"), C.parse_double("p_final"))
    clock = raw.agg(F.max(C.parse_timestamp("created_at"))).scalar()
    when_ = F.coalesce(C.parse_timestamp("decision_time"), C.parse_timestamp("created_at"), clock)
    out = raw.withColumn("details", F.to_json(F.struct(*raw.columns))).withColumn("_id", C.normalize_id("projection_id")).filter("_id IS NOT NULL")
    return out.withColumn("_p", p).select(
        F.col("_id").alias("projection_id"), when_.alias("decided_at"), F.col("_p").alias("probability"), C.normalize_pick("pick", F.col("_p")).alias("side"),
        F.nullif("stat_type", F.lit("")).alias("stat_type"), C.parse_double("line_score").alias("line"), "details")
