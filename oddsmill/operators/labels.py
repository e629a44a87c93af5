"""Outcome resolution and the training frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, count_true, num
from oddsmill.session import merged

from .matching import outcome
from .ordering import sorted_positions


def candidates(df: DataFrame, required: list[str], days: int = 21, lag_hours: int = 3, limit: int = 10_000) -> DataFrame:
    """The ``limit`` oldest unresolved rows that are old enough to have an outcome and have all ``required`` columns.
    ``remaining`` counts those that are left for later runs."""
    clock = df.agg(F.max("decision_time")).scalar()
    d = df.withColumn("_c", clock)
    t = F.col("decision_time")
    inside = (t >= F.col("_c") - F.make_dt_interval(days=F.lit(days))) & (t <= F.col("_c") - F.make_dt_interval(hours=F.lit(lag_hours)))
    complete = F.lit(True)
    for c in required:
        complete &= F.col(c).isNotNull()
    open_rows = d.filter(F.col("actual_value").isNull() & inside & complete).drop("_c")
    left = open_rows.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0))).scalar()
    return open_rows.orderBy("decision_time", "id").limit(limit).withColumn("remaining", left)


def resolve(lines: DataFrame, players: DataFrame, games: DataFrame, boxes: DataFrame, box_counts: DataFrame, value: Column, keep_open: bool = False) -> DataFrame:
    """Line -> player -> game -> box score -> label.

    ``players``: player_id, official_player; ``games``: game_id, game_date, official_id (null when unknown);
    ``boxes``: official_player, game_date and measures; ``box_counts``: official_id, box_rows.
    A game with box scores in which the player has none is void: graded as a push at the line. Lines that no fact
    decides drop out, or stay without an outcome if ``keep_open``.
    """
    j = (
        lines.join(merged(players), "player_id").join(games, "game_id")
        .join(box_counts, "official_id", "left")
        .join(merged(boxes).withColumn("_hit", F.lit(True)), ["official_player", "game_date"], "left")
    )
    has = F.col("_hit").isNotNull()
    forced = ~has & F.col("line_score").isNotNull() & (F.coalesce("box_rows", F.lit(0)) > 0)
    j = j.withColumns({"matched": has, "forced_push": forced}).withColumn(
        "actual_value", F.when(F.col("forced_push"), F.col("line_score").cast("double")).otherwise(value))
    known = F.col("actual_value").isNotNull() & F.col("line_score").isNotNull()
    j = j if keep_open else j.filter(known)
    res = F.when(~known, F.lit(None)).when(F.col("forced_push"), "push").otherwise(outcome(F.col("actual_value"), F.col("line_score")))
    j = j.withColumn("outcome", res)
    return j.withColumns({
        "over_label": F.when(F.col("outcome") == "over", 1).when(F.col("outcome") == "under", 0),
        "is_correct": F.when((F.col("outcome") != "push") & F.lower("pick").isin("over", "under"), F.lower("pick") == F.col("outcome")),
    })


def fill_labels(log: DataFrame, labels: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """First written label wins: columns change only where the log has no actual value yet."""
    new = labels.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    open_row = F.col("actual_value").isNull()
    j = log.join(merged(new), key, "left")
    return j.select(*[F.when(open_row, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in log.columns])


def summary(resolved: DataFrame, n_candidates: Column) -> DataFrame:
    """Counts over lines from ``resolve`` with ``keep_open``: a line with a box score is matched, graded or not."""
    push = F.col("outcome") == "push"
    return resolved.agg(
        n_candidates.alias("candidates"), count_true(F.col("matched")).alias("matched_boxscores"), F.count("outcome").alias("updated"),
        count_true(F.coalesce("is_correct", F.lit(False))).alias("wins"), count_true(~F.coalesce("is_correct", F.lit(True))).alias("losses"),
        count_true(push).alias("pushes"), count_true(F.col("forced_push")).alias("forced_push"))


def canonical(df: DataFrame) -> DataFrame:
    return df.filter(F.col("outcome").isin("over", "under") & F.col("over_label").isNotNull() & F.col("actual_value").isNotNull())


# --- folds by position ---------------------------------------------------------------------------------------
def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Position and total of every row in time order."""
    seq = sorted_positions(df, order)
    return seq.withColumn("n", seq.agg(F.count(F.lit(1))).scalar())


def holdout(ratio: float = 0.2) -> Column:
    return F.when(F.col("idx") >= F.floor(F.col("n") * num(1 - ratio)), "test").otherwise("train")


def expanding_fold(k: int = 5) -> Column:
    """Test fold of an expanding split with equal test blocks at the end; null while only training."""
    size = F.floor(F.col("n") / (k + 1))
    start = F.col("n") - size * k
    return F.when(F.col("idx") >= start, F.floor((F.col("idx") - start) / size)).cast("bigint")


def prequential_fold(k: int) -> Column:
    folds = F.least(F.lit(k), F.col("n"))
    base, extra = F.floor(F.col("n") / folds), F.col("n") % folds
    edge = extra * (base + 1)
    return F.when(F.col("idx") < edge, F.floor(F.col("idx") / (base + 1))).otherwise(extra + F.floor((F.col("idx") - edge) / base)).cast("bigint")


def walk_fold(k: int, first: float = 0.4) -> Column:
    start = F.floor(F.col("n") * num(first))
    size = F.floor((F.col("n") - start) / k)
    return F.when(F.col("idx") >= start, F.least(F.floor((F.col("idx") - start) / size), F.lit(k - 1))).cast("bigint")


# --- training frame --------------------------------------------------------------------------------------------
def training_frame(df: DataFrame, keys: list[str], time: str, categoricals: list[str], numerics: list[str], counts: list[str]) -> DataFrame:
    """Drop combos, live and started rows, label, keep the earliest row per key, fill gaps, log the counts."""
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rows = df.filter(off("is_combo") & off("is_live") & off("in_game") & ~F.coalesce("player_name", F.lit("")).contains("+")
                     & (F.coalesce("minutes_to_start", num(0)) >= 0)).dropna(subset=["line_score", "actual", time])
    rows = rows.withColumn("over", (F.col("actual") > F.col("line_score")).cast("int"))
    from .matching import best_per_key

    first = best_per_key(rows, keys, [time, "id"], newest=False)
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in categoricals}
    filled |= {c: F.coalesce(F.col(c).cast("double"), num(0)) for c in numerics}
    filled |= {c: F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), num(0)), num(0))) for c in counts}
    return first.withColumns(filled)


def one_hot(column: str, values: list[str]) -> list[Column]:
    clean = lambda v: "".join(ch if ch.isalnum() else "_" for ch in v)
    return [(F.col(column) == v).cast("double").alias(f"{column}_{clean(v)}") for v in values]


def category_index(train: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values numbered from 1."""
    return sorted_positions(train.select(column).filter(F.col(column).isNotNull()).distinct(), [column], "_i").select(column, (F.col("_i") + 1).alias("code"))


def encode(df: DataFrame, index: DataFrame, column: str) -> DataFrame:
    return df.join(index, column, "left").withColumn("code", F.coalesce("code", F.lit(0)).cast("bigint"))
