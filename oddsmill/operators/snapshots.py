"""Versioned line snapshots: previous snapshot, movement, latest-per-key and slate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions.exprs import count_true, num

from .matching import best_per_key, eastern_date


def previous_snapshot(snapshots: DataFrame) -> DataFrame:
    """Latest earlier snapshot of the same league. One row per snapshot, so the window stays small."""
    w = Window.partitionBy("league").orderBy("fetched_at", "snapshot_id")
    return snapshots.withColumn("prev_snapshot_id", F.lag("snapshot_id").over(w))


def movement(current: Column, previous: Column) -> Column:
    return (F.when(current.isNull(), F.lit(None)).when(previous.isNull(), "new").when(current > previous, "up").when(current < previous, "down").otherwise("same"))


def line_movement(lines: DataFrame, snapshots: DataFrame, keys: list[str], line: str = "line_score", tie: str = "id") -> DataFrame:
    """Movement against the previous *snapshot*: a key that skipped it is new. Keys match null-safely; if a key
    occurs twice in the previous snapshot the smallest id counts."""
    prev = previous_snapshot(snapshots).select("snapshot_id", "prev_snapshot_id")
    cur = lines.join(prev, "snapshot_id")
    old = lines.groupBy("snapshot_id", *keys).agg(F.min_by(line, tie).alias("prev_line")).withColumnsRenamed({k: f"_{k}" for k in keys})
    old = old.withColumnRenamed("snapshot_id", "_snap")
    cond = F.col("prev_snapshot_id") == F.col("_snap")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    j = cur.join(old, cond, "left").drop("_snap", *[f"_{k}" for k in keys])
    return j.withColumns({"delta": F.col(line) - F.col("prev_line"), "movement": movement(F.col(line), F.col("prev_line"))})


def latest_of(df: DataFrame, column: str, order: list[str]) -> Column:
    """Scalar: ``column`` of the last row in order."""
    return df.agg(F.max(F.struct(*order, column)).alias("m")).select(f"m.{column}").scalar()


def snapshot_for_date(lines: DataFrame, day: str) -> DataFrame:
    """Latest snapshot that has a standard line on an Eastern slate date."""
    hits = lines.filter((F.coalesce("odds_type", F.lit(0)) == 0) & (eastern_date(F.col("start_time").cast("timestamp")) == F.lit(day).cast("date")))
    return hits.agg(F.max(F.struct("fetched_at", "snapshot_id")).alias("m")).select("m.snapshot_id").filter("snapshot_id IS NOT NULL")


def recent_summaries(log: DataFrame, n: int) -> DataFrame:
    """The last n snapshots by decision time, with counts over the latest row per line."""
    heads = log.groupBy("snapshot_id").agg(F.max("decision_time").alias("scored_at")).orderBy(F.desc("scored_at"), F.desc("snapshot_id")).limit(n)
    latest = best_per_key(log.join(heads, "snapshot_id", "left_semi"), ["snapshot_id", "line_id"], ["decision_time", "id"])
    counts = latest.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("total_scored"), count_true(F.col("publishable")).alias("publishable_count"))
    out = heads.join(counts, "snapshot_id")
    return out.withColumn("publishable_ratio", F.round(F.col("publishable_count") / F.col("total_scored"), 4))
