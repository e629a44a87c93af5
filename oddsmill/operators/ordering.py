"""Exact positions in a total order, without a single-task window.

``sorted_positions`` range-partitions on the full order key (which ends in a unique column, so one hot
timestamp still splits), sorts inside partitions, stores the result durably and adds one offset per
partition. Everything that needs "row number over all rows" (folds, rolling rates, runs) uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.session import durable

_LOW_BITS = (1 << 33) - 1


def sorted_positions(df: DataFrame, order: list[Column | str], name: str = "idx") -> DataFrame:
    """Add the 0-based position of every row in ``order``."""
    placed = durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    ).withColumns({"_part": F.shiftright("_mid", 33), "_pos": F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))})
    # one row per partition, so the running sum and the broadcast are bounded by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_pos") + F.col("_off")).cast("bigint"))
        .drop("_mid", "_part", "_pos", "_off")
    )


def group_positions(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """0-based position inside each group, and the group size ``n_group``, for groups of any size."""
    placed = sorted_positions(df, [*keys, *order], "_g")
    spans = placed.groupBy(*keys).agg(F.min("_g").alias("_lo"), F.count(F.lit(1)).alias("n_group"))
    return (
        placed.join(spans, keys).withColumn(name, (F.col("_g") - F.col("_lo")).cast("bigint")).drop("_g", "_lo")
    )


def overlapping_blocks(df: DataFrame, idx: str, reach: int, block: int = 1 << 16) -> DataFrame:
    """Cut an indexed sequence into blocks that also carry the ``reach`` rows before them.

    Rows carry ``_blk`` and ``_own``; windows over ``_blk`` see every row they need, and ``_own`` rows
    appear once. Work per task is bounded by ``block + reach`` whatever the sequence length.
    """
    block = max(block, reach + 1)
    home = F.floor(F.col(idx) / block).cast("bigint")
    near_end = (F.col(idx) % block) >= block - reach
    blocks = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_blk", F.explode(blocks)).withColumn("_own", F.col("_blk") == home)


def rolling_sums(df: DataFrame, idx: str, window: int, columns: list[str], keys: list[str] = (),
                 include_current: bool = True, block: int = 1 << 16) -> DataFrame:
    """Sum ``s_<c>`` and non-null count ``n_<c>`` of each column over the last ``window`` rows, and ``seen``, the rows.

    Running sums per block minus their value ``window`` rows earlier: constant work per row whatever the window.
    Exact for flags and counts.
    """
    reach = window - 1 if include_current else window
    cut = overlapping_blocks(df, idx, reach, block)
    order = Window.partitionBy(*keys, "_blk").orderBy(idx)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    # one array per row: running sums and counts side by side, so a single lag serves all of them
    parts = [F.lit(1.0)] + [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns] + [F.col(c).isNotNull().cast("double") for c in columns]
    cut = cut.withColumns({f"_r{i}": F.sum(p).over(run) for i, p in enumerate(parts)})
    cut = cut.withColumn("_run", F.array(*[F.col(f"_r{i}") for i in range(len(parts))])).drop(*[f"_r{i}" for i in range(len(parts))])
    zero = F.array(*[F.lit(0.0)] * len(parts))
    if not include_current:
        cut = cut.withColumn("_top", F.coalesce(F.lag("_run", 1).over(order), zero))
        far = window + 1
    else:
        cut, far = cut.withColumn("_top", F.col("_run")), window
    cut = cut.withColumn("_low", F.coalesce(F.lag("_run", far).over(order), zero)).filter("_own")
    at = lambda i: F.get("_top", F.lit(i)) - F.get("_low", F.lit(i))
    k = len(columns)
    cut = cut.withColumns({"seen": at(0).cast("bigint")} | {f"s_{c}": at(1 + i) for i, c in enumerate(columns)} | {f"n_{c}": at(1 + k + i).cast("bigint") for i, c in enumerate(columns)})
    return cut.drop("_blk", "_own", "_run", "_top", "_low")
