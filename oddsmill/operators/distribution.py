"""Exact order statistics without collecting a group: counts per value in ranges of equal size, then two-level prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions.exprs import num
from oddsmill.session import durable


def prefix_sums(df: DataFrame, keys: list[str], coarse: str, order: str, columns: dict[str, str]) -> DataFrame:
    """Add, per row, the sum over all rows that sort strictly before it inside its group.

    ``coarse`` is an order-preserving bucket of ``order``. Windows run inside (keys, bucket) and over the
    bucket totals, so one large group is spread over its buckets. ``order`` must be unique in a group.
    """
    inside = Window.partitionBy(*keys, coarse).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, coarse).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in columns.items()])
    ahead = Window.partitionBy(*keys).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, coarse, *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_o_{n}") for n in columns]
    )
    near = df.withColumns({f"_n_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in columns.items()})
    return (
        near.join(offsets, [*keys, coarse])
        .withColumns({n: F.col(f"_n_{n}") + F.col(f"_o_{n}") for n in columns})
        .drop(*[f"_n_{n}" for n in columns], *[f"_o_{n}" for n in columns])
    )


def ranged(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored ``counts`` with ``_b``, an order-preserving bucket of ``order`` inside each group.

    Buckets are ranges of (keys, order) that Spark's range partitioning chooses from a sample, so each holds about as many rows
    however the values are spread: a peaked column or one large group is cut like any other. Stored, because a second
    sample could place the edges elsewhere."""
    return durable(counts.repartitionByRange(*keys, order).withColumn("_b", F.spark_partition_id()))


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, levels: dict[str, Column | float]) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per level; ``n`` is the group size.

    A level may be a Column of ``n`` (a finite-sample corrected level, for example).
    """
    counts = ranged(value_counts(df, keys, value), keys, value)
    placed = prefix_sums(counts, keys, "_b", value, {"_before": "_cnt"})
    sizes = counts.groupBy(*keys).agg(F.sum("_cnt").alias("n"))
    if keys:
        placed = placed.join(sizes, keys)
    else:
        placed = placed.withColumn("n", sizes.select("n").scalar())
    aggs = []
    for name, level in levels.items():
        h = (F.col("n") - 1) * (level if isinstance(level, Column) else num(level))
        lo, hi = F.floor(h), F.ceil(h)

        def at(pos: Column) -> Column:
            inside = (F.col("_before") <= pos) & (pos < F.col("_before") + F.col("_cnt"))
            return F.max(F.when(inside, F.col(value)))

        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"), F.max(h - lo).alias(f"_f_{name}")]
    out = placed.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    return out.select(
        *keys, "n",
        *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in levels],
    )


def rank_auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve per group from counts per distinct score (ties count one half)."""
    counts = ranged(
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score)
        .agg(F.sum((F.col(label) == 1).cast("bigint")).alias("_pos"), F.sum((F.col(label) == 0).cast("bigint")).alias("_neg")),
        keys, score)
    placed = prefix_sums(counts, keys, "_b", score, {"_below": "_neg"})
    wins = F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / num(2)))
    out = placed.groupBy(*keys).agg(
        wins.alias("_w"), F.sum("_pos").cast("double").alias("_p"), F.sum("_neg").cast("double").alias("_q")
    )
    pairs = F.col("_p") * F.col("_q")
    return out.select(*keys, F.when(pairs > 0, F.col("_w") / pairs).alias("auc"))
