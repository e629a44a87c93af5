"""As-of joins as windows: no range join, no pair blow-up.

Three shapes cover every use:

* ``asof_latest`` - the latest captured row per key before (or at) a probe time: sorted scans of equal ranges
  of (key, time), and one carried row per (key, range). A key that holds nine tenths of all rows is split
  over as many ranges, even on one day.
* ``strict_prior`` - aggregates over the history strictly before a probe *day*, for history that has at
  most one row per (key, day): the group is bounded by the number of days, never by the event count.
* ``attach_prior`` - equi-join of any number of probes to those day-level results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.session import durable


def asof_latest(probe: DataFrame, build: DataFrame, keys: list[str], probe_time: str, build_time: str,
                values: list[str], inclusive: bool, prefix: str = "", tie: list[str] = (), kind: str = "timestamp_ntz") -> DataFrame:
    """Left as-of join. ``inclusive`` lets a build row at exactly the probe time count. Of build rows at one time the
    one with the largest ``tie`` columns counts (by default the largest values). Null keys and times match nothing.
    "Times" may be of any ordered ``kind``, so that steps of a function are looked up in the same way.

    Both sides are dealt out by ranges of (key, time, side, tie) and stored once. A range hands on one row per key, its
    last build row; the latest of those from the ranges before joins the range as its first row. So one sorted scan
    inside a range answers every probe, and no key, day or instant can fill a task by itself."""
    side_probe, side_build = (1, 0) if inclusive else (0, 1)
    payload = F.struct(*[F.col(v) for v in values])
    known = reduce(lambda a, c: a & F.col(c).isNotNull(), [*keys, build_time], F.lit(True))
    right = build.filter(known).select(
        *keys, F.col(build_time).cast(kind).alias("_t"), F.lit(side_build).alias("_side"),
        F.struct(*[F.col(c) for c in tie or values]).alias("_tie"), payload.alias("_v"), F.lit(None).cast(F_struct(probe)).alias("_p"),
    )
    left = probe.select(
        *keys, F.col(probe_time).cast(kind).alias("_t"), F.lit(side_probe).alias("_side"),
        F.lit(None).cast(right.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(right.schema["_v"].dataType).alias("_v"), F.struct(*probe.columns).alias("_p"),
    )
    ranges = ranged(left.unionByName(right).withColumn("_row", F.monotonically_increasing_id()), [*keys, "_t", "_side", "_tie", "_row"])
    last = ranges.filter(F.col("_v").isNotNull()).groupBy(*keys, "_range").agg(F.max(F.struct("_t", "_tie", "_v")).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)   # one row per key and range
    met = ranges.groupBy(*keys, "_range").agg(F.lit(None).cast(last.schema["_last"].dataType).alias("_last"))
    carry = met.join(last.withColumnRenamed("_last", "_own"), [*keys, "_range"], "left").select(
        *keys, "_range", F.last("_own", ignorenulls=True).over(earlier).alias("_far")).filter(F.col("_far").isNotNull())
    rows = ranges.select(*keys, "_range", F.lit(1).alias("_from"), "_t", "_side", "_tie", "_v", "_p").unionByName(
        carry.select(*keys, "_range", F.lit(0).alias("_from"), F.col("_far._v").alias("_v")), allowMissingColumns=True)
    count = (ranges.agg(F.max("_range")).first()[0] or 0) + 1
    inside = Window.partitionBy("_range", *keys).orderBy("_from", "_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.repartitionById(count, "_range").withColumn("_near", F.last("_v", ignorenulls=True).over(inside)).filter(F.col("_p").isNotNull())
    return seen.select("_p.*", *[F.when(F.col("_t").isNotNull(), F.col("_near")[v]).alias(prefix + v) for v in values])


def ranged(df: DataFrame, order: list[str], name: str = "_range") -> DataFrame:
    """``df`` dealt out by ranges of ``order``, whose last column is distinct, and stored with the number of each row's range."""
    return durable(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def F_struct(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType


def probe_spine(history: DataFrame, probes: DataFrame, keys: list[str], day: str, cutoff: str) -> DataFrame:
    """History rows plus one marker row per distinct (key, cutoff day). ``_probe`` is 1 on markers."""
    marks = probes.select(*keys, F.col(cutoff).cast("date").alias(day)).distinct().withColumn("_probe", F.lit(1))
    return history.withColumn("_probe", F.lit(0)).unionByName(marks, allowMissingColumns=True).withColumn(
        "_day", F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    )


def before_day(keys: list[str]):
    """Everything on an earlier day: strict by day, however many markers share the day."""
    return Window.partitionBy(*keys).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)


def strict_prior(history: DataFrame, probes: DataFrame, keys: list[str], day: str, cutoff: str,
                 columns: dict[str, "callable"]) -> DataFrame:
    """One row per distinct (key, cutoff day) with aggregates over strictly earlier days."""
    spine = probe_spine(history, probes, keys, day, cutoff)
    spec = before_day(keys)
    return (
        spine.withColumns({name: make(spec) for name, make in columns.items()})
        .filter(F.col("_probe") == 1).select(*keys, F.col(day).alias("_cut"), *columns)
    )


def attach_prior(probes: DataFrame, prior: DataFrame, keys: list[str], cutoff: str) -> DataFrame:
    return (
        probes.withColumn("_cut", F.col(cutoff).cast("date")).join(prior, [*keys, "_cut"], "left").drop("_cut")
    )


def last_k(values: Column, k: int) -> Column:
    """The last k entries of an array (all of it when shorter)."""
    n = F.size(values)
    return F.slice(values, F.greatest(F.lit(1), n - k + 1), F.lit(k))


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(F.lit(0.0))


def array_std(a: Column) -> Column:
    """Population standard deviation of an array of doubles, two-pass."""
    mean = array_mean(a)
    ss = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.when(F.size(a) > 0, F.sqrt(ss / F.size(a))).otherwise(F.lit(0.0))
