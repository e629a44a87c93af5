"""Leakage-safe history of a (player, measure) before a cut-off day.

Nothing depends on the probe except the line, so every feature but ``wins`` is computed once per distinct
(player, measure, cut-off day) and attached by an equi join. The log has at most one row per (player, day):
windows and arrays of one player are bounded by days, however many raw events a player has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import num
from oddsmill.session import merged

from . import asof as A

KEYS = ["player_id", "stat_type"]


def recent_tail(log: DataFrame, k: int = 10, keys: list[str] = KEYS) -> DataFrame:
    """Add the last k (value, minutes) pairs up to and including each log row."""
    w = Window.partitionBy(*keys).orderBy("game_date").rowsBetween(-(k - 1), 0)
    return log.withColumn("_tail", F.collect_list(F.struct("value", "minutes")).over(w))


def day_features(log: DataFrame, probes: DataFrame, cutoff: str = "slate") -> DataFrame:
    """One row per distinct (player, measure, cut-off day)."""
    base = A.strict_prior(recent_tail(log), probes, KEYS, "game_date", cutoff, {
        "n": lambda w: F.count("value").over(w), "_mean": lambda w: F.avg("value").over(w),
        "_std": lambda w: F.stddev_pop("value").over(w),
        "_last": lambda w: F.max(F.when(F.col("_probe") == 0, F.col("game_date"))).over(w),
        "_recent": lambda w: F.last("_tail", ignorenulls=True).over(w),
    })
    n, mean = F.col("n"), F.coalesce("_mean", num(0))
    recent = F.coalesce("_recent", F.array().cast("array<struct<value:double,minutes:double>>"))
    base = base.withColumns({"_v": recent["value"], "_m": recent["minutes"], "hist_mean": mean,
                             "hist_std": F.when(n > 1, F.col("_std")).otherwise(num(1))})
    v, m = F.col("_v"), F.col("_m")
    mv = {k: A.array_mean(A.last_k(v, k)) for k in (3, 5, 10)}
    mm = {k: A.array_mean(A.last_k(m, k)) for k in (3, 5, 10)}
    gap = F.when(F.col("_last").isNotNull(), F.greatest(F.datediff("_cut", "_last") - 1, F.lit(0)).cast("double"))
    size = F.size(v).cast("double")
    centre = (size - 1) / num(2)
    lean = F.aggregate(F.transform(v, lambda x, i: (i.cast("double") - centre) * x), num(0), lambda s, x: s + x)
    std10 = A.array_std(A.last_k(m, 10))
    out = base.withColumns({
        "rest_days": F.coalesce(gap, num(0)), "is_back_to_back": F.when(gap == 0, num(1)).otherwise(num(0)),
        **{f"stat_mean_{k}": e for k, e in mv.items()}, **{f"minutes_mean_{k}": e for k, e in mm.items()},
        "trend_slope": F.when(size >= 3, lean / (size * (size * size - 1) / num(12))).otherwise(num(0)),
        "minutes_std_10": F.when(size >= 2, std10).otherwise(num(0)),
        "recent_load_3": F.aggregate(A.last_k(m, 3), num(0), lambda s, x: s + x),
        "stat_std_5": F.when(size >= 2, A.array_std(A.last_k(v, 5))).otherwise(num(0)),
    })
    mu, m3, m5, m10, s3, s5 = [F.col(c) for c in ("hist_mean", "minutes_mean_3", "minutes_mean_5", "minutes_mean_10", "stat_mean_3", "stat_mean_5")]
    return out.withColumns({
        "stat_cv": F.when((n >= 3) & (mu > 0), F.col("hist_std") / mu).otherwise(num(0)),
        "role_stability": num(1) / (num(1) + F.col("minutes_std_10")),
        "recent_vs_season": F.when((mu > 0) & (s3 > 0), s3 / mu).otherwise(num(1)),
        "minutes_trend": F.when((m10 > 0) & (m3 > 0), m3 / m10).otherwise(num(1)),
        "stat_rate_per_min": F.when((s5 > 0) & (m5 > 0), s5 / m5).otherwise(num(0)),
    }).drop("_mean", "_std", "_last", "_recent")


#: Rows that are worked on at once, days and questions of many keys; of a key that goes on, the values of its days are carried over.
SCANNED = 1 << 16
#: Questions of one key that one task answers, about; the questions of a larger key are dealt out, its days go to each part.
QUESTIONS = 200_000


def count_above(values: np.ndarray, start: np.ndarray, upto: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """How many of ``values[start[i]:upto[i]]`` exceed ``lines[i]``, for all questions at once.

    A prefix is a sum of blocks whose lengths are the powers of two in its end. Level by level all blocks of one length are
    sorted, and the questions whose prefix has such a block search it: n log n sorting, log n searches a question."""
    kinds = np.unique(values)
    rank, least = np.searchsorted(kinds, values), np.searchsorted(kinds, lines, side="right")
    base, out = len(kinds) + 1, np.zeros(len(lines), np.int64)
    for level in range(int(upto.max(initial=0)).bit_length()):
        size = 1 << level
        blocks = np.arange(len(values)) >> level
        ordered = np.sort(blocks * base + rank)
        for end, sign in ((upto, 1), (start, -1)):
            asked = np.flatnonzero(end >> level & 1)
            block = (end[asked] >> level) - 1
            out[asked] += sign * ((block + 1) * size - np.searchsorted(ordered, block * base + least[asked]))
    return out


def run_length(values: np.ndarray, start: np.ndarray, upto: np.ndarray, limits: np.ndarray, above: bool) -> np.ndarray:
    """How many values directly before ``upto[i]``, down to ``start[i]``, are all above (or all not above) ``limits[i]``.

    Smallest (largest) values of all stretches of 2^k are laid down; a question leaps over the longest stretches that hold."""
    most = int((upto - start).max(initial=0)).bit_length()
    tables, at = [values], upto.copy()
    for level in range(1, most):
        half, last = 1 << (level - 1), tables[-1]
        tables.append((np.minimum if above else np.maximum)(last[: len(last) - half], last[half:]) if len(last) > half else last[:0])
    for level in reversed(range(most)):
        size, table = 1 << level, tables[level]
        able = np.flatnonzero(at - size >= start)
        edge = table[at[able] - size]
        able = able[edge > limits[able] if above else edge <= limits[able]]
        at[able] -= size
    return upto - at


def _scanned(batches: Iterator[pa.RecordBatch], keys: int, compute, size: int) -> Iterator[pa.RecordBatch]:
    """Answers over rows sorted by (keys, day, kind): questions (kind 0) look at the days (kind 1) before them."""
    held, rows, last, carried = [], 0, None, np.zeros(0)

    def answered(table: pa.Table) -> pa.RecordBatch:
        nonlocal last, carried
        b = table.combine_chunks().to_batches()[0]
        kind, x = b.column(keys + 2).to_numpy(), b.column(keys + 3).to_numpy(zero_copy_only=False)
        changed = np.ones(len(kind), bool)
        changed[1:] = False
        for c in b.columns[: keys + 1]:   # the keys and the part; a null is never the same as another
            changed[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False)
        key = [c[0].as_py() for c in b.columns[: keys + 1]]
        changed[0] = key != last or None in key
        day = kind == 1
        values = np.concatenate((carried if not changed[0] else carried[:0], x[day]))
        before = np.cumsum(day) - day + (len(values) - int(day.sum()))
        start = np.maximum.accumulate(np.where(changed, before, 0))
        asked = np.flatnonzero(~day)
        found = compute(values, start[asked], before[asked], x[asked])
        last, carried = [c[len(kind) - 1].as_py() for c in b.columns[: keys + 1]], values[start[-1] :]
        rest = b.take(pa.array(asked))
        return pa.RecordBatch.from_arrays([*rest.columns[:keys], rest.column(keys + 1), rest.column(keys + 3), *found], [*b.schema.names[:keys], "_cut", "_x", *[f"_f{i}" for i in range(len(found))]])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= size:
            yield answered(pa.Table.from_batches(held))
            held, rows = [], 0
    if held:
        yield answered(pa.Table.from_batches(held))


def _with_days(log: DataFrame, asked: DataFrame, compute, kinds: list[str]) -> DataFrame:
    """``asked(keys, _cut, _x)`` with one column ``_f<i>`` per kind, computed over the key's earlier days.

    Days and questions are sorted together and scanned in Arrow batches that hold many keys. Questions of a key with more than
    ``QUESTIONS`` are dealt out in parts, each of which gets the key's days, so no key fills a task."""
    large = asked.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_q")).filter(F.col("_q") > QUESTIONS).select(*KEYS, F.ceil(F.col("_q") / QUESTIONS).cast("int").alias("_parts"))
    parts = lambda df: df.join(large, KEYS, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    days = log.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(*KEYS, F.col("game_date").cast("date").alias("_cut"), F.lit(1).alias("_kind"), F.col("value").cast("double").alias("_x"))
    days = parts(days).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    questions = parts(asked.withColumn("_kind", F.lit(0))).withColumn("_part", F.pmod(F.xxhash64("_cut", "_x"), F.col("_parts")).cast("int"))
    columns = [*KEYS, "_part", "_cut", "_kind", "_x"]
    both = days.select(columns).unionByName(questions.select(columns)).repartition(*KEYS, "_part").sortWithinPartitions(*KEYS, "_part", "_cut", "_kind")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.select(*KEYS, "_cut", "_x").schema) + "".join(f", _f{i} {k}" for i, k in enumerate(kinds))
    size = SCANNED
    return both.mapInArrow(lambda batches: _scanned(batches, len(KEYS), compute, size), shape)


def streaks(log: DataFrame, days: DataFrame) -> DataFrame:
    """Current run above, and not above, the own mean, per (player, measure, cut-off day)."""
    mean = F.when((F.col("n") > 0) & (F.col("hist_mean") > 0), F.col("hist_mean").cast("double")).otherwise(F.lit(float("nan")))

    def compute(values: np.ndarray, start: np.ndarray, upto: np.ndarray, means: np.ndarray) -> list[pa.Array]:
        return [pa.array(run_length(values, start, upto, means, above).astype(float)) for above in (True, False)]

    out = _with_days(log, days.select(*KEYS, "_cut", mean.alias("_x")), compute, ["double", "double"])
    return out.select(*KEYS, "_cut", F.col("_f0").alias("hot_streak_count"), F.col("_f1").alias("cold_streak_count"))


def line_wins(log: DataFrame, lines: DataFrame, cutoff: str = "slate") -> DataFrame:
    """History values over the line, once per distinct (player, measure, day, line); no pair is ever emitted."""
    kind = lines.schema["line_score"].dataType.simpleString()
    asked = lines.filter(F.col("line_score").isNotNull()).select(*KEYS, F.col(cutoff).cast("date").alias("_cut"), F.col("line_score").cast("double").alias("_x")).distinct()

    def compute(values: np.ndarray, start: np.ndarray, upto: np.ndarray, lines: np.ndarray) -> list[pa.Array]:
        return [pa.array(count_above(values, start, upto, lines).astype(np.int32))]

    return _with_days(log, asked, compute, ["int"]).select(*KEYS, "_cut", F.col("_x").cast(kind).alias("line_score"), F.col("_f0").alias("wins"))


def league_prior(log: DataFrame, probes: DataFrame, cutoff: str = "slate") -> DataFrame:
    """League mean of each measure over strictly earlier days; 0 before the first day."""
    daily = log.groupBy("stat_type", "game_date").agg(F.sum("value").alias("_s"), F.count("value").alias("_c"))
    prior = A.strict_prior(daily, probes, ["stat_type"], "game_date", cutoff, {
        "_ss": lambda w: F.sum("_s").over(w), "_cc": lambda w: F.sum("_c").over(w)})
    return prior.select("stat_type", "_cut", F.coalesce(F.col("_ss") / F.col("_cc"), num(0)).alias("league_mean"))


def attach(lines: DataFrame, days: DataFrame, cutoff: str = "slate") -> DataFrame:
    return A.attach_prior(lines, merged(days), KEYS, cutoff)


def stabilised(df: DataFrame) -> DataFrame:
    """Mean regressed to the league, standardised line distance, forecast edge."""
    k, n = X.stabilization("stat_type"), F.col("n")
    mu = (n * F.col("hist_mean") + k * F.col("league_mean")) / (n + k)
    z = X.clip((F.col("line_score") - mu) / (F.col("hist_std") + num(1e-6)), -10.0, 10.0)
    ratio = F.when(F.col("hist_mean") > 0, F.col("line_score") / F.col("hist_mean")).otherwise(num(1))
    return df.withColumns({"mu_stab": mu, "z_line": z, "forecast_edge": mu - F.col("line_score"), "line_vs_mean_ratio": ratio})


def with_history(lines: DataFrame, log: DataFrame, cutoff: str = "slate") -> DataFrame:
    """Lines with the full feature set."""
    days = day_features(log, lines, cutoff)
    out = attach(lines, days, cutoff)
    out = attach(out, streaks(log, days), cutoff)
    out = A.attach_prior(out, league_prior(log, lines, cutoff), ["stat_type"], cutoff)
    wins = line_wins(log, lines, cutoff).withColumnRenamed("_cut", cutoff)
    out = out.join(merged(wins), [*KEYS, cutoff, "line_score"], "left")
    return stabilised(out).withColumn("p_hist_over", (F.col("wins") + num(1)) / (F.col("n") + num(2)))


def sequence(days: DataFrame, length: int = 10) -> Column:
    """Last ``length`` (value, minutes), oldest first, left-padded with zeros."""
    zero = F.struct(num(0).alias("value"), num(0).alias("minutes"))
    have = F.arrays_zip(F.col("_v").alias("value"), F.col("_m").alias("minutes"))
    return F.concat(F.array_repeat(zero, F.lit(length) - F.size("_v")), have)
