"""Measurement reports over resolved predictions. All are map-side combined aggregates; the few that need
a position in time take it from ``ordering.sorted_positions``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, count_true, num, r6

from .distribution import exact_quantiles, rank_auc
from .ordering import rolling_sums, sorted_positions


def with_pick(df: DataFrame, p: str = "p_final", y: str = "over_label", stat: str = "stat_type") -> DataFrame:
    """Add correct, p_pick, threshold and tier flags under the default policy."""
    threshold = X.threshold_for(num(K.PICK_THRESHOLD), "conformal_set_size")
    return df.withColumns({
        "correct": X.hit(p, y), "p_pick": X.p_pick(p), "threshold": threshold,
        "is_actionable": X.p_pick(p) >= threshold,
        "is_placed": (X.p_pick(p) >= threshold) & (F.coalesce(F.col("conformal_set_size"), F.lit(1)) != 2),
    })


def hit_rate(df: DataFrame) -> DataFrame:
    resolved = F.col("outcome").isin("over", "under") & F.col("over_label").isNotNull()
    correct = F.when(resolved & F.col("p_final").isNotNull(),
                     F.coalesce(F.col("is_correct").cast("double"), X.hit("p_final", "over_label")))
    return df.agg(
        F.count(F.lit(1)).alias("total_predictions"), count_true(resolved).alias("total_resolved"),
        F.count(correct).alias("total_scored"), r6(F.avg(correct)).alias("overall_hit_rate"),
    )


def rolling_hit(df: DataFrame, window: int, experts: list[str], order: list[str], points: int = 200) -> DataFrame:
    """Rolling hit rate of the ensemble and each expert, thinned to about ``points`` rows."""
    need = max(5, window // 4)
    flags = {"ens": X.hit("p_final", "over_label"), **{e: X.hit(e, "over_label") for e in experts}}
    seq = sorted_positions(df.select(*order, *[v.alias(f"h_{k}") for k, v in flags.items()]), order)
    total = seq.agg(F.count(F.lit(1))).scalar()
    n_points = total - (need - 1)
    step = F.when(n_points > points, F.greatest(F.lit(1), F.floor(n_points / points))).otherwise(F.lit(1))

    rolled = rolling_sums(seq, "idx", window, [f"h_{k}" for k in flags])
    mean = {k: F.when(F.col(f"n_h_{k}") >= need, F.col(f"s_h_{k}") / F.col(f"n_h_{k}")) for k in flags}
    keep = (F.col("idx") >= need - 1) & ((F.col("idx") - (need - 1)) % step == 0)
    return rolled.filter(keep).select("idx", *[r6(m).alias(f"{k}_hit_rate") for k, m in mean.items()])


def tier_summary(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Count, accuracy and coverage of the scored, actionable and placed tiers, per key or overall."""
    a, p = F.col("is_actionable"), F.col("is_placed")
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        n.alias("n_scored"), r6(F.avg("correct")).alias("accuracy_scored"),
        count_true(a).alias("n_actionable"), r6(F.avg(F.when(a, F.col("correct")))).alias("accuracy_actionable"),
        r6(X.share(a)).alias("actionable_coverage"),
        count_true(p).alias("n_placed"), r6(F.avg(F.when(p, F.col("correct")))).alias("accuracy_placed"),
        r6(X.share(p)).alias("placed_coverage"),
        r6(F.avg("p_pick")).alias("mean_p_pick"), r6(F.avg("threshold")).alias("mean_threshold"),
    )


def confidence_hist(df: DataFrame, bins: int = 20) -> DataFrame:
    """Fixed bins of max(p, 1-p) on [0.5, 1]; the last bin is closed; empty bins appear with zero."""
    edges = [0.5 + i * (0.5 / bins) for i in range(bins + 1)]
    conf = X.p_pick("p_final")
    index = sum(((conf >= num(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    hit = F.coalesce(F.col("is_correct").cast("double"), X.hit("p_final", "over_label"))
    known = F.col("over_label").isNotNull()
    got = (
        df.filter(F.col("p_final").isNotNull() & (F.col("outcome").isin("over", "under") | F.col("outcome").isNull()))
        .groupBy(index.alias("bin")).agg(
            F.count(F.lit(1)).alias("count"), F.sum(F.when(known, hit)).cast("bigint").alias("hits"),
            count_true(known).alias("_known"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(got, "bin", "left").select(
        big("bin").alias("bin"), r6(num(0.5) + F.col("bin") * num(0.5 / bins)).alias("range_start"),
        F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
        (F.coalesce("_known", F.lit(0)) - F.coalesce("hits", F.lit(0))).cast("bigint").alias("misses"),
        r6(F.when(F.col("_known") > 0, F.col("hits") / F.col("_known"))).alias("hit_rate"),
    )


def passed_steps(value: Column, grid: list[float], extra: Column | None = None) -> Column:
    """How many grid thresholds ``value`` reaches. The grid ascends, so this is also the last one reached."""
    add = extra if extra is not None else num(0)
    return sum(((value >= num(g) + add).cast("int") for g in grid), F.lit(0))


def threshold_curve(df: DataFrame, grid: list[float], flags: dict[str, Column], step: Column,
                    keys: list[str] = ()) -> DataFrame:
    """Sums of ``flags`` over rows that reach each threshold: one histogram pass, then suffix sums over the grid.

    Nothing is multiplied by the grid size; the window runs over at most len(grid)+1 rows per key.
    """
    hist = df.groupBy(*keys, step.alias("_k")).agg(*[F.sum(v).alias(f) for f, v in flags.items()])
    full = hist.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_k", F.struct(*flags)))).alias("_m")   # <= len(grid)+1 entries
    )
    points = full.select(*keys, "_m", F.posexplode(F.array(*[num(g) for g in grid])).alias("_i", "threshold"))

    def above(f: str) -> Column:
        reached = F.map_values(F.map_filter("_m", lambda k, v: k > F.col("_i")))
        return F.aggregate(reached, F.lit(0.0), lambda s, v: s + v[f].cast("double"))

    return points.select(*keys, "threshold", *[above(f).alias(f) for f in flags])


def frontier(df: DataFrame) -> DataFrame:
    grid = [round(0.50 + 0.01 * i, 2) for i in range(26)]
    placed = F.coalesce(F.col("conformal_set_size"), F.lit(1)) != 2
    good = F.col("correct")
    curve = threshold_curve(
        df, grid, step=passed_steps(F.col("p_pick"), grid),
        flags={"n": F.lit(1), "hits": good, "np": placed.cast("int"), "ph": F.when(placed, good).otherwise(num(0))},
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return curve.select(
        F.round("threshold", 2).alias("threshold"), big("n").alias("n_actionable"), r6(F.col("n") / total).alias("coverage"),
        r6(F.when(F.col("n") > 0, F.col("hits") / F.col("n"))).alias("accuracy_actionable"),
        big("np").alias("n_placed"), r6(F.col("np") / total).alias("placed_coverage"),
        r6(F.when(F.col("np") > 0, F.col("ph") / F.col("np"))).alias("accuracy_placed"),
    )


def by_direction(df: DataFrame) -> DataFrame:
    total = df.agg(F.count(F.lit(1))).scalar()
    way = F.when(X.pick_over("p_final"), "OVER").otherwise("UNDER")
    return df.filter("is_actionable").groupBy(way.alias("direction")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("correct")).alias("accuracy"),
        r6(F.count(F.lit(1)) / total).alias("coverage"))


def deciles(df: DataFrame) -> DataFrame:
    """Ten right-closed bins of p_pick; 0.5 falls in the first."""
    edges = [round(0.5 + 0.05 * i, 2) for i in range(1, 10)]
    index = sum(((F.col("p_pick") > num(e)).cast("int") for e in edges), F.lit(0))
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(big(index).alias("decile")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.count(F.lit(1)) / total).alias("coverage"),
        r6(F.avg("correct")).alias("accuracy"), r6(F.avg("p_pick")).alias("mean_p_pick"))


def unpivot(df: DataFrame, columns: list[str], keep: list[str], name: str = "expert", value: str = "p") -> DataFrame:
    return df.unpivot(keep, columns, name, value).filter(F.col(value).isNotNull())


def tail_per_expert(df: DataFrame, experts: list[str], order: list[str], n: int, keep: list[str]) -> DataFrame:
    """Last ``n`` present rows per expert: one bounded top-n per column, no window over the whole table."""
    parts = [
        df.filter(F.col(e).isNotNull()).select(*keep, *[c for c in order if c not in keep], F.lit(e).alias("expert"), F.col(e).alias("p"))
        .orderBy(*[F.col(o).desc() for o in order]).limit(n)
        for e in experts
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def expert_summary(df: DataFrame, keys: list[str] = ("expert",)) -> DataFrame:
    """Accuracy, log loss, base rate and count of (p, over_label) rows per key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(X.hit("p", "over_label"))).alias("accuracy"),
        r6(F.avg(X.log_loss("over_label", "p"))).alias("logloss"),
        r6(F.avg(F.col("over_label").cast("double"))).alias("base_rate"))


def inversion(df: DataFrame, keys: list[str] = ("expert",), eps: float = 1e-7) -> DataFrame:
    """Accuracy and log loss of p and of 1-p."""
    y = F.col("over_label")
    acc, acc_inv = X.hit("p", "over_label"), ((F.col("p") < 0.5) == (y == 1)).cast("double")
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(acc).alias("accuracy"), F.avg(acc_inv).alias("accuracy_inverted"),
        F.avg(X.log_loss(y, "p", eps)).alias("logloss"), F.avg(X.log_loss(y, num(1) - F.col("p"), eps)).alias("logloss_inverted"))
    return out.withColumns({
        "improves_accuracy": F.col("accuracy_inverted") > F.col("accuracy") + 0.02,
        "improves_logloss": F.col("logloss_inverted") < F.col("logloss") - 0.02,
    })


def inversion_flags(df: DataFrame, p: str, min_n: int, acc_gain: float, loss_gain: float) -> DataFrame:
    """Measures whose forecast is better flipped, with sample and gain gates."""
    m = inversion(df.filter(F.col(p).isNotNull()).withColumn("p", F.col(p)), ["stat_type"], 1e-6)
    flag = (
        (F.col("n") >= min_n) & (F.col("accuracy_inverted") - F.col("accuracy") >= acc_gain)
        & (F.col("logloss") - F.col("logloss_inverted") >= loss_gain)
    )
    return m.select("stat_type", "n", r6("accuracy").alias("accuracy"), r6("accuracy_inverted").alias("accuracy_inverted"),
                    r6("logloss").alias("logloss"), r6("logloss_inverted").alias("logloss_inverted"), flag.alias("flip"))


def confusion(df: DataFrame, keys: list[str] = ("expert",)) -> DataFrame:
    over, one = X.pick_over("p"), F.col("over_label") == 1
    return df.groupBy(*keys).agg(
        count_true(over & one).alias("tp"), count_true(over & ~one).alias("fp"),
        count_true(~over & ~one).alias("tn"), count_true(~over & one).alias("fn"))


def equal_bin(p: Column, bins: int) -> Column:
    """Index of the equal-width bin on [0, 1] by edge comparison; the last bin is closed."""
    return sum(((p >= num(i / bins)).cast("int") for i in range(1, bins)), F.lit(0))


def reliability(df: DataFrame, bins: int, keys: list[str] = (), p: str = "p_final", y: str = "over_label") -> DataFrame:
    return df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, equal_bin(F.col(p), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("mean_actual"),
        F.sum(F.pow(F.col(p) - F.col(y), num(2))).alias("_sq"))


def brier_ece(df: DataFrame, bins: int, keys: list[str] = (), min_rows: int = 10) -> DataFrame:
    """Brier score and expected calibration error from the reliability table (at most ``bins`` rows per key)."""
    table = reliability(df, bins, keys)
    n = F.sum("n")
    return table.groupBy(*keys).agg(
        n.alias("n"), (F.sum("_sq") / n).alias("brier"),
        (F.sum(F.abs(F.col("mean_pred") - F.col("mean_actual")) * F.col("n")) / n).alias("ece"),
    ).filter(F.col("n") >= min_rows)


def overall_and_each(df: DataFrame, key: str, fn, label: str = "__all__") -> DataFrame:
    """Run a grouped report per key and once over everything, from one doubled pass over grouped partials."""
    both = df.withColumn("_scope", F.explode(F.array(F.col(key), F.lit(label))))
    return fn(both, ["_scope"]).withColumnRenamed("_scope", key)


def psi(df: DataFrame, features: list[str], is_baseline: str, bins: int = 10) -> DataFrame:
    """Population stability index per feature on baseline quantile bins, with smoothing.

    All features go through one unpivoted pass; the edge table has one row per feature.
    """
    long = unpivot(df.select(*[F.col(f).cast("double").alias(f) for f in features], F.expr(is_baseline).alias("_base")),
                   features, ["_base"], "feature", "v")
    names = [f"q{i}" for i in range(1, bins)]
    cuts = exact_quantiles(long.filter("_base"), ["feature"], "v", {q: i / bins for i, q in enumerate(names, 1)})
    fresh = [F.lit(True), *[F.col(b) != F.col(a) for a, b in zip(names, names[1:])]]   # repeated edges count once
    k = sum((new.cast("int") for new in fresh), F.lit(1)).cast("double")
    placed = long.join(F.broadcast(cuts.withColumn("_k", k).drop("n")), "feature")
    index = sum(((new & (F.col(q) <= F.col("v"))).cast("int") for q, new in zip(names, fresh)), F.lit(0))
    hist = placed.groupBy("feature", "_k", index.alias("b")).agg(
        count_true(F.col("_base")).alias("nb"), count_true(~F.col("_base")).alias("nc"))
    per = hist.groupBy("feature", "_k").agg(
        F.sum("nb").alias("tb"), F.sum("nc").alias("tc"), F.collect_list(F.struct("nb", "nc")).alias("h"))  # <= bins entries
    eps = num(1e-4)

    def term(nb: Column, nc: Column) -> Column:
        pb = (nb + eps) / (F.col("tb") + eps * F.col("_k"))
        pc = (nc + eps) / (F.col("tc") + eps * F.col("_k"))
        return (pc - pb) * F.ln(pc / pb)

    seen = F.aggregate("h", F.lit(0.0), lambda s, x: s + term(x["nb"], x["nc"]))
    blank = (F.col("_k") - F.size("h")) * term(num(0), num(0))   # bins empty on both sides
    ok = (F.col("tb") >= 10) & (F.col("tc") >= 10) & (F.col("_k") >= 2)
    return per.select("feature", F.when(ok, F.greatest(num(0), seen + blank)).otherwise(num(0)).alias("psi"),
                      F.col("tb").alias("n_baseline"), F.col("tc").alias("n_recent"))


def performance_drift(df: DataFrame, correct: str, is_baseline: str, threshold: float = 0.05, min_rows: int = 50) -> DataFrame:
    base = F.expr(is_baseline)
    out = df.filter(F.col(correct).isNotNull()).agg(
        count_true(~base).alias("n_recent"), count_true(base).alias("n_baseline"),
        F.avg(F.when(~base, F.col(correct))).alias("_r"), F.avg(F.when(base, F.col(correct))).alias("_b"))
    enough = (F.col("n_recent") >= min_rows) & (F.col("n_baseline") >= min_rows)
    delta = F.when(enough, F.col("_b") - F.col("_r")).otherwise(num(0))
    return out.select("n_recent", "n_baseline", r6("_r").alias("accuracy_recent"), r6("_b").alias("accuracy_baseline"),
                      r6(delta).alias("delta"), (delta > threshold).alias("is_drifted"))


def last_window_metrics(df: DataFrame, columns: list[str], order: list[str], windows: list[int]) -> DataFrame:
    """Accuracy, log loss and Brier of each column over its last w rows (when it has w) and over all rows."""
    m = lambda d, keys: d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(X.hit("p", "over_label"))).alias("accuracy"),
        r6(F.avg(X.log_loss("over_label", "p"))).alias("logloss"),
        r6(F.avg(F.pow(F.col("p") - F.col("over_label"), num(2)))).alias("brier"))
    everything = m(unpivot(df, columns, ["over_label"]), ["expert"]).withColumn("window", F.lit("all_time"))
    tail = tail_per_expert(df, columns, order, max(windows), ["over_label"])
    newest = Window.partitionBy("expert").orderBy(*[F.col(o).desc() for o in order])   # <= max(windows) rows
    ranked = tail.withColumn("_rn", F.row_number().over(newest))
    cut = ranked.withColumn("w", F.explode(F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: w >= F.col("_rn"))))
    recent = m(cut, ["expert", "w"]).filter(F.col("n") == F.col("w")).withColumn(
        "window", F.concat(F.lit("last_"), F.col("w").cast("string"))).drop("w")
    return everything.unionByName(recent)


#: Positions of a first block, and blocks that are merged into one at each of the levels above: 2^56 positions end in one row.
RUN_BLOCK, RUN_MERGED, RUN_LEVELS = 1 << 16, 1 << 10, 4


def longest_run(df: DataFrame, flag: str, order: list[str]) -> DataFrame:
    """Longest run of rows whose flag is 0. A run lies between two rows with flag 1, so only their positions matter.

    A block of positions is summed up by its first and last one and the longest gap between. Two neighbours' summaries make
    one, so blocks are merged level by level, a bounded number at a time, and no window holds more."""
    seq = sorted_positions(df.select(*order, F.col(flag).cast("int").alias("_f")), order)
    total = seq.agg(F.count(F.lit(1))).scalar()
    runs = seq.filter("_f = 1").select(F.col("idx").alias("_b"), F.col("idx").alias("lo"), F.col("idx").alias("hi"), F.lit(0).cast("bigint").alias("gap"))
    for merged in [RUN_BLOCK] + [RUN_MERGED] * RUN_LEVELS:
        runs = runs.withColumn("_g", F.floor(F.col("_b") / merged))
        before = F.lag("hi").over(Window.partitionBy("_g").orderBy("_b"))
        runs = runs.withColumn("gap", F.greatest("gap", F.col("lo") - before - 1)).groupBy(F.col("_g").alias("_b")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("gap").alias("gap"))
    ends = runs.agg(F.max("gap").alias("gap"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return ends.select(big(F.coalesce(F.greatest("gap", "lo", total - 1 - F.col("hi")), total)).alias("max_drawdown"))


def sharpe(df: DataFrame, day: Column, pnl: Column) -> DataFrame:
    daily = df.groupBy(day.alias("d")).agg(F.sum(pnl).alias("pnl"))
    out = daily.agg(F.count(F.lit(1)).alias("days"), F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s"))
    return out.select("days", r6(F.when(F.col("s") > 0, F.col("m") / F.col("s") * num(252 ** 0.5)).otherwise(num(0))).alias("sharpe"))


def expert_eval(df: DataFrame, experts: list[str]) -> DataFrame:
    long = unpivot(df, experts, ["over_label"])
    base = long.groupBy("expert").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(X.hit("p", "over_label"))).alias("accuracy"),
        r6(F.avg(X.log_loss("over_label", "p", 1e-6))).alias("logloss"))
    return base.join(rank_auc(long, ["expert"], "p", "over_label"), "expert").withColumn("auc", r6("auc"))
