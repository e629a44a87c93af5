"""Combining experts: pools, online weights, rolling strategies, learned mixes.

Row arithmetic is column work. Order-dependent learners read positions from ``ordering`` and run in bounded,
overlapping blocks, so a context that holds a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, num, r6

from .ordering import group_positions, overlapping_blocks, rolling_sums, sorted_positions

EPS = 1e-6


# --- pools -----------------------------------------------------------------------------------------------
def context(df: DataFrame) -> DataFrame:
    """Adds ``ctx``: measure, regime and history bucket."""
    live = F.when(F.coalesce(F.col("is_live"), F.lit(False)), "live").otherwise("pregame") if "is_live" in df.columns else F.lit("pregame")
    return df.withColumn("ctx", F.concat_ws("|", "stat_type", live, X.neff_bucket("n_eff")))


def accuracy_weights(df: DataFrame, keys: list[str], experts: list[str], min_rows: int = 0) -> DataFrame:
    """Mean hit rate per expert, one row per key: all experts in one aggregate."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(X.hit(e, "over_label")).alias(f"w_{e}") for e in experts]).filter(
        F.col("_n") >= min_rows).drop("_n")


def context_pool(df: DataFrame, experts: list[str], context_weights: DataFrame, global_weights: DataFrame) -> DataFrame:
    """Weighted logit pool with the context's weights, else the global ones (a single row)."""
    names = [f"w_{e}" for e in experts]
    g = global_weights.select(F.struct(*names)).scalar()
    j = df.join(context_weights.select("ctx", F.struct(*names).alias("_w")), "ctx", "left").withColumn("_g", g)
    w = F.coalesce("_w", "_g")
    return j.withColumn("p_pool", X.clip(X.weighted_logit(experts, [F.greatest(F.coalesce(w[n], num(0)), num(0)) for n in names], EPS), EPS, 1 - EPS)).drop("_w", "_g")


# --- Thompson --------------------------------------------------------------------------------------------
def thompson(df: DataFrame, experts: list[str], caps: dict[str, float]) -> DataFrame:
    """Beta counts and posterior-mean weights per (context, expert). Counts do not depend on row order."""
    regime = F.concat_ws("|", "stat_type", F.lit("pregame"), F.when(F.col("n_eff") >= 15, "high").otherwise("low"))
    won = lambda e: X.hit(e, "over_label")
    wide = df.groupBy(regime.alias("ctx")).agg(*[F.struct(F.coalesce(F.sum(won(e)), num(0)).alias("a"), F.coalesce(F.sum(num(1) - won(e)), num(0)).alias("b")).alias(e) for e in experts])
    long = wide.unpivot(["ctx"], experts, "expert", "c").select("ctx", "expert", (F.col("c.a") + 1).alias("alpha"), (F.col("c.b") + 1).alias("beta"))
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    capped = F.least(mean, F.coalesce(X.lookup(caps, F.col("expert")), num(1))) if caps else mean
    total = F.sum("_m").over(Window.partitionBy("ctx"))   # one row per expert
    return long.withColumn("_m", capped).withColumn("weight", F.col("_m") / total).drop("_m")


# --- Hedge -----------------------------------------------------------------------------------------------
def initial_weights(experts: list[str]) -> list[float]:
    raw = [max(K.QUALITY_PRIOR.get(e, 0.55) - 0.5, 0.01) for e in experts]
    return [r / sum(raw) for r in raw]


def clamp_weights(w: list[float], caps: list[float]) -> list[float]:
    w = [min(max(x, K.WEIGHT_FLOOR), cap) for x, cap in zip(w, caps)]
    total = sum(w)
    return [x / total for x in w]


def hedge_step(w: list[float], probs: list[float | None], y: int, eta: float, caps: list[float]) -> tuple[float, list[float]]:
    """Prediction with the current weights, then the weights after seeing the label."""
    w = clamp_weights(w, caps)
    seen = [(i, min(max(p, EPS), 1 - EPS)) for i, p in enumerate(probs) if p is not None and math.isfinite(p)]
    mass = sum(w[i] for i, _ in seen)
    pred = 0.5
    if mass > 0:
        z = sum(w[i] / (mass + 1e-12) * math.log(p / (1 - p)) for i, p in seen)
        pred = 1 / (1 + math.exp(-z))
    n = len(w)
    w = [(1 - K.HEDGE_SHRINK) * x + K.HEDGE_SHRINK / n for x in w]
    for i, p in seen:
        w[i] *= math.exp(eta * (math.log(p) if y == 1 else math.log(1 - p)))
    total = sum(w)
    w = [x / total for x in w]
    return pred, clamp_weights(w, caps)


def hedge(df: DataFrame, experts: list[str], order: list[str], caps: dict[str, float] | None = None,
          block: int = 1 << 16, warm_up: int = 1 << 12) -> DataFrame:
    """Replay of the sequential learner: one prediction per row from the weights its context had by then.

    The step size depends on the row's global position. Each context is cut into blocks that first replay the
    ``warm_up`` rows before them: every step mixes five percent of the uniform weights in and clamps, so the
    starting weights lose their influence geometrically and are gone below double precision after a few
    hundred rows. A context's first block starts from the true initial weights.
    """
    limits = [min(K.WEIGHT_CAP, (caps or {}).get(e, K.WEIGHT_CAP)) for e in experts]
    start = initial_weights(experts)
    rows = context(df).select(*order, "ctx", "over_label", *experts)
    placed = group_positions(sorted_positions(rows, order, "step"), ["ctx"], order, "pos").drop("n_group")
    cut = overlapping_blocks(placed, "pos", warm_up, block)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        w, out = list(start), []
        columns = [[None if pd.isna(v) else float(v) for v in pdf[e]] for e in experts]
        for i, (step, y) in enumerate(zip(pdf["step"], pdf["over_label"])):
            eta = K.ETA / (1 + K.ETA_DECAY * (step + 1))
            pred, w = hedge_step(w, [c[i] for c in columns], int(y), eta, limits)
            out.append((pred, *w))
        res = pd.DataFrame(out, columns=["p_hedge", *[f"w_{e}" for e in experts]], index=pdf.index)
        return pd.concat([pdf[["id", "ctx", "pos", "_own"]], res], axis=1)[pdf["_own"]].drop(columns="_own")

    schema = "id long, ctx string, pos long, p_hedge double, " + ", ".join(f"w_{e} double" for e in experts)
    return cut.groupBy("ctx", "_blk").applyInPandas(replay, schema)


# --- rolling strategies ------------------------------------------------------------------------------------
def rolled_hits(df: DataFrame, experts: list[str], order: list[str], window: int, keys: list[str]) -> DataFrame:
    """Previous ``window`` rows (overall or per key): rows seen, and count and hit rate per expert."""
    rows = df.select(*order, *[k for k in keys], *experts, *[X.hit(X.clip_expert(e), "over_label").alias(f"h_{e}") for e in experts])
    seq = group_positions(rows, keys, order, "idx") if keys else sorted_positions(rows, order)
    out = rolling_sums(seq, "idx", window, [f"h_{e}" for e in experts], keys, include_current=False).withColumnRenamed("seen", "_seen")
    rate = {f"a_{e}": F.when(F.col(f"n_h_{e}") > 0, F.col(f"s_h_{e}") / F.col(f"n_h_{e}")) for e in experts}
    return out.withColumns(rate).withColumnsRenamed({f"n_h_{e}": f"n_{e}" for e in experts})


def logit_average(experts: list[str]) -> Column:
    return X.logit_mean([X.clip_expert(e) for e in experts])


def recency_weighted(df: DataFrame, experts: list[str], order: list[str], window: int = 100, temperature: float = 5.0, rolled: DataFrame | None = None) -> DataFrame:
    """Softmax of the rolling hit rates as weights; plain average during the first ten rows. ``rolled``: these rates, if at hand."""
    r = rolled_hits(df, experts, order, window, []) if rolled is None else rolled
    usable = {e: F.col(e).isNotNull() & F.col(f"a_{e}").isNotNull() for e in experts}
    top = F.greatest(*[F.when(usable[e], F.col(f"a_{e}")) for e in experts])
    w = [F.when(usable[e], F.exp(num(temperature) * (F.col(f"a_{e}") - top))).otherwise(num(0)) for e in experts]
    mixed = X.weighted_logit([X.clip_expert(e) for e in experts], w, 1e-7)
    any_usable = F.coalesce(F.greatest(*[F.when(u, 1) for u in usable.values()]), F.lit(0)) == 1
    return r.withColumn("p_recency", F.when((F.col("_seen") >= 10) & any_usable, mixed).otherwise(logit_average(experts)))


def _ranking(experts: list[str], need: int) -> Column:
    """Experts with enough history, best hit rate first, ties in list order: an array of their indexes."""
    entries = F.array(*[F.when(F.col(f"n_{e}") >= need, F.struct((-F.col(f"a_{e}")).alias("k"), F.lit(i).alias("i"))) for i, e in enumerate(experts)])
    return F.transform(F.array_sort(F.array_compact(entries)), lambda s: s["i"])


def per_stat_best(df: DataFrame, experts: list[str], order: list[str], window: int = 100, need: int = 20) -> DataFrame:
    r = rolled_hits(df, experts, order, window, ["stat_type"]).withColumn("_r", _ranking(experts, need // 2))
    best = F.when((F.col("_seen") >= need) & (F.size("_r") > 0), F.element_at("_r", 1))
    value = F.array(*[X.clip_expert(e) for e in experts])
    return r.withColumn("p_per_stat", F.coalesce(F.element_at(value, best + 1), logit_average(experts)))


def top_k(df: DataFrame, experts: list[str], order: list[str], k: int = 3, window: int = 100, need: int = 20, rolled: DataFrame | None = None) -> DataFrame:
    r = rolled_hits(df, experts, order, window, []) if rolled is None else rolled
    r = r.withColumn("_r", F.slice(_ranking(experts, need // 2), 1, k))
    chosen = [F.when(F.array_contains("_r", F.lit(i)) & (F.col("_seen") >= need), X.clip_expert(e)) for i, e in enumerate(experts)]
    return r.withColumn("p_top_k", F.when(X.present(chosen) > 0, X.logit_mean(chosen)).otherwise(logit_average(experts)))


# --- mixes and search ----------------------------------------------------------------------------------------
def hybrid(parts: dict[str, tuple[str, float]]) -> Column:
    """Logit mix of sub-ensembles; the weight of a missing one goes to the others."""
    cols, weights = [c for c, _ in parts.values()], [num(w) for _, w in parts.values()]
    return X.weighted_logit(cols, weights, EPS)


def mix_grid() -> list[tuple[float, float, float]]:
    steps = [i / 10 for i in range(11)]
    return [(a, b, max(1.0 - a - b, 0.0)) for a in steps for b in steps if 1.0 - a - b >= -0.01]


def mixing_losses(df: DataFrame, columns: tuple[str, str, str], y: str = "over_label") -> DataFrame:
    """Log loss of every convex mix in probability space; rows fan out to the grid inside the task and combine
    before the shuffle, which carries one row per grid point and task."""
    grid = F.array(*[F.struct(num(a).alias("a"), num(b).alias("b"), num(g).alias("g")) for a, b, g in mix_grid()])
    p = [X.clip(c, EPS, 1 - EPS) for c in columns]
    m = df.select(F.col(y).alias("_y"), *[v.alias(f"_p{i}") for i, v in enumerate(p)]).dropna().withColumn("m", F.explode(grid))
    mixed = F.col("m.a") * F.col("_p0") + F.col("m.b") * F.col("_p1") + F.col("m.g") * F.col("_p2")
    total = F.col("m.a") + F.col("m.b") + F.col("m.g")
    return m.groupBy("m.a", "m.b", "m.g").agg(F.avg(X.log_loss("_y", mixed / total, EPS)).alias("logloss"))


def weight_candidates(experts: list[str], n_random: int) -> list[list[float]]:
    """Uniform, one-hot, and points spread over the simplex by a fixed congruential rule."""
    k = len(experts)
    out = [[1.0 / k] * k] + [[1.0 if i == j else 0.0 for j in range(k)] for i in range(k)]
    for c in range(n_random):
        raw = [-math.log((((c + 1) * 7919 + (j + 1) * 104729 + (c + 1) * (c + 1) * (j + 1) * 31) % 1_000_003 + 0.5) / 1_000_003) for j in range(k)]
        out.append([round(r / sum(raw), 9) for r in raw])
    return out


def candidate_losses(df: DataFrame, experts: list[str], candidates: list[list[float]]) -> DataFrame:
    """Summed log loss per (context, candidate): the one pass both the global and the local search read.

    Rows are not multiplied by the candidates: a task takes the product of its logits with all candidates, a slice of
    rows at a time, and sends one sum per context and candidate."""
    rows = context(df).select("ctx", F.col("over_label").cast("double").alias("y"), *[X.logit(e, EPS).alias(f"z_{e}") for e in experts])
    table, slice_rows = np.array(candidates).T, 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: Counter = Counter()
        for b in batches:
            ctx, y = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(zero_copy_only=False)
            z = np.stack([b.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(experts))], axis=1)
            there = ~np.isnan(z)
            z = np.where(there, z, 0.0)
            for c in set(ctx):
                for at in np.array_split(np.flatnonzero(ctx == c), max(1, -(-int((ctx == c).sum()) // slice_rows))):
                    mass = there[at].astype(float) @ table
                    with np.errstate(divide="ignore", invalid="ignore"):
                        p = np.where(mass > EPS, 1 / (1 + np.exp(-(z[at] @ table) / mass)), 0.5)
                    p = np.clip(p, EPS, 1 - EPS)
                    loss = -(y[at, None] * np.log(p) + (1 - y[at, None]) * np.log(1 - p)).sum(axis=0)
                    sums[c] = sums.get(c, 0.0) + loss
                    seen[c] += len(at)
        for c, loss in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(loss)), pa.array(np.arange(len(loss)), pa.int32()), pa.array(loss), pa.array([seen[c]] * len(loss), pa.int64())], ["ctx", "cand", "loss", "n"])

    return rows.mapInArrow(run, "ctx string, cand int, loss double, n bigint").groupBy("ctx", "cand").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))


def search_weights(losses: DataFrame, experts: list[str], candidates: list[list[float]], min_rows: int, strength: float, reg: float, local: int) -> DataFrame:
    """Best global candidate, and per context the best of the first ``local`` ones pulled toward it by n / (n + strength)."""
    table = losses.sparkSession.createDataFrame(list(enumerate(candidates)), "cand int, w array<double>")
    overall = losses.groupBy("cand").agg((F.sum("loss") / F.sum("n")).alias("obj")).agg(F.min(F.struct("obj", "cand")).alias("m")).select("m.cand").scalar()
    chosen = table.filter(F.col("cand") == overall).select("w").scalar()
    l = losses.filter(F.col("cand") < local).join(F.broadcast(table), "cand").withColumn("gw", chosen)   # a fixed number of candidates
    penalty = sum(((F.col("w")[i] - F.col("gw")[i]) * (F.col("w")[i] - F.col("gw")[i]) for i in range(len(experts))), num(0))
    best = l.withColumn("obj", F.col("loss") / F.col("n") + num(reg) * penalty).groupBy("ctx").agg(
        F.max("n").alias("n"), F.min(F.struct("obj", "cand", "w", "gw")).alias("m"))
    pull = F.when(F.col("n") >= min_rows, F.col("n") / (F.col("n") + num(strength))).otherwise(num(0))
    return best.select("ctx", "n", *[(pull * F.col("m.w")[i] + (num(1) - pull) * F.col("m.gw")[i]).alias(f"w_{e}") for i, e in enumerate(experts)])


def prune(weights: DataFrame, metrics: DataFrame, uniform_loss: Column, min_keep: int, threshold: float, min_rows: int) -> DataFrame:
    """Drop the lightest experts that are also weak or thin, never below ``min_keep`` (one row per expert)."""
    j = weights.join(metrics, "expert").withColumn("_u", uniform_loss)
    weak = (F.col("weight") < threshold) & ((F.col("n") < min_rows) | F.col("logloss").isNull() | (F.col("logloss") >= F.col("_u")))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.partitionBy("_weak").orderBy("weight", F.desc("logloss"), "expert"))
    room = F.count(F.lit(1)).over(everything) - F.lit(min_keep)
    return j.withColumn("_weak", weak).withColumn("dropped", F.col("_weak") & (rank <= room)).drop("_weak", "_u")


def apply_inversions(df: DataFrame, expert_flags: DataFrame, stat_flags: DataFrame, experts: list[str], by_stat: str = "p_forecast_cal") -> DataFrame:
    """Flip experts that are flagged overall; the forecast is flipped per measure instead."""
    wide = expert_flags.groupBy().agg(*[F.max(F.when(F.col("expert") == e, F.col("flip"))).alias(e) for e in experts])
    flags = wide.select(F.struct(*experts)).scalar()
    j = df.join(stat_flags.select("stat_type", F.col("flip").alias("_sf")), "stat_type", "left").withColumn("_ef", flags)
    flip = lambda e: F.coalesce(F.col("_sf") if e == by_stat else F.col("_ef")[e], F.lit(False))
    return j.withColumns({e: F.when(flip(e), num(1) - F.col(e)).otherwise(F.col(e)) for e in experts}).drop("_sf", "_ef")


# --- learned combiners (MLlib) ---------------------------------------------------------------------------------
def gating_features(experts: list[str], n_eff: str = "n_eff") -> dict[str, Column]:
    """Agreement, spread, mean confidence and log history; a missing expert counts as 0.5."""
    p = [F.coalesce(F.col(e), num(0.5)) for e in experts]
    k = num(len(experts))
    return {
        "agreement": sum(((v >= 0.5).cast("double") for v in p), num(0)) / k, "spread": F.greatest(*p) - F.least(*p),
        "mean_confidence": sum((F.abs(v - num(0.5)) for v in p), num(0)) / k, "log_n_eff": F.log1p(F.coalesce(F.col(n_eff), num(0))),
    }


def fit_logistic(df: DataFrame, features: list[str], label: str, c: float, scale: bool = False):
    """Ridge logistic regression with the penalty written the scikit way (C). Returns (weights, intercept) on the raw
    feature scale; at most a handful of numbers reach the driver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    spec = [F.count(F.lit(1)).alias("n")] + ([F.avg(f).alias(f"m_{f}") for f in features] + [F.stddev_pop(f).alias(f"s_{f}") for f in features] if scale else [])
    stat = df.agg(*spec).first()
    mean = [stat[f"m_{f}"] if scale else 0.0 for f in features]
    std = [(stat[f"s_{f}"] or 1.0) if scale else 1.0 for f in features]
    rows = df.select(*[((F.col(f) - num(m)) / num(s)).alias(f) for f, m, s in zip(features, mean, std)], F.col(label).cast("double").alias("label"))
    model = LogisticRegression(maxIter=100, regParam=1.0 / (c * stat["n"]), elasticNetParam=0.0, standardization=False).fit(
        VectorAssembler(inputCols=features, outputCol="features").transform(rows))
    w = [float(b) / s for b, s in zip(model.coefficients, std)]
    return w, float(model.intercept) - sum(b * m for b, m in zip(w, mean))


def logistic(features: list[str], w: list[float], b: float) -> Column:
    return X.sigmoid(sum((F.col(f) * num(x) for f, x in zip(features, w)), num(b)))


def gating_fit(df: DataFrame, experts: list[str]) -> tuple[DataFrame, list[str]]:
    """Per expert P(correct | context), softmaxed into weights on every row."""
    feats = gating_features(experts)
    rows = df.withColumns(feats)
    names, scores = list(feats), {}
    for e in experts:   # six small models; a fit is one distributed job per iteration
        train = rows.withColumn("_t", (X.pick_over(F.coalesce(F.col(e), num(0.5))) == (F.col("over_label") == 1)).cast("double"))
        w, b = fit_logistic(train, names, "_t", 1.0, scale=True)
        scores[e] = logistic(names, w, b)
    top = F.greatest(*scores.values())
    ex = {e: F.exp(s - top) for e, s in scores.items()}
    total = sum(ex.values(), num(EPS))
    return rows.withColumns({f"g_{e}": v / total for e, v in ex.items()}), names
