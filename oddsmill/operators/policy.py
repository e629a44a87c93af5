"""Slate scoring: from expert probabilities to a ranked, gated list of picks per slate.

Row rules are column expressions. Slate rules use map-side combined aggregates joined back, and per-slate
rankings first cut every (slate, measure) to a bounded number of rows, which Spark does inside each task, so a
slate that holds a third of all lines never gathers in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import num

from .reports import passed_steps, threshold_curve

GLOBAL = "__global__"


# --- thresholds ---------------------------------------------------------------------------------------------
def threshold_grid() -> list[float]:
    return [round(0.55 + 0.01 * i, 2) for i in range(18)]


def fit_thresholds(df: DataFrame, min_rows: int = 200, coverage_floor: float = 0.40, target: float = 0.55,
                   penalty: float = K.CONFORMAL_PENALTY) -> DataFrame:
    """Best feasible threshold overall and per measure; thin measures fall back to the overall one."""
    grid = threshold_grid()
    rows = df.withColumn("scope", F.explode(F.array(F.col("stat_type"), F.lit(GLOBAL)))).withColumns({
        "_p": X.p_pick("p_final"), "_ok": X.hit("p_final", "over_label"), "_pen": F.when(F.col("conformal_set_size") == 2, num(penalty)).otherwise(num(0))})
    curve = threshold_curve(rows, grid, {"n": F.lit(1), "hits": F.col("_ok")}, passed_steps(F.col("_p"), grid, F.col("_pen")), ["scope"])
    sizes = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("total"))
    c = curve.join(sizes, "scope").withColumns({
        "coverage": F.round(F.col("n") / F.col("total"), 4), "accuracy": F.when(F.col("n") > 0, F.round(F.col("hits") / F.col("n"), 4))})
    feasible = (F.col("coverage") >= coverage_floor) & F.col("accuracy").isNotNull()
    rank = F.struct((feasible & (F.col("accuracy") >= target)).cast("int").alias("good"), F.col("accuracy"), F.col("coverage"), (-F.col("threshold")).alias("low"))
    best = c.groupBy("scope").agg(F.max("total").alias("n"), F.max(F.when(feasible, rank)).alias("_b"))
    own = F.coalesce(-F.col("_b.low"), num(grid[0]))
    shared = best.filter(F.col("scope") == GLOBAL).select(own).scalar()
    thin = (F.col("scope") != GLOBAL) & (F.col("n") < min_rows)
    return best.select("scope", "n", F.round(F.when(thin, shared).otherwise(own), 2).alias("threshold"), F.when(thin, "fallback_global").otherwise("trained").alias("status"))


def ambiguity_penalty(rate: Column, penalty: float = K.CONFORMAL_PENALTY) -> Column:
    """Full penalty, eased when most of the slate is ambiguous. Rate steps and factors."""
    p = num(penalty)
    return F.when(rate >= 0.95, p * 0.25).when(rate >= 0.90, p * 0.5).when(rate >= 0.85, p * 0.75).otherwise(p)


# --- row scoring --------------------------------------------------------------------------------------------
def score_rows(df: DataFrame, experts: list[str]) -> DataFrame:
    """Needs slate, id, stat_type, line_score, experts, n_eff, mu_hat, sigma_hat, status, context_prior, set_size."""
    stat = F.col("stat_type")
    d = df.filter(~stat.isin(*K.EXCLUDED_STATS)).withColumns({e: X.clip_expert(e) for e in experts})
    d = d.withColumn("is_prior_only", stat.isin(*K.PRIOR_ONLY_STATS))
    prior = F.coalesce("context_prior", num(0.5))
    d = d.withColumn("p_raw", F.when(F.col("is_prior_only"), prior).otherwise(X.logit_mean(experts)))
    d = d.withColumn("p_final", F.when(F.col("is_prior_only"), prior).otherwise(X.shrink("p_raw", "n_eff", "context_prior")))
    over = reduce(lambda a, b: a + b, [F.coalesce((F.col(e) >= 0.5).cast("int"), F.lit(0)) for e in experts])
    n = X.present(experts)
    gap = F.abs(F.col("mu_hat") - F.col("line_score"))
    d = d.withColumns({
        "pick": F.when(F.col("p_final") >= 0.5, "OVER").otherwise("UNDER"), "p_pick": X.p_pick("p_final"),
        "confidence": X.risk_adjusted("p_final", "n_eff", "status"),
        "has_diversity": (over >= 1) & (n - over >= 1), "has_min_neff": F.coalesce(F.col("n_eff") >= K.MIN_NEFF, F.lit(False)),
        "forecast_edge_ok": F.when(F.col("mu_hat").isNotNull() & (F.col("line_score") > 0), gap <= K.MAX_FORECAST_EDGE).otherwise(True),
    })
    d = X.with_edge(d, "p_final", experts, "set_size", "n_eff", "mu_hat", "line_score", "sigma_hat")
    return with_threshold(d, num(K.CONFORMAL_PENALTY))


def with_threshold(d: DataFrame, penalty: Column) -> DataFrame:
    d = d.withColumn("threshold", X.threshold_for(num(K.PICK_THRESHOLD), "set_size", penalty))
    d = d.withColumn("margin", F.col("p_pick") - F.col("threshold"))
    gates = {
        "prior_only_stat": F.col("is_prior_only"), "no_expert_diversity": ~F.col("has_diversity"), "low_n_eff": ~F.col("has_min_neff"),
        "forecast_edge_too_large": ~F.col("forecast_edge_ok"), "low_pick_confidence": F.col("margin") < 0, "edge_below_min": F.col("edge") < K.MIN_EDGE,
    }
    return d.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, name) for name, bad in gates.items()]))).withColumn(
        "is_publishable", F.size("reasons") == 0)


def adaptive_penalty(d: DataFrame) -> DataFrame:
    """Second pass with the slate's share of ambiguous sets."""
    rate = d.groupBy("slate").agg(X.share(F.coalesce(F.col("set_size") == 2, F.lit(False))).alias("ambiguous_rate"))
    return with_threshold(d.join(rate, "slate"), ambiguity_penalty(F.col("ambiguous_rate")))


def spread_abstain(d: DataFrame) -> DataFrame:
    """A slate whose probabilities all lie within a narrow band publishes nothing."""
    span = d.groupBy("slate").agg((F.max("p_final") - F.min("p_final")).alias("spread"))
    j = d.join(span, "slate")
    flat = F.col("spread") < K.MIN_SPREAD
    return j.withColumns({"is_publishable": F.col("is_publishable") & ~flat,
                          "reasons": F.when(flat, F.array_append("reasons", F.lit("low_model_discrimination"))).otherwise(F.col("reasons"))})


# --- diverse top --------------------------------------------------------------------------------------------
def _plan(counts: Column, top: Column, share: float) -> Column:
    """Largest list length that the per-measure cap can fill, with its cap."""
    cap = lambda n: F.greatest(F.lit(1), F.floor(n * num(share)).cast("int"))
    room = lambda n: F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, c: s + F.least(c, cap(n).cast("bigint")))
    fits = F.filter(F.sequence(F.lit(1), top), lambda n: room(n) >= n)
    best = F.array_max(fits)
    return F.struct(best.alias("total"), cap(best).alias("cap"))


def slate_plan(items: DataFrame, top: int) -> DataFrame:
    """Per slate: how many picks and how many per measure. At most one count per measure is gathered."""
    per_stat = items.groupBy("slate", "stat_type").agg(F.count(F.lit(1)).alias("_c"))
    s = per_stat.groupBy("slate").agg(F.collect_list("_c").alias("_counts"), F.sum("_c").alias("_n"))
    s = s.withColumn("_top", F.least(F.lit(top).cast("bigint"), F.col("_n")).cast("int"))
    s = s.withColumns({"_strict": _plan(F.col("_counts"), F.col("_top"), K.TOP_SHARE), "_loose": _plan(F.col("_counts"), F.col("_top"), K.TOP_SHARE_RELAXED)})
    need = F.greatest(F.lit(1), F.ceil(F.col("_top") * num(K.MIN_RETURN_RATIO)))
    use = F.when((F.col("_strict.total") >= need) | (F.col("_loose.total") < F.col("_strict.total")), F.col("_strict")).otherwise(F.col("_loose"))
    one = F.size("_counts") <= 1
    return s.select("slate", F.when(one, F.col("_top")).otherwise(use["total"]).alias("_total"), F.when(one, F.col("_top")).otherwise(use["cap"]).alias("_cap"))


def diverse_top(items: DataFrame, top: int, order: str = "edge") -> DataFrame:
    """Best ``top`` rows per slate with at most the planned number per measure. Ties go to the smaller id."""
    by_stat = Window.partitionBy("slate", "stat_type").orderBy(F.desc(order), "id")
    narrow = items.withColumn("_rs", F.row_number().over(by_stat)).filter(F.col("_rs") <= top)   # cut inside each task first
    kept = narrow.join(slate_plan(items, top), "slate").filter(F.col("_rs") <= F.col("_cap"))
    overall = Window.partitionBy("slate").orderBy(F.desc(order), "id")                              # <= top rows per measure
    return kept.withColumn("rank", F.row_number().over(overall)).filter(F.col("rank") <= F.col("_total")).drop("_rs", "_cap", "_total")


def imbalance(d: DataFrame, top_rows: DataFrame) -> DataFrame:
    """Where more than three quarters of a slate's picks lean one way, those near the prior lose edge.

    Returns every scored row with the edge and publishable flag after demotion.
    """
    sides = top_rows.groupBy("slate").agg(X.share(F.col("pick") == "OVER").alias("_over"))
    sides = sides.select("slate", F.greatest("_over", num(1) - F.col("_over")).alias("dominant_pct"), F.when(F.col("_over") > 0.5, "OVER").otherwise("UNDER").alias("dominant"))
    marks = top_rows.select("slate", "id", F.lit(True).alias("_in_top"))
    j = d.join(marks, ["slate", "id"], "left").join(sides, "slate", "left")
    hit = F.coalesce(F.col("_in_top") & (F.col("dominant_pct") > K.IMBALANCE_THRESHOLD) & (F.col("pick") == F.col("dominant")), F.lit(False))
    scale = X.clip((F.col("dominant_pct") - num(K.IMBALANCE_THRESHOLD)) / num(1 - K.IMBALANCE_THRESHOLD), 0.0, 1.0)
    near = num(1) - F.least(num(1), F.abs(F.col("p_final") - F.coalesce("context_prior", num(0.5))) / num(0.20))
    lost = F.round(num(K.MAX_IMBALANCE_PENALTY) * scale * near, 1)
    demoted = F.round(F.greatest(num(0), F.col("edge") - lost), 1)
    j = j.withColumns({"base_edge": F.col("edge"), "edge": F.when(hit, demoted).otherwise(F.col("edge"))})
    below = hit & (F.col("edge") < K.MIN_EDGE)
    return j.withColumn("is_publishable", F.col("is_publishable") & ~below).drop("_in_top", "dominant_pct", "dominant")


def soft_level(edge: str = "edge") -> Column:
    """1 strict, 2 relaxed, 3 any measure that is not prior-only, 4 anything."""
    n_ok = F.col("n_eff").isNull() | (F.col("n_eff") >= 5)
    sound = ~F.col("is_prior_only") & F.col("forecast_edge_ok") & n_ok
    strict = sound & (F.col("p_pick") >= 0.58) & (F.col(edge) >= max(2.5, K.MIN_EDGE * 0.5)) & F.coalesce(F.col("set_size") != 2, F.lit(True))
    relaxed = sound & (F.col("p_pick") >= 0.55) & (F.col(edge) >= 1.0)
    return F.when(strict, 1).when(relaxed, 2).when(~F.col("is_prior_only"), 3).otherwise(4)


def soft_fallback(d: DataFrame, top: int, order: str = "edge") -> DataFrame:
    """Best rows of the best non-empty level of each slate, then the diversity cap."""
    lv = d.withColumn("level", soft_level())
    best = lv.groupBy("slate").agg(F.min("level").alias("_m"))
    w = Window.partitionBy("slate").orderBy(F.desc(order), "id")
    pool = lv.join(best, "slate").filter(F.col("level") == F.col("_m")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r", "_m")
    return diverse_top(pool, top, order)


def score_slate(df: DataFrame, experts: list[str], top: int, keep) -> DataFrame:
    """All passes in order. ``keep`` stores a frame that several later steps read: the row scores (two slate
    aggregates and the rows themselves), the gated rows, the first selection and the rows after demotion."""
    scored = keep(spread_abstain(adaptive_penalty(keep(score_rows(df, experts)))))
    first = diverse_top(scored.filter("is_publishable"), top)
    after = imbalance(scored, keep(first.select("slate", "id", "pick")))
    after = keep(after)
    final = keep(diverse_top(after.filter("is_publishable"), top).withColumn("fallback_used", F.lit(False)))   # <= top rows per slate
    empty = after.join(final.select("slate").distinct(), "slate", "left_anti")
    soft = soft_fallback(empty, top, "base_edge").drop("level").withColumn("fallback_used", F.lit(True))
    return final.unionByName(soft)
