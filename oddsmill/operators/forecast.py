"""Forecast expert: recency-weighted rate and minutes, regressed to the league, turned into a mean and spread.

Decay weights depend on the cut-off, not on the line, so everything is computed once per distinct
(player, measure, cut-off day) and attached by an equi join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import num
from oddsmill.session import merged

from . import asof as A
from .history import KEYS, attach, day_features, league_prior, line_wins

# Fixed values of the forecast.
TAU_SHORT, TAU_LONG, MINUTES_PRIOR, K_MINUTES = 7.0, 21.0, 28.0, 8.0
ALPHA_RATE, BETA_MINUTES, BETA_B2B, BETA_REST = 0.5, 0.5, -1.5, 0.5
MIN_STD_RATE, MIN_STD_MINUTES, MIN_GAMES = 0.01, 1.0, 5


ERA = 1024   # days per rebasing block: exp(ERA / TAU_SHORT) is far from overflow, exp(-ERA / tau) squared far below double precision


def decay_stats(log: DataFrame, probes: DataFrame, cutoff: str = "slate") -> DataFrame:
    """Short and long weighted means, long weighted variances and effective n per (player, measure, cut-off day).

    A weight is exp(-(cutoff - day) / tau) * min(minutes / 24, 1). The cut-off factor cancels in every ratio, so
    running sums of exp(day / tau) terms are enough: constant work per cut-off instead of a pass over the history.
    Days are counted from the start of their era; the previous era enters scaled by exp(-ERA / tau), and
    anything older is below double precision next to a game of the current one.
    """
    day = F.datediff(F.col("game_date"), F.lit("1970-01-01").cast("date"))
    use = F.col("minutes") > 0
    rows = log.withColumns({"_era": F.floor(day / ERA).cast("bigint"), "_off": (day % ERA).cast("double"), "_mf": F.least(F.col("minutes") / num(24), num(1)),
                            "_rt": F.when(use, F.col("value") / F.col("minutes"))})
    ws, wl = F.exp(F.col("_off") / num(TAU_SHORT)) * F.col("_mf"), F.exp(F.col("_off") / num(TAU_LONG)) * F.col("_mf")
    rows = rows.withColumns({"_s": F.when(use, ws), "_l": F.when(use, wl)})
    S, L, r, m = F.col("_s"), F.col("_l"), F.col("_rt"), F.col("minutes")
    fade = {"s": math.exp(-ERA / TAU_SHORT), "l": math.exp(-ERA / TAU_LONG), "q": math.exp(-2 * ERA / TAU_LONG)}
    terms = {"ws": (S, "s"), "rs": (S * r, "s"), "ms": (S * m, "s"), "wl": (L, "l"), "rl": (L * r, "l"), "ml": (L * m, "l"),
             "rr": (L * r * r, "l"), "mm": (L * m * m, "l"), "w2": (L * L, "q")}
    inside = Window.partitionBy(*KEYS, "_era").orderBy("game_date").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*KEYS).orderBy("_era").rangeBetween(-1, -1)
    so_far = Window.partitionBy(*KEYS).orderBy("game_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_t_{k}": e for k, (e, _) in terms.items()})
    total = lambda k, f: F.sum(f"_t_{k}").over(inside) + num(fade[f]) * F.coalesce(F.sum(f"_t_{k}").over(earlier), num(0))
    rows = rows.withColumns({k: total(k, f) for k, (_, f) in terms.items()} | {"_g": F.count("value").over(so_far), "_u": F.count(F.when(use, F.col("value"))).over(so_far)})
    state = rows.select(*KEYS, "game_date", F.struct(*terms, F.col("_g").alias("g"), F.col("_u").alias("u"), F.col("game_date").alias("d")).alias("_state"))
    prior = A.strict_prior(state, probes, KEYS, "game_date", cutoff, {"_p": lambda w: F.last("_state", ignorenulls=True).over(w)}).filter(F.col("_p").isNotNull())
    v = lambda k: F.col(f"_p.{k}")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(num(0))
    out = prior.select(*KEYS, "_cut", v("g").alias("n_games"), v("u").alias("n_used"), ratio(v("rs"), v("ws")).alias("rate_short"), ratio(v("rl"), v("wl")).alias("rate_long"),
                       ratio(v("ms"), v("ws")).alias("minutes_short"), ratio(v("ml"), v("wl")).alias("minutes_long"), ratio(v("wl") * v("wl"), v("w2")).alias("n_eff"),
                       ratio(v("rr"), v("wl")).alias("_rr"), ratio(v("mm"), v("wl")).alias("_mm"), F.greatest(F.datediff("_cut", v("d")) - 1, F.lit(0)).cast("double").alias("rest_days"))
    spread = lambda sq, mean: F.greatest(F.col(sq) - F.col(mean) * F.col(mean), num(0))
    return out.withColumns({"rate_var": spread("_rr", "rate_long"), "minutes_var": spread("_mm", "minutes_long")}).drop("_rr", "_mm")


def league_priors(log: DataFrame, probes: DataFrame, cutoff: str = "slate") -> DataFrame:
    """League mean minutes and per-minute rate over strictly earlier days, per measure."""
    ok = F.col("minutes") > 0
    daily = log.groupBy("stat_type", "game_date").agg(
        F.sum("minutes").alias("_sm"), F.count("minutes").alias("_cm"),
        F.sum(F.when(ok, F.col("value") / F.col("minutes"))).alias("_sr"), F.count(F.when(ok, F.col("value"))).alias("_cr"))
    prior = A.strict_prior(daily, probes, ["stat_type"], "game_date", cutoff, {
        c: (lambda c: lambda w: F.sum(c).over(w))(c) for c in ("_sm", "_cm", "_sr", "_cr")})
    return prior.select("stat_type", "_cut", F.coalesce(F.col("_sm") / F.col("_cm"), num(MINUTES_PRIOR)).alias("league_minutes"),
                        F.coalesce(F.col("_sr") / F.col("_cr"), num(0)).alias("league_rate"))


def distribution(log: DataFrame, probes: DataFrame, cutoff: str = "slate") -> DataFrame:
    """Mean, spread and effective n per (player, measure, cut-off day) with at least five games."""
    d = decay_stats(log, probes, cutoff).filter((F.col("n_games") >= MIN_GAMES) & (F.col("n_used") >= MIN_GAMES))
    d = d.join(league_priors(log, probes, cutoff), ["stat_type", "_cut"], "left")
    n, k = F.col("n_eff"), X.stabilization("stat_type")
    r0 = (n * F.col("rate_long") + k * F.col("league_rate")) / (n + k)
    m0 = (n * F.col("minutes_long") + num(K_MINUTES) * F.col("league_minutes")) / (n + num(K_MINUTES))
    b2b = F.when(F.col("rest_days") == 0, num(1)).otherwise(num(0))
    r = F.greatest(num(0), r0 + num(ALPHA_RATE) * (F.col("rate_short") - F.col("rate_long")))
    m = F.greatest(num(0), m0 + num(BETA_MINUTES) * (F.col("minutes_short") - F.col("minutes_long")) + num(BETA_B2B) * b2b
                   + num(BETA_REST) * F.least(F.col("rest_days"), num(3)))
    d = d.withColumns({"_r": r, "_mm": m})
    var = F.col("_mm") * F.col("_mm") * (F.col("rate_var") + num(MIN_STD_RATE ** 2)) + F.col("_r") * F.col("_r") * (F.col("minutes_var") + num(MIN_STD_MINUTES ** 2))
    return d.select(*KEYS, "_cut", (F.col("_r") * F.col("_mm")).alias("mu_hat"), F.sqrt(F.greatest(var, num(1e-6))).alias("sigma_hat"), "n_eff")


def baseline(lines: DataFrame, log: DataFrame, cutoff: str = "slate") -> DataFrame:
    """Regressed mean with a Normal/empirical blend that trusts the empirical share as games accumulate."""
    days = day_features(log, lines, cutoff).select(*KEYS, "_cut", "n", "hist_mean", "hist_std")
    b = A.attach_prior(attach(lines, days, cutoff), league_prior(log, lines, cutoff), ["stat_type"], cutoff)
    b = b.join(merged(line_wins(log, lines, cutoff)).withColumnRenamed("_cut", cutoff), [*KEYS, cutoff, "line_score"], "left").filter(F.col("n") >= MIN_GAMES)
    k, n = X.stabilization("stat_type"), F.col("n")
    mean = (F.col("hist_mean") * n + F.col("league_mean") * k) / (n + k)
    normal = X.prob_over("line_score", mean, "hist_std")
    empirical = (F.col("wins") + num(1)) / (n + num(2))
    w = F.least(num(1), n / F.greatest(num(1), k))
    return b.withColumns({"mean": mean, "std": F.col("hist_std"), "prob_over": empirical * w + normal * (num(1) - w)})


def raw_probability(line: Column, mu: Column, sigma: Column) -> Column:
    """No continuity correction on raw forecasts."""
    return num(1) - X.normal_cdf((line - mu) / sigma)
