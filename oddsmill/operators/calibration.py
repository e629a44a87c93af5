"""Priors, conformal sets, distribution recalibration and monotone maps. Fitted state is one row per measure."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import num, r6

from oddsmill.session import durable

from .asof import asof_latest
from .distribution import exact_quantiles, prefix_sums, ranged, value_counts
from .ordering import group_positions

GLOBAL = "__global__"


# --- context priors ----------------------------------------------------------------------------------------
def fit_context_priors(df: DataFrame) -> DataFrame:
    """Per measure: over rate, line tercile edges and bucket rates, with row floors. One row per measure."""
    floor = K.MIN_BUCKET_ROWS
    overall = df.agg(F.round(F.avg(F.col("over_label").cast("double")), 4)).scalar()
    stat = df.groupBy("stat_type").agg(F.count(F.lit(1)).alias("n"), F.count("line_score").alias("_nl"), F.avg(F.col("over_label").cast("double")).alias("_m"))
    edges = exact_quantiles(df, ["stat_type"], "line_score", {"e1": 1 / 3, "e2": 2 / 3}).select(
        "stat_type", F.round("e1", 2).alias("e1"), F.round("e2", 2).alias("e2"))
    base = stat.join(edges, "stat_type", "left").withColumns({
        "global_prior": overall,
        "stat_prior": F.when(F.col("n") >= floor, F.round("_m", 4)).otherwise(overall),
        "has_edges": F.col("_nl") >= 3 * floor,
    })
    small = base.select("stat_type", "e1", "e2", "has_edges")
    b = df.join(small, "stat_type").filter("has_edges").groupBy("stat_type", line_bucket(F.col("line_score"), F.col("e1"), F.col("e2")).alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"), F.avg(F.col("over_label").cast("double")).alias("_r"))
    rates = b.filter(F.col("_c") >= floor).groupBy("stat_type").agg(
        *[F.max(F.when(F.col("_b") == i, F.round("_r", 4))).alias(f"_b{i}") for i in range(3)])
    out = base.join(rates, "stat_type", "left")
    return out.select("stat_type", "n", "global_prior", "stat_prior",
                      *[F.when(F.col("has_edges"), F.col(e)).alias(e) for e in ("e1", "e2")],
                      *[F.when(F.col("has_edges"), F.coalesce(f"_b{i}", "stat_prior")).otherwise(F.col("stat_prior")).alias(f"bucket{i}") for i in range(3)])


def line_bucket(line: Column, e1: Column, e2: Column) -> Column:
    """Lines on an edge belong to the lower bucket; equal edges leave two buckets."""
    return F.when(line <= e1, 0).when((e1 != e2) & (line <= e2), 1).otherwise(F.when(e1 == e2, 1).otherwise(2))


def priors_as_of(df: DataFrame, cuts: DataFrame, day: str = "slate") -> DataFrame:
    """``fit_context_priors`` cut at any day: one row per (stat_type, day) of ``cuts``, fitted on strictly earlier days of ``df`` only.

    Days are kept as counts per (measure, day, line), which add up: over rates are prefix sums of them, and the terciles
    at a cut are read from the summed counts per line. The work after the first aggregate is measures x distinct
    lines x days, however many rows a day has. A cut without earlier rows has null priors."""
    floor, number = K.MIN_BUCKET_ROWS, F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    cells = df.groupBy("stat_type", day, "line_score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("over_label").cast("bigint")).alias("over"))
    cells = durable(cells)
    cuts = cuts.select("stat_type", day).distinct()
    marks = cells.select("stat_type", "line_score").distinct().join(cuts, "stat_type").withColumn("_cut", F.lit(True))
    before = Window.partitionBy("stat_type", "line_score").orderBy("_d").rangeBetween(Window.unboundedPreceding, -1)   # a row per day
    state = cells.unionByName(marks, allowMissingColumns=True).withColumn("_d", number)
    state = state.withColumns({c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "over")}).filter(F.col("_cut") & (F.col("n") > 0))
    group = Window.partitionBy("stat_type", day)
    lines = durable(state.select("stat_type", day, "line_score", "n", "over").withColumns({
        "_upto": F.sum("n").over(group.orderBy("line_score").rowsBetween(Window.unboundedPreceding, 0)),   # null lines sort first
        "_none": F.sum(F.when(F.col("line_score").isNull(), F.col("n")).otherwise(0)).over(group), "_all": F.sum("n").over(group)}))
    low, high, nl = F.col("_upto") - F.col("n") - F.col("_none"), F.col("_upto") - F.col("_none"), F.col("_all") - F.col("_none")

    def edge(level: float) -> Column:
        h = (nl - 1) * num(level)
        at = lambda pos: F.max(F.when(F.col("line_score").isNotNull() & (low <= pos) & (pos < high), F.col("line_score")))
        first, last = at(F.floor(h)), at(F.ceil(h))
        return F.round(first + (last - first) * F.max(h - F.floor(h)), 2)

    stat = lines.groupBy("stat_type", day).agg(
        F.sum("n").alias("n"), F.max(nl).alias("_nl"), (F.sum("over") / F.sum("n")).alias("_m"), edge(1 / 3).alias("e1"), edge(2 / 3).alias("e2"))
    every = lines.groupBy(day).agg(F.round(F.sum("over") / F.sum("n"), 4).alias("global_prior"))
    base = cuts.join(stat, ["stat_type", day], "left").join(every, day, "left").withColumns({
        "stat_prior": F.when(F.col("n") >= floor, F.round("_m", 4)).otherwise(F.col("global_prior")), "has_edges": F.coalesce(F.col("_nl") >= 3 * floor, F.lit(False))})
    base = durable(base)
    edges = base.filter("has_edges").select("stat_type", day, "e1", "e2")
    b = lines.select("stat_type", day, "line_score", "n", "over").join(edges, ["stat_type", day]).groupBy(
        "stat_type", day, line_bucket(F.col("line_score"), F.col("e1"), F.col("e2")).alias("_b")).agg(F.sum("n").alias("_c"), F.sum("over").alias("_o"))
    rates = b.filter(F.col("_c") >= floor).groupBy("stat_type", day).agg(
        *[F.max(F.when(F.col("_b") == i, F.round(F.col("_o") / F.col("_c"), 4))).alias(f"_b{i}") for i in range(3)])
    out = base.join(rates, ["stat_type", day], "left")
    return out.select("stat_type", day, F.coalesce("n", F.lit(0)).alias("n"), "global_prior", "stat_prior",
                      *[F.when(F.col("has_edges"), F.col(e)).alias(e) for e in ("e1", "e2")],
                      *[F.when(F.col("has_edges"), F.coalesce(f"_b{i}", "stat_prior")).otherwise(F.col("stat_prior")).alias(f"bucket{i}") for i in range(3)])


PRIOR_COLUMNS = ["stat_prior", "e1", "e2", "bucket0", "bucket1", "bucket2"]


def context_prior(df: DataFrame, priors: DataFrame) -> DataFrame:
    """Bucket, then measure, then global prior; pulled toward one half and clamped."""
    j = df.join(priors.select("stat_type", *PRIOR_COLUMNS), "stat_type", "left")
    fallback = priors.agg(F.max("global_prior")).scalar()
    return j.withColumn("context_prior", chosen_prior(fallback)).drop(*PRIOR_COLUMNS)


def context_prior_as_of(df: DataFrame, priors: DataFrame, day: str = "slate") -> DataFrame:
    """The same with the priors of the row's own day (from ``priors_as_of`` over the measures and days of ``df``)."""
    j = df.join(priors.select("stat_type", day, "global_prior", *PRIOR_COLUMNS), ["stat_type", day], "left")
    return j.withColumn("context_prior", chosen_prior(F.col("global_prior"))).drop("global_prior", *PRIOR_COLUMNS)


def chosen_prior(fallback: Column) -> Column:
    b = line_bucket(F.col("line_score"), F.col("e1"), F.col("e2"))
    chosen = F.when(F.col("e1").isNotNull() & F.col("line_score").isNotNull(),
                    F.when(b == 0, F.col("bucket0")).when(b == 1, F.col("bucket1")).otherwise(F.col("bucket2")))
    raw = F.coalesce(chosen, F.col("stat_prior"), fallback, num(0.5))
    centred = raw + num(K.PRIOR_CENTER_WEIGHT) * (num(0.5) - raw)
    return X.clip(centred, K.PRIOR_FLOOR, K.PRIOR_CEILING)


# --- conformal ---------------------------------------------------------------------------------------------
def fit_conformal(long: DataFrame, alpha: float = 0.10) -> DataFrame:
    """q-hat per expert: the quantile of 1 - P(true label) at the finite-sample level."""
    scored = long.withColumn("_s", F.when(F.col("over_label") == 1, num(1) - F.col("p")).otherwise(F.col("p")))
    level = F.least(num(1), num(1 - alpha) * (num(1) + num(1) / F.col("n")))
    return exact_quantiles(scored, ["expert"], "_s", {"q_hat": level})


def majority_set_size(df: DataFrame, experts: list[str], q_hat: DataFrame) -> DataFrame:
    """1 when more than half of the present experts keep exactly one label, else 2; null without experts."""
    wide = q_hat.groupBy().agg(*[F.max(F.when(F.col("expert") == e, F.col("q_hat"))).alias(e) for e in experts])
    df = df.withColumn("_q", wide.select(F.struct(*experts)).scalar())
    q = F.col("_q")
    sizes = [F.when(F.col(e).isNotNull() & q[e].isNotNull(), X.set_size(e, q[e])) for e in experts]
    single = sum((F.coalesce((s == 1).cast("int"), F.lit(0)) for s in sizes), F.lit(0))
    known = sum((s.isNotNull().cast("int") for s in sizes), F.lit(0))
    return df.withColumn("set_size", F.when(known > 0, F.when(single > known / 2, 1).otherwise(2))).drop("_q")


# --- temperature -------------------------------------------------------------------------------------------
def temperature_grid() -> list[float]:
    return [round(0.5 + 0.1 * i, 1) for i in range(26)] + [3.0 + 0.5 * i for i in range(1, 15)]


def temperature_curve(df: DataFrame, p: str = "p_nn", y: str = "over_label") -> DataFrame:
    """Negative log likelihood for every temperature, all from one pass (one aggregate column each)."""
    z, label, eps = X.logit(p), F.col(y).cast("double"), num(1e-6)

    def nll(temp: float) -> Column:
        q = X.sigmoid(z / num(temp))
        return F.avg(-(label * F.ln(q + eps) + (num(1) - label) * F.ln(num(1) - q + eps)))

    grid = temperature_grid()
    one = df.filter(F.col(p).isNotNull()).agg(*[nll(g).alias(f"t{i}") for i, g in enumerate(grid)])
    long = one.unpivot([], [f"t{i}" for i in range(len(grid))], "_n", "nll")
    temp = F.element_at(F.array(*[num(g) for g in grid]), F.substring("_n", 2, 3).cast("int") + 1)
    best = Window.partitionBy().orderBy("nll", "temperature")   # forty rows
    return long.select(temp.alias("temperature"), "nll").withColumn("is_best", F.row_number().over(best) == 1)


# --- Gaussian recalibration --------------------------------------------------------------------------------
def recency_weight(day: Column, clock: Column, tau: float) -> Column:
    return F.exp(-F.greatest(F.datediff(clock, day), F.lit(0)).cast("double") / num(tau))


def scoped(df: DataFrame) -> DataFrame:
    """Each row counts for its measure and for the global fallback."""
    return df.withColumn("scope", F.explode(F.array(F.col("stat_type"), F.lit(GLOBAL))))


#: Rounds of Fisher scoring, and the smallest variance a row is weighted by.
SCORING_ROUNDS, MIN_VARIANCE = 6, 1e-6
_SPREAD = ("s", "o", "t")   # what the variance is made of: the forecast's own, a constant, and 1 / (n_eff + 1)


def _not_negative(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The least squares solution of ``h @ x = g`` without negative entries: the best of the supports that have one."""
    best, top = np.zeros(3), 0.0
    for k in range(1, 4):
        for support in itertools.combinations(range(3), k):
            part = h[np.ix_(support, support)]
            if np.linalg.det(part) <= 1e-12 * np.prod(np.diag(part)):
                continue
            x = np.linalg.solve(part, g[list(support)])
            if (x > 0).all() and x @ g[list(support)] > top:
                best, top = np.zeros(3), x @ g[list(support)]
                best[list(support)] = x
    return best


def _scored(m: dict[str, float]) -> tuple[float, ...]:
    """Next a, b and the three variance components from one scope's moments."""
    det = m["o"] * m["xx"] - m["x"] * m["x"]
    a = (m["o"] * m["xy"] - m["x"] * m["y"]) / det if det > 1e-12 * m["o"] * m["xx"] else 1.0
    h = np.array([[m.get(f"h{p}{q}", m.get(f"h{q}{p}")) for q in _SPREAD] for p in _SPREAD])
    return (a, (m["y"] - a * m["x"]) / m["o"], *(float(v) for v in _not_negative(h, np.array([m[f"g{c}"] for c in _SPREAD]))))


def fit_gaussian(df: DataFrame, weight: str, min_rows: int, rounds: int = SCORING_ROUNDS) -> DataFrame:
    """Per scope, the weighted likelihood fit of y as Normal(a mu + b, c^2 sigma^2 + d^2 + eta / (n_eff + 1)) by Fisher
    scoring: ``scope, rows, a, b, c, d, eta``.

    A round is one aggregate of moments per scope. The mean is least squares weighted by w / V, the variance least squares of
    the squared residuals weighted by w / V^2 over components that may not turn negative; both are blocks of the same
    information matrix. Only moments, one row per measure, reach the driver. A missing n_eff counts as 1; scopes
    with fewer than ``min_rows`` rows have no fit."""
    spark = df.sparkSession
    x, y, s, t = F.col("mu_hat"), F.col("y_true"), F.col("sigma_hat") * F.col("sigma_hat"), num(1) / (F.coalesce("n_eff", num(1)) + num(1))
    rows = scoped(df).select("scope", F.col(weight).alias("w"), x.alias("x"), y.alias("y"), s.alias("s"), num(1).alias("o"), t.alias("t"))
    sizes = {r["scope"]: r["n"] for r in rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows).collect()}
    fit = dict.fromkeys(sizes, (1.0, 0.0, 1.0, 0.0, 0.0))
    for _ in range(rounds if fit else 0):
        now = spark.createDataFrame([(k, *p) for k, p in fit.items()], "scope string, a double, b double, ks double, ko double, kt double")
        near = rows.join(F.broadcast(now), "scope")   # one row per measure
        variance = F.greatest(F.col("ks") * F.col("s") + F.col("ko") + F.col("kt") * F.col("t"), num(MIN_VARIANCE))
        near = near.withColumn("v", variance).withColumn("e", F.col("y") - F.col("a") * F.col("x") - F.col("b"))
        u, q = F.col("w") / F.col("v"), F.col("w") / (F.col("v") * F.col("v"))
        moments = {"o": u, "x": u * F.col("x"), "y": u * F.col("y"), "xx": u * F.col("x") * F.col("x"), "xy": u * F.col("x") * F.col("y")}
        moments |= {f"h{a}{b}": q * F.col(a) * F.col(b) for a, b in itertools.combinations_with_replacement(_SPREAD, 2)}
        moments |= {f"g{c}": q * F.col(c) * F.col("e") * F.col("e") for c in _SPREAD}
        found = near.groupBy("scope").agg(*[F.sum(m).alias(k) for k, m in moments.items()]).collect()
        fit |= {r["scope"]: _scored(r.asDict()) for r in found if r["o"] > 0}
    out = [(k, sizes[k], a, b, ks ** 0.5, ko ** 0.5, kt) for k, (a, b, ks, ko, kt) in fit.items()]
    return spark.createDataFrame(out, "scope string, rows bigint, a double, b double, c double, d double, eta double")


def with_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """Rows of fitted scopes with their parameters. A scope is one row on the right: a join by shuffle would put all rows of a
    scope, for the global one half of the table, into one task."""
    return df.join(F.broadcast(params), "scope")


def apply_gaussian(df: DataFrame) -> DataFrame:
    """Adds mu_cal and sigma_cal from a, b, c, d and eta columns."""
    wide = F.pow(F.col("c") * F.col("sigma_hat"), num(2)) + F.pow("d", num(2)) + F.col("eta") / (F.coalesce("n_eff", num(1)) + num(1))
    return df.withColumns({"mu_cal": F.col("a") * F.col("mu_hat") + F.col("b"), "sigma_cal": F.sqrt(wide)})


def pit(y: Column, mu: Column, sigma: Column) -> Column:
    return X.clip(X.normal_cdf((y - mu) / F.greatest(sigma, num(1e-6))), 0.0, 1.0)


#: Knots of a map at most.
KNOTS = 512


def pit_knots(df: DataFrame, keys: list[str], u: str, knots: int = KNOTS) -> DataFrame:
    """Empirical CDF of u at up to ``knots`` evenly spaced ranks: one row (keys, j, x, y) per knot."""
    counts = ranged(value_counts(df, keys, u), keys, u)
    sizes = counts.groupBy(*keys).agg(F.sum("_cnt").alias("n"))
    placed = prefix_sums(counts, keys, "_b", u, {"_before": "_cnt"}).join(F.broadcast(sizes), keys)   # one row per scope
    n, lo, hi = F.col("n"), F.col("_before"), F.col("_before") + F.col("_cnt")
    step = F.lit(knots - 1)
    first = F.ceil(lo * step / (n - 1))
    last = F.ceil(hi * step / (n - 1)) - 1
    few = n <= knots
    js = F.when(few, F.sequence(lo, hi - 1)).when(first <= F.least(last, step), F.sequence(first.cast("bigint"), F.least(last, step.cast("bigint")).cast("bigint")))
    rank = F.when(few, F.col("j")).otherwise(F.floor(F.col("j") * (n - 1) / step))
    return placed.withColumn("j", F.explode(js)).select(*keys, F.col("j").cast("bigint").alias("j"), F.col(u).alias("x"), ((rank + num(0.5)) / n).alias("y"))


def knot_arrays(knots: DataFrame, keys: list[str]) -> DataFrame:
    """Knots of a scope as one array in rank order: at most 512 entries."""
    return knots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("j", "x", "y"))).alias("_k")).select(
        *keys, F.col("_k")["x"].alias("kx"), F.col("_k")["y"].alias("ky"))


def _at_or_below(k: str, u: Column) -> Column:
    """How many entries of the ascending array ``k`` are at most ``u``, by halving: each step adds its length while the entry there is."""
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(KNOTS.bit_length()))])
    fits = lambda at: (at <= F.size(k)) & (F.get(k, at - 1) <= u)
    return F.when(F.size(k) < 2 * KNOTS, F.aggregate(halves, F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))).otherwise(F.size(F.filter(k, lambda v: v <= u)))


def interpolate(u: Column, kx: str = "kx", ky: str = "ky", left: float | None = 0.0, right: float | None = 1.0) -> Column:
    """Piecewise linear through the knots; beyond them the given constants, or the end values when None. The place is looked up once a row."""
    n = F.size(kx)
    x = lambda k: F.get(kx, k - 1)
    y = lambda k: F.get(ky, k - 1)
    low = num(left) if left is not None else y(F.lit(1))
    high = num(right) if right is not None else y(n)

    def value(i: Column) -> Column:
        inner = y(i) + (u - x(i)) / F.when(x(i + 1) > x(i), x(i + 1) - x(i)) * (y(i + 1) - y(i))
        return F.when(i == 0, low).when(i == n, F.when(u == x(n), y(n)).otherwise(high)).otherwise(inner)

    return F.transform(F.array(_at_or_below(kx, u)), value)[0]


def with_calibrator(df: DataFrame, params: DataFrame, knots: DataFrame | None = None, per_stat: list[str] | None = None) -> DataFrame:
    """Attach the measure's calibrator, else the global one; ``status`` says which. One row per scope on the right."""
    right = params.select("scope", "a", "b", "c", "d", "eta")
    if knots is not None:
        right = right.join(knot_arrays(knots, ["scope"]), "scope")
    mine = right if per_stat is None else right.filter(F.col("scope").isin(*per_stat, GLOBAL))
    pack = F.struct(*[c for c in mine.columns if c != "scope"])
    own = mine.filter(F.col("scope") != GLOBAL).select(F.col("scope").alias("stat_type"), pack.alias("_own"))
    shared = mine.filter(F.col("scope") == GLOBAL).select(pack.alias("_s"))
    j = df.join(F.broadcast(own), "stat_type", "left").withColumn("_all", shared.scalar())
    best = F.coalesce("_own", "_all")
    status = F.when(F.col("_own").isNotNull(), "per_stat").when(F.col("_all").isNotNull(), "fallback_global").otherwise("raw")
    return j.withColumn("status", status).withColumn("_best", best).select("*", "_best.*").drop("_own", "_all", "_best")


def evaluate(df: DataFrame, keys: list[str], mu: str, sigma: str, tag: str) -> DataFrame:
    """NLL, CRPS, central interval coverage and PIT distance from uniform."""
    m, s, y = F.col(mu), F.greatest(F.col(sigma), num(1e-6)), F.col("y_true")
    z = (y - m) / s
    crps = s * (z * (2.0 * X.normal_cdf(z) - num(1)) + 2.0 * X.normal_pdf(z) - num(1 / 3.141592653589793 ** 0.5))
    quant = {"cov50": 0.67448975, "cov80": 1.28155157, "cov90": 1.64485363}   # fixed values: central interval half-widths
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.ln(s) + num(0.5) * z * z).alias("nll"), F.avg(crps).alias("crps"),
        *[F.avg((F.abs(y - m) <= num(q) * F.col(sigma)).cast("double")).alias(k) for k, q in quant.items()])
    ks = ks_uniform(df.withColumn("_u", pit(y, m, F.col(sigma))), keys, "_u")
    return base.join(ks, keys).select(*keys, "n", *[r6(c).alias(f"{c}_{tag}") for c in ("nll", "crps", *quant, "pit_ks")])


def ks_uniform(df: DataFrame, keys: list[str], u: str) -> DataFrame:
    counts = ranged(value_counts(df, keys, u), keys, u)
    sizes = counts.groupBy(*keys).agg(F.sum("_cnt").alias("_n"))
    p = prefix_sums(counts, keys, "_b", u, {"_before": "_cnt"}).join(F.broadcast(sizes), keys)   # one row per scope
    gap = lambda rank: F.abs(rank / F.col("_n") - F.col(u))
    return p.groupBy(*keys).agg(F.max(F.greatest(gap(F.col("_before") + 1), gap(F.col("_before") + F.col("_cnt")))).alias("pit_ks"))


# --- isotonic ----------------------------------------------------------------------------------------------
#: Blocks that are pooled in one group at most.
POOLED = 4096


def _pool(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators of ordered blocks (w, s, lo, hi). Pooling what is pooled already, piece by piece, gives the
    same blocks as pooling all at once."""
    out: list[list[float]] = []
    for w, s, lo, hi in pdf.sort_values("lo")[["w", "s", "lo", "hi"]].itertuples(index=False):
        out.append([w, s, lo, hi])
        while len(out) > 1 and out[-2][1] * out[-1][0] >= out[-1][1] * out[-2][0]:
            w2, s2, _, hi2 = out.pop()
            out[-1][0] += w2
            out[-1][1] += s2
            out[-1][3] = hi2
    return pd.DataFrame(out, columns=["w", "s", "lo", "hi"])


def pooled_blocks(cells: DataFrame, window: int = POOLED) -> DataFrame:
    """Stored blocks (scope, w, s, lo, hi) of ``cells`` of the same shape, monotone in s / w.

    A round numbers the blocks of each scope in order, and pools windows of ``window`` neighbours. Windows are shifted by half from
    round to round, so violators on two sides of a seam meet in the next. It is over when every scope fits one window, or
    when two rounds in a row, whose seams differ, found nothing to pool."""
    def pool(key, pdf):
        return _pool(pdf).assign(scope=key[0])[["scope", "w", "s", "lo", "hi"]]

    blocks, quiet, shift, count = cells, 0, 0, None
    while True:
        placed = group_positions(blocks, ["scope"], ["lo"]).withColumn("_at", F.floor((F.col("pos") + shift) / window))
        whole = (placed.agg(F.max("_at")).first()[0] or 0) == 0
        blocks = durable(placed.groupBy("scope", "_at").applyInPandas(pool, "scope string, w double, s double, lo double, hi double"))
        left = blocks.count()
        quiet = quiet + 1 if left == count else 0
        if whole or quiet == 2:
            return blocks
        count, shift = left, window // 2 - shift


def fit_isotonic(df: DataFrame, p: str, y: str, min_rows: int = 100, window: int = POOLED) -> DataFrame:
    """Monotone map per measure and overall, as stored blocks (scope, n, lo, hi, value, next_lo, next_value).

    Starts from counts per (scope, probability). A map is flat inside a block and linear from one to the next."""
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull() & ~F.col("stat_type").isin(*K.CALIBRATION_EXCLUDED_STATS))
    cells = scoped(rows).groupBy("scope", F.col(p).alias("lo")).agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.sum(F.col(y).cast("double")).alias("s"))
    blocks = pooled_blocks(cells.select("scope", "w", "s", "lo", F.col("lo").alias("hi")), window)
    size = blocks.groupBy("scope").agg(F.sum("w").alias("n"), F.sum("s").alias("_ones"))
    keep = size.filter((F.col("n") >= min_rows) & ((F.col("scope") == GLOBAL) | ((F.col("_ones") > 0) & (F.col("_ones") < F.col("n")))))
    placed = group_positions(blocks.join(keep.select("scope", F.col("n").cast("bigint").alias("n")), "scope"), ["scope"], ["lo"])
    placed = placed.select("scope", "n", "pos", "lo", "hi", X.clip(F.col("s") / F.col("w"), 0.01, 0.99).alias("value"))
    after = placed.select("scope", (F.col("pos") - 1).alias("pos"), F.col("lo").alias("next_lo"), F.col("value").alias("next_value"))
    return durable(placed.join(after, ["scope", "pos"], "left").drop("pos"))


def isotonic_at(probes: DataFrame, blocks: DataFrame, x: str, name: str) -> DataFrame:
    """``probes(scope, x, ...)`` with the value of its scope's map (null without one): the last block that begins at or below
    ``x`` is looked up as of it, so no row carries a map and a map may have any number of blocks."""
    steps = blocks.select("scope", "lo", "hi", "value", "next_lo", "next_value")
    near = asof_latest(probes, steps, ["scope"], x, "lo", ["hi", "value", "next_lo", "next_value"], inclusive=True, prefix="_", tie=["hi"], kind="double")
    low = blocks.groupBy("scope").agg(F.min("value").alias("_low"))
    rise = (F.col(x) - F.col("_hi")) / (F.col("_next_lo") - F.col("_hi")) * (F.col("_next_value") - F.col("_value"))
    inner = F.when((F.col(x) <= F.col("_hi")) | F.col("_next_lo").isNull(), F.col("_value")).otherwise(F.col("_value") + rise)
    out = near.join(low, "scope", "left").withColumn(name, F.when(F.col(x).isNotNull(), F.coalesce(inner, "_low")))
    return out.drop("_hi", "_value", "_next_lo", "_next_value", "_low")


#: Where a map's shape is looked at; the three in the middle must not move far.
SHAPE_AT, MIDBAND = [round(0.35 + 0.05 * i, 2) for i in range(7)], (0.45, 0.50, 0.55)


def isotonic_shapes(blocks: DataFrame) -> DataFrame:
    """One row per scope: n, knots, and the shape checks that send a degenerate map to the fallback."""
    scopes = blocks.groupBy("scope").agg(F.max("n").alias("n"), F.sum(F.lit(1) + (F.col("lo") < F.col("hi")).cast("int")).alias("knots"))
    probes = scopes.select("scope", F.explode(F.array(*map(num, SHAPE_AT))).alias("_x"))
    seen = isotonic_at(probes, blocks, "_x", "_v").groupBy("scope").agg(
        F.count_distinct(F.round("_v", 6)).cast("int").alias("unique_outputs"), (F.max("_v") - F.min("_v")).alias("output_range"),
        F.max(F.when(F.col("_x").isin(*MIDBAND), F.abs(F.col("_v") - F.col("_x")))).alias("max_midband_shift"))
    reason = (
        F.when(F.col("unique_outputs") < 4, "degenerate_low_unique_outputs").when(F.col("output_range") < 0.04, "degenerate_low_output_range")
        .when(F.col("max_midband_shift") > 0.12, "degenerate_excessive_midband_shift"))
    return scopes.join(seen, "scope").withColumn("reason", F.when(F.col("scope") != GLOBAL, reason))


def apply_isotonic(df: DataFrame, blocks: DataFrame, p: str) -> DataFrame:
    """Calibrated probability with its source and mode."""
    shapes = durable(isotonic_shapes(blocks))   # one row per scope
    own = shapes.filter(F.col("scope") != GLOBAL).select(F.col("scope").alias("stat_type"), F.lit(True).alias("_own"), F.col("reason").alias("_why"))
    shared = F.lit(not shapes.filter(F.col("scope") == GLOBAL).isEmpty())
    good = F.coalesce("_own", F.lit(False)) & F.col("_why").isNull()
    j = df.join(own, "stat_type", "left").withColumn("scope", F.when(good, F.col("stat_type")).when(shared, GLOBAL))
    j = isotonic_at(j, blocks, p, "_v")
    value = F.coalesce(X.clip(F.col("_v"), 0.01, 0.99), F.col(p))
    source = F.when(good, "per_stat").when(shared, "global").otherwise("identity")
    mode = (F.when(good, "active").when(F.col("_why").isNotNull(), F.when(shared, "degenerate_fallback").otherwise("degenerate_identity"))
            .when(shared, "fallback_global").otherwise("none"))
    return j.withColumns({"p_calibrated": value, "calibrator_source": source, "calibrator_mode": mode}).drop("scope", "_own", "_why", "_v")


# --- Platt -------------------------------------------------------------------------------------------------
#: Determinant of the curvature from which on a step is taken.
PLATT_CURVATURE = 1e-9


def fit_platt(df: DataFrame, p: str, y: str, rounds: int = 25) -> tuple[float, float]:
    """Unpenalised logistic regression on the logit by Newton's steps. Returns (slope, intercept).

    Each round is one pass that sums gradient and curvature, five numbers. Labels that can't be told apart from a
    line without end (one class, no rows, one logit) leave the steps where the curvature vanishes."""
    rows = durable(df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).select(X.logit(p, 1e-6).alias("z"), F.col(y).cast("double").alias("y")))
    a, b, z = 1.0, 0.0, F.col("z")
    for _ in range(rounds):
        m = X.sigmoid(num(a) * z + num(b))
        w, off = m * (num(1) - m), F.col("y") - m
        g0, g1, h0, h1, h2 = rows.agg(*[F.coalesce(F.sum(e), num(0)) for e in (off, off * z, w, w * z, w * z * z)]).first()
        det = h0 * h2 - h1 * h1
        if det <= PLATT_CURVATURE:
            break
        da, db = (h0 * g1 - h1 * g0) / det, (h2 * g0 - h1 * g1) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-11:
            break
    return a, b


def platt(p: Column, a: float, b: float) -> Column:
    return X.clip(X.sigmoid(num(a) * X.logit(p, 1e-6) + num(b)), 0.01, 0.99)
