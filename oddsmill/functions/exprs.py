"""Scalar library: every function takes and returns ``Column`` so it stays inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K

ColumnOrName = Column | str


def c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x: float) -> Column:
    return F.lit(float(x))


def r6(x: ColumnOrName) -> Column:
    return F.round(c(x).cast("double"), 6)


def big(x: ColumnOrName) -> Column:
    return c(x).cast("bigint")


def finite(x: ColumnOrName) -> Column:
    """NaN and infinities become null, so a missing value has one spelling."""
    x = c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == num(float("inf"))), F.lit(None)).otherwise(x)


def clip(x: ColumnOrName, lo: float, hi: float) -> Column:
    """Clamp that keeps nulls (greatest/least would skip them)."""
    x = c(x)
    return F.when(x.isNotNull(), F.greatest(num(lo), F.least(num(hi), x)))


def logit(p: ColumnOrName, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (num(1) - q))


def sigmoid(z: ColumnOrName) -> Column:
    z = clip(z, -500.0, 500.0)
    return num(1) / (num(1) + F.exp(-z))


def log_loss(y: ColumnOrName, p: ColumnOrName, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1.0 - eps)
    y = c(y).cast("double")
    return -(y * F.ln(q) + (num(1) - y) * F.ln(num(1) - q))


def pick_over(p: ColumnOrName) -> Column:
    return c(p) >= num(0.5)


def p_pick(p: ColumnOrName) -> Column:
    p = c(p)
    return F.when(p.isNotNull(), F.greatest(p, num(1) - p))


def hit(p: ColumnOrName, y: ColumnOrName) -> Column:
    """1.0 when the 0.5-threshold pick equals the label, null when either is missing."""
    p, y = c(p), c(y)
    return F.when(p.isNotNull() & y.isNotNull(), (pick_over(p) == (y == 1)).cast("double"))


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def count_true(flag: Column) -> Column:
    return F.coalesce(F.sum(flag.cast("bigint")), F.lit(0).cast("bigint"))


# --- Normal distribution -------------------------------------------------------------------------
# Abramowitz-Stegun 7.1.26 coefficients of erf (absolute error below 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: ColumnOrName) -> Column:
    z = c(z)
    x = F.abs(z) / num(2.0 ** 0.5)
    t = num(1) / (num(1) + num(ERF_P) * x)
    poly = reduce(lambda acc, a: (acc + num(a)) * t if acc is not None else num(a) * t, reversed(ERF_A), None)
    erf = num(1) - poly * F.exp(-x * x)
    return F.when(z >= 0, num(0.5) * (num(1) + erf)).otherwise(num(0.5) * (num(1) - erf))


def normal_pdf(z: ColumnOrName) -> Column:
    z = c(z)
    return F.exp(-z * z / num(2)) / num((2 * 3.141592653589793) ** 0.5)


def prob_over(line: ColumnOrName, mean: ColumnOrName, std: ColumnOrName, min_std: float = 0.5) -> Column:
    s = F.greatest(c(std), num(min_std))
    return num(1) - normal_cdf((c(line) - c(mean)) / s)


def confidence(p: ColumnOrName) -> Column:
    q = F.coalesce(clip(finite(p), 0.0, 1.0), num(0.5))
    return F.greatest(q, num(1) - q)


# --- Lookups -------------------------------------------------------------------------------------

def sql_literal(v: str | float | int) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{float(v)!r}D" if isinstance(v, float) else str(v)


def constant_array(values: list) -> Column:
    return F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")")


def lookup(mapping: dict, key: Column) -> Column:
    """Constant map lookup, null when absent."""
    return F.expr("map(" + ", ".join(sql_literal(v) for kv in mapping.items() for v in kv) + ")")[key]


def team_code(x: ColumnOrName, overrides: dict[str, str] = K.TEAM_OVERRIDES) -> Column:
    key = F.nullif(F.upper(F.trim(c(x))), F.lit(""))
    return F.coalesce(lookup(overrides, key), key)


def neff_bucket(n: ColumnOrName) -> Column:
    n = c(n)
    return (
        F.when(n.isNull(), "neff_unknown").when(n < 5, "neff_lt5").when(n < 15, "neff_5_15").otherwise("neff_ge15")
    )


def stabilization(stat: ColumnOrName) -> Column:
    return F.coalesce(lookup(K.STABILIZATION_GAMES, c(stat)), num(K.DEFAULT_STABILIZATION))


# --- Expert arithmetic ---------------------------------------------------------------------------

def clip_expert(p: ColumnOrName) -> Column:
    return clip(p, K.EXPERT_FLOOR, K.EXPERT_CEIL)


def present(cols: list[ColumnOrName]) -> Column:
    """How many of the columns are not null."""
    return reduce(lambda a, b: a + b, [c(x).isNotNull().cast("int") for x in cols])


def logit_mean(cols: list[ColumnOrName], eps: float = 1e-7) -> Column:
    """Sigmoid of the mean logit over the experts that are present; 0.5 when none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(logit(x, eps), num(0)) for x in cols])
    n = present(cols)
    return F.when(n > 0, sigmoid(total / n)).otherwise(num(0.5))


def weighted_logit(cols: list[ColumnOrName], weights: list[Column], eps: float = 1e-6) -> Column:
    """Sigmoid of the weighted mean logit over present experts with a positive weight; 0.5 when none counts."""
    def usable(x):
        return F.when(c(x).isNotNull(), num(1)).otherwise(num(0))

    total = reduce(lambda a, b: a + b, [w * F.coalesce(logit(x, eps), num(0)) for x, w in zip(cols, weights)])
    mass = reduce(lambda a, b: a + b, [w * usable(x) for x, w in zip(cols, weights)])
    return F.when(mass > num(eps), sigmoid(total / mass)).otherwise(num(0.5))


def shrink(p: ColumnOrName, n_eff: ColumnOrName, prior: ColumnOrName) -> Column:
    n = c(n_eff)
    fade = num(K.SHRINK_MAX) - num(K.SHRINK_MAX - K.SHRINK_MIN) * F.least(num(1), n / num(30))
    k = F.when(n > 0, fade).otherwise(num(K.SHRINK_MAX))
    target = F.coalesce(c(prior), num(K.SHRINK_ANCHOR))
    return sigmoid((num(1) - k) * logit(p) + k * logit(target))


def risk_adjusted(p: ColumnOrName, n_eff: ColumnOrName, status: ColumnOrName) -> Column:
    n, s = c(n_eff), c(status)
    base = F.when(n.isNull() | (n < 5), num(0.65)).otherwise(num(0.85))
    rho = (
        F.when(s == "raw", F.least(base, num(0.60)))
        .when(s == "fallback_global", F.least(base, num(0.75)))
        .otherwise(base)
    )
    return num(0.5) + rho * (p_pick(p) - num(0.5))


def piecewise(x: Column, knots: list[tuple[float, float]], beyond: Column) -> Column:
    """Linear interpolation through ``knots`` (closed on the right), then ``beyond``."""
    out = None
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        value = num(y0) + (x - num(x0)) / num(x1 - x0) * num(y1 - y0)
        out = F.when(x <= num(x1), value) if out is None else out.when(x <= num(x1), value)
    return out.otherwise(beyond)


def with_edge(df: DataFrame, p, experts: list[str], set_size, n_eff, mu, line, sigma, out: str = "edge") -> DataFrame:
    """Adds the 0-100 composite of six bounded parts.

    Built in three projections (inputs, parts, total): each then compiles to its own small method, where one
    nested expression would be too large for the JIT.
    """
    m = present(experts)
    same = reduce(lambda a, b: a + b, [F.coalesce((pick_over(e) == pick_over(p)).cast("int"), F.lit(0)) for e in experts])
    d = df.withColumns({"_gap": F.abs(c(mu) - c(line)), "_n": c(n_eff), "_s": c(sigma), "_m": m, "_conf": p_pick(p), "_agree": same / F.when(m > 0, m)})
    gap, n, s, agree, conf = F.col("_gap"), F.col("_n"), F.col("_s"), F.col("_agree"), F.col("_conf")
    forecast = piecewise(gap, [(0, 0), (1, 8), (3, 25), (4, 10)], F.greatest(num(0), num(10) - (gap - 4) * 5.0))
    data = (
        F.when(n < 5, num(0)).when(n < 10, (n - 5) / num(5) * 8.0).when(n <= 20, num(20))
        .when(n <= 30, num(20) - (n - 20) / num(10) * 5.0).otherwise(num(15))
    )
    split = (
        F.when(agree <= 0.5, num(25))
        .when(agree <= 0.67, num(25) - (agree - 0.5) / num(0.17) * 10.0)
        .when(agree <= 0.84, num(15) - (agree - 0.67) / num(0.17) * 5.0)
        .otherwise(num(10) - (agree - 0.84) / num(0.16) * 5.0)
    )
    sure = (
        F.when(conf <= 0.55, (conf - 0.50) / num(0.05) * 5.0)
        .when(conf <= 0.65, num(5) + (conf - 0.55) / num(0.10) * 10.0)
        .when(conf <= 0.75, num(15) - (conf - 0.65) / num(0.10) * 10.0)
        .otherwise(F.greatest(num(0), num(5) - (conf - 0.75) / num(0.25) * 5.0))
    )
    spread = piecewise(s, [(0, 0), (2, 4), (6, 10), (8, 6)], F.greatest(num(0), num(6) - (s - 8)))
    d = d.withColumns({
        "_e1": F.when(gap.isNotNull(), forecast).otherwise(num(0)), "_e2": F.when(n.isNotNull(), data).otherwise(num(0)),
        "_e3": F.when(F.col("_m") >= 2, split).otherwise(num(0)), "_e4": sure, "_e5": F.when(s.isNotNull(), spread).otherwise(num(0)),
        "_e6": F.when(c(set_size) == 1, num(5)).otherwise(num(0)),
    })
    total = reduce(lambda a, b: a + b, [F.col(f"_e{i}") for i in range(1, 7)])
    return d.withColumn(out, F.round(clip(total, 0.0, 100.0), 1)).drop("_gap", "_n", "_s", "_m", "_conf", "_agree", *[f"_e{i}" for i in range(1, 7)])


def grade(edge: ColumnOrName) -> Column:
    e = c(edge)
    return (
        F.when(e >= 75, "A+").when(e >= 60, "A").when(e >= 45, "B").when(e >= 30, "C").when(e >= 18, "D")
        .otherwise("F")
    )


def set_size(p: ColumnOrName, q_hat: ColumnOrName) -> Column:
    """How many labels the conformal set keeps: each label whose score is within q-hat."""
    p, q = c(p), c(q_hat)
    return ((num(1) - p) <= q).cast("int") + (p <= q).cast("int")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a1, a2 = F.radians(c(lat1)), F.radians(c(lat2))
    dlat, dlon = a2 - a1, F.radians(c(lon2)) - F.radians(c(lon1))
    h = F.pow(F.sin(dlat / 2), num(2)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dlon / 2), num(2))
    return num(6371.0) * 2.0 * F.atan2(F.sqrt(h), F.sqrt(num(1) - h))


def threshold_for(base: ColumnOrName, set_size_col: ColumnOrName, penalty: Column | None = None) -> Column:
    extra = F.when(c(set_size_col) == 2, penalty if penalty is not None else num(K.CONFORMAL_PENALTY)).otherwise(num(0))
    return clip(F.round(c(base) + extra, 4), 0.5, 0.99)
