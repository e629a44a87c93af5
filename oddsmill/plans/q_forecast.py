"""Forecast expert and distribution calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, num, r6
from oddsmill.operators import asof as A
from oddsmill.operators import calibration as C
from oddsmill.operators import forecast as FC
from oddsmill.operators import history as H
from oddsmill.session import durable, merged

from .adapters import RESOLVED, q_case, q_cdf, q_logit, q_r6, q_sig, q_sum, union_sql
from .q_windows import HIST, STAB, logs, probes
from .registry import query

_w = lambda tau: f"exp(-date_diff('day', game_date, slate) / {tau}e0) * least(mi / 24e0, 1e0)"
WEIGHTS = HIST + f""",
w0 AS (SELECT id, player_id, stat_type, line_score, slate, game_date, v / mi AS r, mi, {_w(7)} AS ws, {_w(21)} AS wl FROM hp WHERE v IS NOT NULL AND mi > 0),
w1 AS (SELECT id, player_id, stat_type, line_score, slate, count(*) AS n, max(game_date) AS last_day, sum(ws * r) / sum(ws) AS rs, sum(wl * r) / sum(wl) AS rl, sum(ws * mi) / sum(ws) AS ms, sum(wl * mi) / sum(wl) AS ml,
  sum(wl) * sum(wl) / sum(wl * wl) AS ne FROM w0 GROUP BY 1, 2, 3, 4, 5),
w2 AS (SELECT w1.*, vr, vm, CAST(greatest(date_diff('day', last_day, w1.slate) - 1, 0) AS DOUBLE) AS rest FROM w1 JOIN (SELECT w0.id, sum(wl * (r - rl) * (r - rl)) / sum(wl) AS vr, sum(wl * (mi - ml) * (mi - ml)) / sum(wl) AS vm FROM w0 JOIN w1 ON w1.id = w0.id GROUP BY 1) z ON z.id = w1.id)"""
PRIORS = """,
pd AS (SELECT stat_type, game_date, sum(minutes) AS sm, count(*) AS cm, sum(CASE WHEN minutes > 0 THEN value / minutes END) AS sr, count(CASE WHEN minutes > 0 THEN 1 END) AS cr FROM lg GROUP BY 1, 2),
pp AS (SELECT d.slate, m.stat_type, (SELECT sum(sm) / sum(cm) FROM pd WHERE pd.stat_type = m.stat_type AND pd.game_date < d.slate) AS lm0, (SELECT sum(sr) / sum(cr) FROM pd WHERE pd.stat_type = m.stat_type AND pd.game_date < d.slate) AS lr0
  FROM (SELECT DISTINCT slate FROM ln) d, (SELECT DISTINCT stat_type FROM ln) m),
lp AS (SELECT slate, stat_type, coalesce(lm0, 28e0) AS lm, coalesce(lr0, 0e0) AS lr FROM pp)"""
_kk = q_case(K.STABILIZATION_GAMES, "w2.stat_type", "10e0")
DIST = WEIGHTS + PRIORS + f""",
f0 AS (SELECT w2.*, (ne * rl + {_kk} * lr) / (ne + {_kk}) AS r0, (ne * ml + 8e0 * lm) / (ne + 8e0) AS m0, CASE WHEN rest = 0 THEN 1e0 ELSE 0e0 END AS b2b FROM w2 JOIN lp ON lp.slate = w2.slate AND lp.stat_type = w2.stat_type WHERE n >= 5),
f1 AS (SELECT *, greatest(0e0, r0 + 5e-1 * (rs - rl)) AS rh, greatest(0e0, m0 + 5e-1 * (ms - ml) - 15e-1 * b2b + 5e-1 * least(rest, 3e0)) AS mh FROM f0),
fd AS (SELECT id, player_id, stat_type, line_score, slate, ne AS n_eff, rh * mh AS mu_hat, sqrt(greatest(mh * mh * (vr + 1e-4) + rh * rh * (vm + 1e0), 1e-6)) AS sigma_hat FROM f1),
bt AS (SELECT fd.*, ln.actual AS y_true FROM fd JOIN ln ON ln.id = fd.id WHERE sigma_hat > 1e-6)"""


@query("fc_weights", f"WITH {WEIGHTS} SELECT id, n AS n_used, {q_r6('rs')} AS rate_short, {q_r6('rl')} AS rate_long, {q_r6('ms')} AS minutes_short, {q_r6('ml')} AS minutes_long, {q_r6('vr')} AS rate_var, {q_r6('vm')} AS minutes_var, {q_r6('ne')} AS n_eff FROM w2")
def fc_weights(t):
    d = FC.decay_stats(logs(t), probes(t)).filter("n_used > 0")
    j = H.attach(probes(t), d).filter("n_used > 0")
    return j.select("id", big("n_used").alias("n_used"), *[r6(c).alias(c) for c in ("rate_short", "rate_long", "minutes_short", "minutes_long", "rate_var", "minutes_var", "n_eff")])


@query("fc_league_priors", f"WITH {HIST}{PRIORS} SELECT stat_type, CAST(slate AS VARCHAR) AS slate, {q_r6('lm')} AS league_minutes, {q_r6('lr')} AS league_rate FROM lp")
def fc_league_priors(t):
    p = FC.league_priors(logs(t), probes(t))
    return p.select("stat_type", F.col("_cut").cast("string").alias("slate"), r6("league_minutes").alias("league_minutes"), r6("league_rate").alias("league_rate"))


def distribution(t):
    """Lines with mu, sigma and effective n; lines without five games drop out."""
    return H.attach(probes(t), FC.distribution(logs(t), probes(t))).filter(F.col("mu_hat").isNotNull())


@query("fc_distribution", f"WITH {DIST} SELECT id, {q_r6('mu_hat')} AS mu_hat, {q_r6('sigma_hat')} AS sigma_hat, {q_r6('n_eff')} AS n_eff FROM fd")
def fc_distribution(t):
    return distribution(t).select("id", *[r6(c).alias(c) for c in ("mu_hat", "sigma_hat", "n_eff")])


_kb = q_case(K.STABILIZATION_GAMES, "stat_type", "10e0")


@query("fc_baseline", f"""WITH {STAB}, b AS (SELECT id, stat_type, line_score, n, wins, mu_stab, hist_std, {_kb} AS k FROM st WHERE n >= 5),
q AS (SELECT *, 1e0 - {q_cdf('((line_score - mu_stab) / greatest(hist_std, 5e-1))')} AS pn, (wins + 1e0) / (n + 2e0) AS pe, least(1e0, n / greatest(1e0, k)) AS w FROM b)
SELECT id, round(mu_stab, 9) AS mean, {q_r6('hist_std')} AS std, {q_r6('pe * w + pn * (1e0 - w)')} AS prob_over FROM q""")
def fc_baseline(t):
    b = FC.baseline(probes(t), logs(t))
    return b.select("id", F.round("mean", 9).alias("mean"), r6("std").alias("std"), r6("prob_over").alias("prob_over"))


# --- backtest set and its calibration -------------------------------------------------------------------------
def backtest(t):
    """Every line with its forecast and true value. Stored once, because fitting and applying both read it."""
    truth = t.lines().select("id", F.col("actual").alias("y_true"))
    return distribution(t).join(merged(truth), "id").filter(F.col("sigma_hat") > 1e-6)


def clock(t):
    return t.base("events").agg(F.to_date(F.max("ts"))).scalar()


@query("lab_backtest_set", f"WITH {DIST} SELECT id, stat_type, CAST(slate AS VARCHAR) AS game_date, y_true, {q_r6('mu_hat')} AS mu_hat, {q_r6('sigma_hat')} AS sigma_hat, {q_r6('n_eff')} AS n_eff FROM bt")
def lab_backtest_set(t):
    return backtest(t).select("id", "stat_type", F.col("slate").cast("string").alias("game_date"), "y_true", *[r6(c).alias(c) for c in ("mu_hat", "sigma_hat", "n_eff")])


MIN_ROWS = 200
_v = "greatest(ks * s + ko + kt * t, 1e-6)"
_mom = {"o": f"w / {_v}", "x": f"w / {_v} * x", "y": f"w / {_v} * y", "xx": f"w / {_v} * x * x", "xy": f"w / {_v} * x * y"}
_mom |= {f"h{p}{q}": f"w / ({_v} * {_v}) * {p} * {q}" for p, q in ("ss", "so", "st", "oo", "ot", "tt")}
_mom |= {f"g{p}": f"w / ({_v} * {_v}) * {p} * (y - a * x - b) * (y - a * x - b)" for p in "sot"}


def _support(*names: str) -> str:
    """A variance fit on these components alone by Cramer's rule, as a struct that sorts by how well it fits; null where it has none."""
    m = [["h" + "".join(sorted(p + q, key="sot".index)) for q in names] for p in names]

    def det(rows):
        if len(rows) == 1:
            return rows[0][0]
        return "(" + " + ".join(f"({'-' if i % 2 else ''}{x}) * {det([r[:i] + r[i + 1:] for r in rows[1:]])}" for i, x in enumerate(rows[0])) + ")"

    whole = det(m)
    x = {n: f"({det([r[:i] + [f'g{p}'] + r[i + 1:] for p, r in zip(names, m)])} / {whole})" for i, n in enumerate(names)}
    ok = " AND ".join([f"{whole} > 1e-12 * {' * '.join(f'h{n}{n}' for n in names)}", *[f"{x[n]} > 0" for n in names]])
    fit = " + ".join(f"{x[n]} * g{n}" for n in names)
    return f"CASE WHEN {ok} THEN {{'fit': {fit}, " + ", ".join(f"'{n}': {x.get(n, '0e0')}" for n in "sot") + "} END"


_best = "list_reverse_sort(list_filter([" + ", ".join(_support(*p) for p in ("s", "o", "t", "so", "st", "ot", "sot")) + "], lambda z: z IS NOT NULL))[1]"
GAUSS = DIST + f""",
ck AS (SELECT CAST(max(ts) AS DATE) AS c FROM events),
g0 AS (SELECT s.scope, bt.*, exp(-greatest(date_diff('day', slate, c), 0) / 30e0) AS w, mu_hat AS x, y_true AS y, sigma_hat * sigma_hat AS s, 1e0 AS o, 1e0 / (n_eff + 1e0) AS t FROM bt, ck, (SELECT unnest([0, 1]) AS g) u, LATERAL (SELECT CASE WHEN g = 0 THEN bt.stat_type ELSE '__global__' END AS scope) s),
g1 AS (SELECT scope, count(*) AS rows FROM g0 GROUP BY 1 HAVING count(*) >= {MIN_ROWS}),
gi AS (SELECT 0 AS r, scope, 1e0 AS a, 0e0 AS b, 1e0 AS ks, 0e0 AS ko, 0e0 AS kt FROM g1
 UNION ALL SELECT r + 1, scope, na, (y - na * x) / o, coalesce(z.s, 0e0), coalesce(z.o, 0e0), coalesce(z.t, 0e0) FROM (SELECT *, CASE WHEN o * xx - x * x > 1e-12 * o * xx THEN (o * xy - x * y) / (o * xx - x * x) ELSE 1e0 END AS na, {_best} AS z FROM (
  SELECT gi.r, gi.scope, {', '.join(f'sum({e}) AS {k}' for k, e in _mom.items())} FROM gi JOIN g0 ON g0.scope = gi.scope WHERE gi.r < 6 GROUP BY 1, 2))),
gp AS (SELECT gi.scope, rows, a, b, sqrt(ks) AS c, sqrt(ko) AS d, kt AS eta FROM gi JOIN g1 ON g1.scope = gi.scope WHERE r = 6)"""


def weighted(t):
    return durable(backtest(t)).withColumn("_clock", clock(t)).withColumn("w", C.recency_weight(F.col("slate"), F.col("_clock"), 30.0)).drop("_clock")


@query("cal_gauss_fit", f"WITH RECURSIVE {GAUSS} SELECT scope, rows, {q_r6('a')} AS a, {q_r6('b')} AS b, {q_r6('c')} AS c, {q_r6('d')} AS d, {q_r6('eta')} AS eta FROM gp")
def cal_gauss_fit(t):
    return C.fit_gaussian(weighted(t), "w", MIN_ROWS).select("scope", "rows", *[r6(c).alias(c) for c in ("a", "b", "c", "d", "eta")])


def q_pit(y, mu, s):
    return f"greatest(0e0, least(1e0, {q_cdf(f'(({y} - ({mu})) / greatest({s}, 1e-6))')}))"


_cal = "(gp.a * mu_hat + gp.b)", "sqrt(gp.c * sigma_hat * gp.c * sigma_hat + gp.d * gp.d + gp.eta / (n_eff + 1e0))"
PITMAP = GAUSS + f""",
u0 AS (SELECT g0.scope, {_cal[0]} AS mu, {_cal[1]} AS sg, y_true FROM g0 JOIN gp ON gp.scope = g0.scope),
u1 AS (SELECT scope, {q_pit('y_true', 'mu', 'sg')} AS u FROM u0),
u2 AS (SELECT scope, u, row_number() OVER (PARTITION BY scope ORDER BY u) - 1 AS i, count(*) OVER (PARTITION BY scope) AS n FROM u1),
kn AS (SELECT u2.scope, j, u AS x, (i + 5e-1) / n AS y FROM u2 JOIN (SELECT unnest(range(0, 512)) AS j) k ON i = (j * (n - 1)) // 511 WHERE n > 512 UNION ALL SELECT scope, i AS j, u, (i + 5e-1) / n FROM u2 WHERE n <= 512)"""


def fitted(t):
    """Backtest rows, parameters per scope and PIT knots per scope."""
    rows = weighted(t)
    params = C.fit_gaussian(rows, "w", MIN_ROWS)
    cal = C.apply_gaussian(C.with_params(C.scoped(rows), params))
    cal = cal.withColumn("u", C.pit(F.col("y_true"), F.col("mu_cal"), F.col("sigma_cal")))
    return rows, params, cal, C.pit_knots(cal, ["scope"], "u")


@query("cal_pit_map", f"WITH RECURSIVE {PITMAP} SELECT scope, j, {q_r6('x')} AS x, {q_r6('y')} AS y FROM kn")
def cal_pit_map(t):
    return fitted(t)[3].select("scope", "j", r6("x").alias("x"), r6("y").alias("y"))


PER_STAT = ["Points", "Rebounds"]
APPLY = PITMAP + f""",
ka AS (SELECT scope, list(x ORDER BY j) AS xs, list(y ORDER BY j) AS ys FROM kn GROUP BY 1),
a0 AS (SELECT bt.*, CASE WHEN stat_type IN ('Points', 'Rebounds') AND stat_type IN (SELECT scope FROM ka) THEN stat_type ELSE '__global__' END AS scope FROM bt),
a1 AS (SELECT a0.id, a0.stat_type, a0.scope, a0.line_score, mu_hat, sigma_hat, {_cal[0]} AS mu, {_cal[1]} AS sg, xs, ys FROM a0 LEFT JOIN gp ON gp.scope = a0.scope LEFT JOIN ka ON ka.scope = a0.scope),
a2 AS (SELECT *, {q_cdf('((line_score + 5e-1 - mu) / sg)')} AS u FROM a1),
a3 AS (SELECT *, len(list_filter(xs, lambda k: k <= u)) AS i FROM a2),
ap AS (SELECT id, stat_type, CASE WHEN xs IS NULL THEN 'raw' WHEN scope = '__global__' THEN 'fallback_global' ELSE 'per_stat' END AS status, 1e0 - {q_cdf('((line_score - mu_hat) / sigma_hat)')} AS p_raw,
  1e0 - CASE WHEN i = 0 THEN 0e0 WHEN i = len(xs) THEN CASE WHEN u = xs[i] THEN ys[i] ELSE 1e0 END ELSE ys[i] + (u - xs[i]) / (xs[i + 1] - xs[i]) * (ys[i + 1] - ys[i]) END AS p_cal FROM a3)"""


def predictions(t):
    rows, params, _, knots = fitted(t)
    j = C.apply_gaussian(C.with_calibrator(rows, params, knots, PER_STAT))
    u = X.normal_cdf((F.col("line_score") + num(0.5) - F.col("mu_cal")) / F.col("sigma_cal"))
    j = j.withColumn("u", u).withColumn("p_cal", num(1) - C.interpolate(F.col("u")))
    return j.withColumn("p_raw", FC.raw_probability(F.col("line_score"), F.col("mu_hat"), F.col("sigma_hat")))


@query("cal_pit_apply", f"WITH RECURSIVE {APPLY} SELECT id, status, {q_r6('p_cal')} AS p_over FROM ap WHERE status <> 'raw'")
def cal_pit_apply(t):
    return predictions(t).filter("status <> 'raw'").select("id", "status", r6("p_cal").alias("p_over"))


@query("fc_predict", f"WITH RECURSIVE {APPLY} SELECT id, status, {q_r6('p_raw')} AS prob_over_raw, {q_r6('coalesce(p_cal, p_raw)')} AS prob_over, CASE WHEN coalesce(p_cal, p_raw) >= 5e-1 THEN 'OVER' ELSE 'UNDER' END AS pick FROM ap")
def fc_predict(t):
    p = F.coalesce("p_cal", "p_raw")
    return predictions(t).select("id", "status", r6("p_raw").alias("prob_over_raw"), r6(p).alias("prob_over"), F.when(p >= 0.5, "OVER").otherwise("UNDER").alias("pick"))


@query("fc_status_summary", f"""WITH RECURSIVE {APPLY} SELECT status, count(*) AS n, string_agg(DISTINCT stat_type, ',' ORDER BY stat_type) AS stats FROM ap GROUP BY 1
 UNION ALL SELECT 'skipped', (SELECT count(*) FROM ln) - (SELECT count(*) FROM bt), NULL""")
def fc_status_summary(t):
    p = predictions(t).select("id", "status", "stat_type")
    done = durable(p.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("stat_type")), ",").alias("stats")))
    total = t.lines().agg(F.count(F.lit(1))).scalar()
    skipped = done.agg((total - F.coalesce(F.sum("n"), F.lit(0))).alias("n")).select(F.lit("skipped").alias("status"), "n", F.lit(None).cast("string").alias("stats"))
    return done.unionByName(skipped)


def q_eval(mu, s, tag):
    z = f"((y_true - {mu}) / greatest({s}, 1e-6))"
    pdf = f"(exp(-{z} * {z} / 2e0) / sqrt(2e0 * pi()))"
    return f"""{q_r6(f'avg(ln(greatest({s}, 1e-6)) + 5e-1 * {z} * {z})')} AS nll_{tag}, {q_r6(f'avg(greatest({s}, 1e-6) * ({z} * (2e0 * {q_cdf(z)} - 1e0) + 2e0 * {pdf} - 1e0 / sqrt(pi())))')} AS crps_{tag},
  {', '.join(f"{q_r6(f'avg(CASE WHEN abs(y_true - {mu}) <= {q}e0 * {s} THEN 1e0 ELSE 0e0 END)')} AS {k}_{tag}" for k, q in [('cov50', '0.67448975'), ('cov80', '1.28155157'), ('cov90', '1.64485363')])}"""


def q_ks(mu, s, tag):
    return f"""SELECT scope, {q_r6('max(abs(i / CAST(n AS DOUBLE) - u))')} AS pit_ks_{tag} FROM (SELECT scope, u, row_number() OVER (PARTITION BY scope ORDER BY u) AS i, count(*) OVER (PARTITION BY scope) AS n FROM (SELECT scope, {q_pit('y_true', mu, s)} AS u FROM ev)) GROUP BY 1"""


@query("cal_dist_eval", f"""WITH RECURSIVE {GAUSS}, ev AS (SELECT g0.scope, y_true, mu_hat, sigma_hat, {_cal[0]} AS mu, {_cal[1]} AS sg FROM g0 JOIN gp ON gp.scope = g0.scope),
e1 AS (SELECT scope, count(*) AS n, {q_eval('mu_hat', 'sigma_hat', 'before')}, {q_eval('mu', 'sg', 'after')} FROM ev GROUP BY 1), k1 AS ({q_ks('mu_hat', 'sigma_hat', 'before')}), k2 AS ({q_ks('mu', 'sg', 'after')})
SELECT e1.*, pit_ks_before, pit_ks_after FROM e1 JOIN k1 ON k1.scope = e1.scope JOIN k2 ON k2.scope = e1.scope""")
def cal_dist_eval(t):
    cal = fitted(t)[2]
    a = C.evaluate(cal, ["scope"], "mu_hat", "sigma_hat", "before")
    return a.join(C.evaluate(cal, ["scope"], "mu_cal", "sigma_cal", "after").drop("n"), "scope")


_decay = "exp(-greatest(date_diff('day', slate, c), 0) / 30e0)"


@query("cal_time_windows", f"""WITH {DIST}, ck AS (SELECT CAST(max(ts) AS DATE) AS c FROM events), z AS (SELECT slate, stat_type, c, CASE WHEN slate >= c - 7 AND slate < c THEN 'validation' WHEN slate >= c - 9 AND slate < c - 7 THEN 'gap' WHEN slate >= c - 23 AND slate < c - 9 THEN 'train' ELSE 'outside' END AS part FROM ln, ck)
SELECT stat_type, part, count(*) AS n, {q_r6(f'sum({_decay})')} AS weight FROM z GROUP BY 1, 2""")
def cal_time_windows(t):
    z = t.lines().select("stat_type", "slate").withColumn("c", clock(t))
    back = lambda n: F.date_sub("c", n)
    inside = lambda a, b: (F.col("slate") >= back(a)) & (F.col("slate") < back(b))
    part = F.when(inside(7, 0), "validation").when(inside(9, 7), "gap").when(inside(23, 9), "train").otherwise("outside")
    return z.groupBy("stat_type", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum(C.recency_weight(F.col("slate"), F.col("c"), 30.0))).alias("weight"))
