"""Priors, conformal sets, monotone maps and expert combination over resolved predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, num, r6
from oddsmill.operators import attribution as AT
from oddsmill.operators import calibration as C
from oddsmill.operators import ensemble as E
from oddsmill.operators import history as H
from oddsmill.operators import labels as L
from oddsmill.operators import reports as R
from oddsmill.operators.distribution import rank_auc
from oddsmill.session import durable, merged

from .adapters import LINES, PREDICTIONS, RESOLVED, q_hit, q_logit, q_logit_mean, q_loss, q_pick, q_r6, q_sig, q_sum, union_sql
from .q_windows import logs
from .registry import query

ORDER = ["decision_time", "id"]
EX = K.EXPERTS
q_clip = lambda e: f"(CASE WHEN {e} IS NOT NULL THEN greatest(25e-2, least(75e-2, {e})) END)"
CLIPPED = [q_clip(e) for e in EX]

# --- context priors ------------------------------------------------------------------------------------------
def sql_priors(src: str) -> str:
    return f"""q0 AS (SELECT stat_type, count(*) AS n, count(line_score) AS nl, avg(CAST(over_label AS DOUBLE)) AS m, round(quantile_cont(line_score, 0.3333333333333333), 2) AS e1, round(quantile_cont(line_score, 0.6666666666666666), 2) AS e2 FROM {src} GROUP BY 1),
q1 AS (SELECT q0.*, (SELECT round(avg(CAST(over_label AS DOUBLE)), 4) FROM {src}) AS global_prior FROM q0),
q2 AS (SELECT *, CASE WHEN n >= 30 THEN round(m, 4) ELSE global_prior END AS stat_prior, nl >= 90 AS has FROM q1),
q3 AS (SELECT q2.stat_type, CASE WHEN line_score <= e1 THEN 0 WHEN e1 <> e2 AND line_score <= e2 THEN 1 WHEN e1 = e2 THEN 1 ELSE 2 END AS b, count(*) AS c, round(avg(CAST(over_label AS DOUBLE)), 4) AS r FROM {src} s JOIN q2 ON q2.stat_type = s.stat_type WHERE has GROUP BY 1, 2),
cp AS (SELECT q2.stat_type, n, global_prior, stat_prior, CASE WHEN has THEN e1 END AS e1, CASE WHEN has THEN e2 END AS e2,
  {', '.join(f"CASE WHEN has THEN coalesce((SELECT r FROM q3 WHERE q3.stat_type = q2.stat_type AND b = {i} AND c >= 30), stat_prior) ELSE stat_prior END AS bucket{i}" for i in range(3))} FROM q2)"""


def sql_priors_as_of(src: str) -> str:
    """``cp`` by (stat_type, slate): the same fit on the rows of strictly earlier slates."""
    return f"""ct AS (SELECT DISTINCT stat_type, slate FROM {src}), cg AS (SELECT c.slate, round(avg(CAST(over_label AS DOUBLE)), 4) AS global_prior FROM (SELECT DISTINCT slate FROM ct) c LEFT JOIN {src} s ON s.slate < c.slate GROUP BY 1),
q0 AS (SELECT c.stat_type, c.slate, count(over_label) AS n, count(line_score) AS nl, avg(CAST(over_label AS DOUBLE)) AS m, round(quantile_cont(line_score, 0.3333333333333333), 2) AS e1, round(quantile_cont(line_score, 0.6666666666666666), 2) AS e2 FROM ct c LEFT JOIN {src} s ON s.stat_type = c.stat_type AND s.slate < c.slate GROUP BY 1, 2),
q2 AS (SELECT q0.*, global_prior, CASE WHEN n >= 30 THEN round(m, 4) ELSE global_prior END AS stat_prior, nl >= 90 AS has FROM q0 JOIN cg ON cg.slate = q0.slate),
q3 AS (SELECT q2.stat_type, q2.slate, CASE WHEN line_score <= e1 THEN 0 WHEN e1 <> e2 AND line_score <= e2 THEN 1 WHEN e1 = e2 THEN 1 ELSE 2 END AS b, count(*) AS c, round(avg(CAST(over_label AS DOUBLE)), 4) AS r FROM {src} s JOIN q2 ON q2.stat_type = s.stat_type AND s.slate < q2.slate WHERE has GROUP BY 1, 2, 3),
cp AS (SELECT q2.stat_type, q2.slate, n, global_prior, stat_prior, CASE WHEN has THEN e1 END AS e1, CASE WHEN has THEN e2 END AS e2,
  {', '.join(f"CASE WHEN has THEN coalesce((SELECT r FROM q3 WHERE q3.stat_type = q2.stat_type AND q3.slate = q2.slate AND b = {i} AND c >= 30), stat_prior) ELSE stat_prior END AS bucket{i}" for i in range(3))} FROM q2)"""


def sql_prior_of(alias: str, fallback: str = "(SELECT max(global_prior) FROM cp)") -> str:
    b = "CASE WHEN line_score <= e1 THEN bucket0 WHEN e1 <> e2 AND line_score <= e2 THEN bucket1 WHEN e1 = e2 THEN bucket1 ELSE bucket2 END"
    raw = f"coalesce(CASE WHEN e1 IS NOT NULL AND line_score IS NOT NULL THEN {b} END, stat_prior, {fallback}, 5e-1)"
    return f"greatest(42e-2, least(58e-2, {raw} + 6e-1 * (5e-1 - {raw})))"


@query("cal_context_fit", f"WITH {RESOLVED}, {sql_priors('rs')} SELECT stat_type, n, {', '.join(f'{q_r6(c)} AS {c}' for c in ('global_prior', 'stat_prior', 'e1', 'e2', 'bucket0', 'bucket1', 'bucket2'))} FROM cp")
def cal_context_fit(t):
    p = C.fit_context_priors(t.resolved())
    return p.select("stat_type", "n", *[r6(c).alias(c) for c in ("global_prior", "stat_prior", "e1", "e2", "bucket0", "bucket1", "bucket2")])


@query("cal_context_lookup", f"WITH {RESOLVED}, {sql_priors('rs')} SELECT id, {q_r6(sql_prior_of('x'))} AS context_prior FROM pr LEFT JOIN cp ON cp.stat_type = pr.stat_type")
def cal_context_lookup(t):
    out = C.context_prior(t.predictions().select("id", "stat_type", "line_score"), C.fit_context_priors(t.resolved()))
    return out.select("id", r6("context_prior").alias("context_prior"))


LINE_LABELS = LINES + ", la AS (SELECT id, player_id, stat_type, slate, line_score, CASE WHEN actual > line_score THEN 1 ELSE 0 END AS over_label FROM ln)"


@query("cal_context_as_of", f"WITH {LINE_LABELS}, {sql_priors_as_of('la')} SELECT stat_type, CAST(slate AS VARCHAR) AS slate, n, {', '.join(f'{q_r6(c)} AS {c}' for c in ('global_prior', 'stat_prior', 'e1', 'e2', 'bucket0', 'bucket1', 'bucket2'))} FROM cp")
def cal_context_as_of(t):
    """The priors that each slate may know: fitted on earlier slates only."""
    lines = t.lines().select("stat_type", "slate", "line_score", (F.col("actual") > F.col("line_score")).cast("int").alias("over_label"))
    p = C.priors_as_of(lines, lines)
    return p.select("stat_type", F.col("slate").cast("string").alias("slate"), "n", *[r6(c).alias(c) for c in ("global_prior", "stat_prior", "e1", "e2", "bucket0", "bucket1", "bucket2")])


# --- conformal -----------------------------------------------------------------------------------------------
XL = union_sql([f"SELECT id, over_label, '{e}' AS expert, {e} AS p FROM rs WHERE {e} IS NOT NULL" for e in EX])
QHAT = RESOLVED + f""", xl AS ({XL}), sc AS (SELECT expert, CASE WHEN over_label = 1 THEN 1e0 - p ELSE p END AS s FROM xl), so AS (SELECT expert, s, row_number() OVER (PARTITION BY expert ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY expert) AS n FROM sc),
sh AS (SELECT *, (n - 1) * least(1e0, (1e0 - 1e-1) * (1e0 + 1e0 / n)) AS h FROM so),
qh AS (SELECT expert, max(n) AS n, max(CASE WHEN i = floor(h) THEN s END) + (max(CASE WHEN i = ceil(h) THEN s END) - max(CASE WHEN i = floor(h) THEN s END)) * max(h - floor(h)) AS q_hat FROM sh GROUP BY 1)"""


@query("cal_conformal_fit", f"WITH {QHAT} SELECT expert, n, {q_r6('q_hat')} AS q_hat FROM qh")
def cal_conformal_fit(t):
    q = C.fit_conformal(R.unpivot(t.resolved(), EX, ["over_label"]))
    return q.select("expert", "n", r6("q_hat").alias("q_hat"))


_one = lambda e: f"(CASE WHEN {e} IS NOT NULL AND (CASE WHEN 1e0 - {e} <= (SELECT q_hat FROM qh WHERE expert = '{e}') THEN 1 ELSE 0 END + CASE WHEN {e} <= (SELECT q_hat FROM qh WHERE expert = '{e}') THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END)"
_have = q_sum([f"CASE WHEN {e} IS NULL THEN 0 ELSE 1 END" for e in EX])
SQL_SIZE = f"(CASE WHEN {_have} > 0 THEN CASE WHEN {q_sum([_one(e) for e in EX])} > {_have} / 2e0 THEN 1 ELSE 2 END END)"


@query("cal_conformal_apply", f"""WITH {QHAT}, lr AS (SELECT q_hat AS q FROM qh WHERE expert = 'p_lr') SELECT id, {SQL_SIZE} AS set_size, CASE WHEN 1e0 - p_lr <= q THEN 1 ELSE 0 END + CASE WHEN p_lr <= q THEN 1 ELSE 0 END AS lr_size,
 {q_pick('p_lr')} AS lr_p_value, CASE WHEN p_lr >= 5e-1 THEN 1e0 - p_lr <= q AND NOT p_lr <= q ELSE p_lr <= q AND NOT 1e0 - p_lr <= q END AS lr_confident FROM pr, lr""")
def cal_conformal_apply(t):
    q = C.fit_conformal(R.unpivot(t.resolved(), EX, ["over_label"]))
    out = C.majority_set_size(t.predictions(), EX, q).withColumn("q", q.filter("expert = 'p_lr'").select("q_hat").scalar())
    p, over, under = F.col("p_lr"), (num(1) - F.col("p_lr")) <= F.col("q"), F.col("p_lr") <= F.col("q")
    return out.select("id", "set_size", X.set_size("p_lr", "q").alias("lr_size"), X.p_pick(p).alias("lr_p_value"),
                      F.when(p >= 0.5, over & ~under).otherwise(under & ~over).alias("lr_confident"))


TEMPS = ", ".join(f"({g}e0)" for g in C.temperature_grid())
_tp = q_sig(f"{q_logit('p_nn')} / tv")


@query("cal_temperature", f"""WITH {RESOLVED}, g(tv) AS (VALUES {TEMPS}), z AS (SELECT tv, over_label AS y, {_tp} AS q FROM rs, g), l AS (SELECT tv AS temperature, avg(-(y * ln(q + 1e-6) + (1 - y) * ln(1e0 - q + 1e-6))) AS nll FROM z GROUP BY 1)
SELECT temperature, {q_r6('nll')} AS nll, row_number() OVER (ORDER BY nll, temperature) = 1 AS is_best FROM l""")
def cal_temperature(t):
    return C.temperature_curve(t.resolved()).withColumn("nll", r6("nll"))


# --- isotonic --------------------------------------------------------------------------------------------------
def sql_isotonic(rows: str) -> str:
    """Value of each cell by the min-max formula: the largest over all starts of the smallest mean over all ends."""
    return f"""i0 AS (SELECT s.scope, p AS x, count(*) AS w, sum(y) AS s FROM (SELECT stat_type AS scope, p, y FROM ({rows}) UNION ALL SELECT '__global__', p, y FROM ({rows})) s GROUP BY 1, 2),
i1 AS (SELECT scope, x, row_number() OVER o AS i, sum(w) OVER o AS cw, sum(s) OVER o AS cs, w, s, sum(w) OVER (PARTITION BY scope) AS n, sum(s) OVER (PARTITION BY scope) AS ones FROM i0 WINDOW o AS (PARTITION BY scope ORDER BY x)),
i2 AS (SELECT * FROM i1 WHERE n >= 100 AND (scope = '__global__' OR (ones > 0 AND ones < n))),
i3 AS (SELECT a.scope, a.i AS j, b.i, min((b.cs - a.cs + a.s) / CAST(b.cw - a.cw + a.w AS DOUBLE)) OVER (PARTITION BY a.scope, a.i ORDER BY b.i DESC) AS v FROM i2 a JOIN i2 b ON b.scope = a.scope AND b.i >= a.i),
i4 AS (SELECT scope, i, max(v) AS v FROM i3 GROUP BY 1, 2), i5 AS (SELECT scope, i2.i, x, n, greatest(1e-2, least(99e-2, v)) AS v, v AS raw FROM i4 JOIN i2 USING (scope, i)),
iv AS (SELECT *, lead(x) OVER o AS nx, lead(v) OVER o AS nv, first_value(v) OVER o AS v0 FROM i5 WINDOW o AS (PARTITION BY scope ORDER BY x)),
ib AS (SELECT scope, raw, max(n) AS n, CASE WHEN min(x) < max(x) THEN 2 ELSE 1 END AS ends FROM i5 GROUP BY 1, 2),
iz AS (SELECT scope, CAST(max(n) AS BIGINT) AS n, CAST(sum(ends) AS BIGINT) AS knots FROM ib GROUP BY 1), iq(u) AS (VALUES {', '.join(f'({v}e0)' for v in C.SHAPE_AT)}),
ip AS (SELECT z.scope, u, {q_isotonic('u')} AS v FROM (SELECT iz.scope, u FROM iz, iq) z ASOF LEFT JOIN iv ON iv.scope = z.scope AND z.u >= iv.x),
ir AS (SELECT scope, CAST(count(DISTINCT round(v, 6)) AS INTEGER) AS unique_outputs, max(v) - min(v) AS output_range, max(CASE WHEN u IN ({', '.join(f'{v}e0' for v in C.MIDBAND)}) THEN abs(v - u) END) AS max_midband_shift FROM ip GROUP BY 1),
im AS (SELECT iz.*, unique_outputs, output_range, max_midband_shift, CASE WHEN scope = '__global__' THEN NULL WHEN unique_outputs < 4 THEN 'degenerate_low_unique_outputs' WHEN output_range < 4e-2 THEN 'degenerate_low_output_range' WHEN max_midband_shift > 12e-2 THEN 'degenerate_excessive_midband_shift' END AS reason FROM iz JOIN ir USING (scope))"""


def q_isotonic(u: str, scope: str = "z.scope") -> str:
    """The map at ``u``; ``iv`` is joined as of it."""
    return f"CASE WHEN iv.x IS NULL THEN (SELECT min(v) FROM iv k WHERE k.scope = {scope}) WHEN iv.nx IS NULL THEN iv.v ELSE iv.v + ({u} - iv.x) / (iv.nx - iv.x) * (iv.nv - iv.v) END"


_barred = "stat_type NOT IN (" + ", ".join(f"'{s}'" for s in K.CALIBRATION_EXCLUDED_STATS) + ")"
ISO = f"{RESOLVED}, {sql_isotonic(f'SELECT stat_type, p_final AS p, over_label AS y FROM rs WHERE p_final IS NOT NULL AND over_label IS NOT NULL AND {_barred}')}"


@query("cal_isotonic_fit", f"WITH {ISO} SELECT scope, n, knots, unique_outputs, {q_r6('output_range')} AS output_range, {q_r6('max_midband_shift')} AS max_midband_shift, reason FROM im")
def cal_isotonic_fit(t):
    shapes = C.isotonic_shapes(C.fit_isotonic(t.resolved(), "p_final", "over_label"))
    return shapes.select("scope", "n", "knots", "unique_outputs", r6("output_range").alias("output_range"), r6("max_midband_shift").alias("max_midband_shift"), "reason")


@query("cal_isotonic_apply", f"""WITH {ISO}, z AS (SELECT id, p_final, own.scope IS NOT NULL AND own.reason IS NULL AS good, own.reason AS why, CASE WHEN own.scope IS NOT NULL AND own.reason IS NULL THEN stat_type ELSE (SELECT scope FROM im WHERE scope = '__global__') END AS scope FROM pr LEFT JOIN im own ON own.scope = pr.stat_type)
SELECT id, {q_r6(f"coalesce(greatest(1e-2, least(99e-2, {q_isotonic('z.p_final')})), z.p_final)")} AS p_calibrated, CASE WHEN good THEN 'per_stat' WHEN z.scope IS NOT NULL THEN 'global' ELSE 'identity' END AS calibrator_source,
 CASE WHEN good THEN 'active' WHEN why IS NOT NULL THEN CASE WHEN z.scope IS NOT NULL THEN 'degenerate_fallback' ELSE 'degenerate_identity' END WHEN z.scope IS NOT NULL THEN 'fallback_global' ELSE 'none' END AS calibrator_mode
FROM z ASOF LEFT JOIN iv ON iv.scope = z.scope AND z.p_final >= iv.x""")
def cal_isotonic_apply(t):
    blocks = C.fit_isotonic(t.resolved(), "p_final", "over_label")
    return C.apply_isotonic(t.predictions().select("id", "stat_type", "p_final"), blocks, "p_final").select("id", r6("p_calibrated").alias("p_calibrated"), "calibrator_source", "calibrator_mode")


# --- Platt -----------------------------------------------------------------------------------------------------
def sql_platt(rows: str, p: str) -> str:
    """Newton's steps as a recursion: ``nw`` ends with the slope and intercept."""
    m = q_sig("a * z + b")
    return f"""nz AS (SELECT {q_logit(p)} AS z, CAST(over_label AS DOUBLE) AS y FROM {rows} WHERE {p} IS NOT NULL AND over_label IS NOT NULL),
nt(k, a, b) AS (SELECT 0, 1e0, 0e0 UNION ALL SELECT k + 1, a + CASE WHEN h0 * h2 - h1 * h1 > {C.PLATT_CURVATURE} THEN (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) ELSE 0e0 END, b + CASE WHEN h0 * h2 - h1 * h1 > {C.PLATT_CURVATURE} THEN (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) ELSE 0e0 END
 FROM (SELECT k, a, b, sum(y - m) AS g0, sum((y - m) * z) AS g1, sum(m * (1e0 - m)) AS h0, sum(m * (1e0 - m) * z) AS h1, sum(m * (1e0 - m) * z * z) AS h2 FROM (SELECT k, a, b, z, y, {m} AS m FROM nt, nz WHERE k < 25) GROUP BY k, a, b)),
nw AS (SELECT a, b FROM nt WHERE k = 25)"""


def q_platt(p: str) -> str:
    return f"greatest(1e-2, least(99e-2, {q_sig(f'(SELECT a FROM nw) * {q_logit(p)} + (SELECT b FROM nw)')}))"


@query("cal_platt", f"WITH RECURSIVE {RESOLVED}, {sql_platt('rs', 'p_lr')} SELECT id, {q_r6(q_platt('p_lr'))} AS p_platt FROM pr")
def cal_platt(t):
    a, b = C.fit_platt(t.resolved(), "p_lr", "over_label")
    return t.predictions().select("id", r6(C.platt(F.col("p_lr"), a, b)).alias("p_platt"))


_lr = f"SELECT 'all' AS stat_type, p_lr AS p, over_label AS y FROM rs WHERE p_lr IS NOT NULL AND over_label IS NOT NULL"


@query("cal_best", f"""WITH RECURSIVE {RESOLVED}, {sql_isotonic(_lr)}, {sql_platt('rs', 'p_lr')}, z AS (SELECT p_lr, over_label, CASE WHEN own.scope IS NOT NULL AND own.reason IS NULL THEN own.scope ELSE (SELECT scope FROM im WHERE scope = '__global__') END AS scope FROM rs LEFT JOIN im own ON own.scope = 'all'),
e AS (SELECT power(coalesce(greatest(1e-2, least(99e-2, {q_isotonic('z.p_lr')})), z.p_lr) - over_label, 2) AS iso, power({q_platt('z.p_lr')} - over_label, 2) AS pl FROM z ASOF LEFT JOIN iv ON iv.scope = z.scope AND z.p_lr >= iv.x)
SELECT count(*) AS n, {q_r6('avg(iso)')} AS brier_isotonic, {q_r6('avg(pl)')} AS brier_platt, CASE WHEN avg(iso) < avg(pl) - 5e-3 THEN 'isotonic' ELSE 'platt' END AS chosen FROM e""")
def cal_best(t):
    """Brier score of both calibrators; the monotone map must win by 0.005."""
    rows = t.resolved().select("id", F.lit("all").alias("stat_type"), "p_lr", "over_label")
    a, b = C.fit_platt(rows, "p_lr", "over_label")
    both = C.apply_isotonic(rows, C.fit_isotonic(rows, "p_lr", "over_label"), "p_lr").withColumn("p_platt", C.platt(F.col("p_lr"), a, b))
    err = lambda c: F.avg(F.pow(F.col(c) - F.col("over_label"), num(2)))
    out = both.agg(F.count(F.lit(1)).alias("n"), err("p_calibrated").alias("brier_isotonic"), err("p_platt").alias("brier_platt"))
    return out.select("n", r6("brier_isotonic").alias("brier_isotonic"), r6("brier_platt").alias("brier_platt"),
                      F.when(F.col("brier_isotonic") < F.col("brier_platt") - 0.005, "isotonic").otherwise("platt").alias("chosen"))


# --- pools -------------------------------------------------------------------------------------------------------
@query("ens_logit_avg", f"WITH {PREDICTIONS} SELECT id, {q_r6(q_logit_mean(CLIPPED))} AS p FROM pr")
def ens_logit_avg(t):
    return t.predictions().select("id", r6(E.logit_average(EX)).alias("p"))


Q_CTX = "stat_type || '|pregame|' || CASE WHEN n_eff IS NULL THEN 'neff_unknown' WHEN n_eff < 5 THEN 'neff_lt5' WHEN n_eff < 15 THEN 'neff_5_15' ELSE 'neff_ge15' END"


def q_pool(cols, weights, eps="1e-6"):
    tot = q_sum([f"CASE WHEN {c} IS NULL THEN 0e0 ELSE {w} * {q_logit(c, eps)} END" for c, w in zip(cols, weights)])
    mass = q_sum([f"CASE WHEN {c} IS NULL THEN 0e0 ELSE {w} END" for c, w in zip(cols, weights)])
    return f"(CASE WHEN {mass} > {eps} THEN {q_sig(f'{tot} / {mass}')} ELSE 5e-1 END)"


_wsum = ", ".join(f"avg({q_hit(e, 'over_label')}) AS w_{e}" for e in EX)


@query("ens_weighted_pool", f"""WITH {RESOLVED}, cx AS (SELECT *, {Q_CTX} AS ctx FROM rs), cw AS (SELECT ctx, {_wsum} FROM cx GROUP BY 1 HAVING count(*) >= 400), gw AS (SELECT {', '.join(f'avg({q_hit(e, "over_label")}) AS g_{e}' for e in EX)} FROM rs)
SELECT id, {q_r6(q_pool(EX, [f"CASE WHEN cw.ctx IS NOT NULL THEN coalesce(w_{e}, 0e0) ELSE g_{e} END" for e in EX]))} AS p FROM cx CROSS JOIN gw LEFT JOIN cw ON cw.ctx = cx.ctx""")
def ens_weighted_pool(t):
    rows = E.context(t.resolved())
    return E.context_pool(rows, EX, E.accuracy_weights(rows, ["ctx"], EX, 400), E.accuracy_weights(rows, [], EX)).select("id", r6("p_pool").alias("p"))


@query("ens_thompson", f"""WITH {RESOLVED}, l AS ({union_sql([f"SELECT stat_type || '|pregame|' || CASE WHEN n_eff >= 15 THEN 'high' ELSE 'low' END AS ctx, '{e}' AS expert, {q_hit(e, 'over_label')} AS h FROM rs" for e in EX])}),
b AS (SELECT ctx, expert, 1e0 + coalesce(sum(h), 0) AS alpha, 1e0 + coalesce(sum(1e0 - h), 0) AS beta FROM l GROUP BY 1, 2), m AS (SELECT *, CASE WHEN expert = 'p_nn' THEN least(alpha / (alpha + beta), 2e-1) ELSE alpha / (alpha + beta) END AS m FROM b)
SELECT ctx, expert, alpha, beta, {q_r6('m / sum(m) OVER (PARTITION BY ctx)')} AS weight FROM m""")
def ens_thompson(t):
    return E.thompson(t.resolved(), EX, {"p_nn": 0.20}).withColumn("weight", r6("weight"))


def sql_hedge(at: str) -> str:
    """The learner row by row: ``hz(ctx, n, id, pred, w)`` from n = 1 on. ``at`` is the count that its step size decays with."""
    held = lambda x: f"list_transform({x}, lambda v: least({K.WEIGHT_CAP}e0, greatest({K.WEIGHT_FLOOR}e0, v)))"
    even = lambda x: f"list_transform({x}, lambda v: v / list_sum({x}))"
    p = f"greatest({E.EPS:.0e}, least(1e0 - {E.EPS:.0e}, z[2]))"
    mass = "list_sum(list_transform(list_zip(k, p), lambda z: CASE WHEN z[2] IS NULL THEN 0e0 ELSE z[1] END))"
    lean = f"list_sum(list_transform(list_zip(k, p), lambda z: CASE WHEN z[2] IS NULL THEN 0e0 ELSE z[1] / (mass + 1e-12) * ln({p} / (1e0 - {p})) END))"
    mixed = f"z[1] * {1 - K.HEDGE_SHRINK} + {K.HEDGE_SHRINK / len(EX)!r}"
    moved = f"list_transform(list_zip(k, p), lambda z: ({mixed}) * CASE WHEN z[2] IS NULL THEN 1e0 ELSE exp(eta * ln(CASE WHEN y = 1 THEN {p} ELSE 1e0 - {p} END)) END)"
    return f"""hr AS (SELECT id, {Q_CTX} AS ctx, over_label AS y, row_number() OVER (PARTITION BY {Q_CTX} ORDER BY decision_time, id) AS pos, row_number() OVER (ORDER BY decision_time, id) AS step, [{', '.join(f'CAST({e} AS DOUBLE)' for e in EX)}] AS p FROM rs),
hz(ctx, n, id, pred, w) AS (SELECT DISTINCT ctx, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST({E.initial_weights(EX)!r} AS DOUBLE[]) FROM hr UNION ALL
 SELECT ctx, n + 1, id, pred, {even('h')} FROM (SELECT ctx, n, id, pred, {held('v')} AS h FROM (SELECT ctx, n, id, CASE WHEN mass > 0 THEN {q_sig(lean)} ELSE 5e-1 END AS pred, {even('u')} AS v FROM (
  SELECT *, {moved} AS u, {mass} AS mass FROM (SELECT *, {even('k0')} AS k FROM (SELECT hz.ctx, n, hr.id, y, p, {K.ETA} / (1e0 + {K.ETA_DECAY} * ({at})) AS eta, {held('w')} AS k0 FROM hz JOIN hr ON hr.ctx = hz.ctx AND hr.pos = hz.n + 1)))))) """


@query("ens_hedge", f"WITH RECURSIVE {RESOLVED}, {sql_hedge('step')} SELECT id, ctx, {q_r6('pred')} AS p_hedge, {', '.join(f'{q_r6(f"w[{i + 1}]")} AS w_{e}' for i, e in enumerate(EX))} FROM hz WHERE n > 0")
def ens_hedge(t):
    h = E.hedge(t.resolved(), EX, ORDER)
    return h.select("id", "ctx", r6("p_hedge").alias("p_hedge"), *[r6(f"w_{e}").alias(f"w_{e}") for e in EX])


_z = [f"coalesce({e}, 5e-1)" for e in EX]


@query("ens_gating_feats", f"""WITH {PREDICTIONS} SELECT id, {q_r6(q_sum([f'CASE WHEN {z} >= 5e-1 THEN 1e0 ELSE 0e0 END' for z in _z]) + ' / 6e0')} AS agreement, {q_r6(f"greatest({', '.join(_z)}) - least({', '.join(_z)})")} AS spread,
 round({q_sum([f'abs({z} - 5e-1)' for z in _z])} / 6e0, 9) AS mean_confidence, {q_r6('ln(1e0 + n_eff)')} AS log_n_eff FROM pr""")
def ens_gating_feats(t):
    f = E.gating_features(EX)
    return t.predictions().select("id", *[F.round(v, 9 if k == "mean_confidence" else 6).alias(k) for k, v in f.items()])


@query("ens_gating_fit")
def ens_gating_fit(t):
    rows, _ = E.gating_fit(durable(t.resolved().select("id", "over_label", "n_eff", *EX)), EX)
    return rows.select("id", *[r6(f"g_{e}").alias(f"g_{e}") for e in EX])


@query("ens_stacking")
def ens_stacking(t):
    """Logistic regression on expert logits; a missing expert is logit 0."""
    names = [f"z_{e}" for e in EX]
    rows = t.resolved().select("id", "over_label", *[F.coalesce(X.logit(e), num(0)).alias(f"z_{e}") for e in EX])
    w, b = E.fit_logistic(rows, names, "over_label", 0.1)
    return rows.select("id", r6(E.logistic(names, w, b)).alias("p_stack"))


@query("ens_meta")
def ens_meta(t):
    """Scaled logistic regression on the first 80 % in time, scored on the last 20 %."""
    feats = [*EX, "n_eff_log"]
    base = t.resolved().select(*ORDER, "over_label", *[F.coalesce(F.col(e), num(0.5)).alias(e) for e in EX], F.log1p("n_eff").alias("n_eff_log"))
    seq = L.positions(base, ORDER).withColumn("part", L.holdout(0.2))
    w, b = E.fit_logistic(seq.filter("part = 'train'"), feats, "over_label", 1.0, scale=True)
    return seq.filter("part = 'test'").select("id", r6(E.logistic(feats, w, b)).alias("p_meta"))


@query("ens_hybrid", f"WITH {PREDICTIONS} SELECT id, {q_r6(q_pool(['p_lr', 'p_xgb', 'p_tabdl'], ['34e-2', '33e-2', '33e-2']))} AS p FROM pr")
def ens_hybrid(t):
    return t.predictions().select("id", r6(E.hybrid({"thompson": ("p_lr", 0.34), "gating": ("p_xgb", 0.33), "meta": ("p_tabdl", 0.33)})).alias("p"))


GRID = ", ".join(f"({a}e0, {b}e0, {g!r}e0)" if "e" not in repr(g) else f"({a}e0, {b}e0, {g!r})" for a, b, g in E.mix_grid())


@query("ens_mix_grid", f"""WITH {RESOLVED}, g(a, b, g) AS (VALUES {GRID}), z AS (SELECT a, b, g, over_label, (a * greatest(1e-6, least(1e0 - 1e-6, p_lr)) + b * greatest(1e-6, least(1e0 - 1e-6, p_xgb)) + g * greatest(1e-6, least(1e0 - 1e-6, p_lgbm))) / (a + b + g) AS p FROM rs, g)
SELECT {q_r6('a')} AS a, {q_r6('b')} AS b, {q_r6('g')} AS g, {q_r6('avg(' + q_loss('over_label', 'p', '1e-6') + ')')} AS logloss FROM z GROUP BY z.a, z.b, z.g""")
def ens_mix_grid(t):
    m = E.mixing_losses(t.resolved(), ("p_lr", "p_xgb", "p_lgbm"))
    return m.select(r6("a").alias("a"), r6("b").alias("b"), r6("g").alias("g"), r6("logloss").alias("logloss"))


N_GLOBAL, N_LOCAL = 6_000, 750
CANDS = E.weight_candidates(EX, N_GLOBAL - 1 - len(EX))
_cv = ", ".join("(" + ", ".join([str(i)] + [f"{w!r}e0" if "e" not in repr(w) else repr(w) for w in c]) + ")" for i, c in enumerate(CANDS))
_cn = ", ".join(f"v{i}" for i in range(6))
_dot = lambda tag: " + ".join(f"{tag}{i} * v{i}" for i in range(6))
SEARCH = RESOLVED + f""", cd(cand, {_cn}) AS (VALUES {_cv}), lg AS (SELECT {Q_CTX} AS ctx, over_label, {', '.join(f"CASE WHEN {e} IS NULL THEN 0e0 ELSE {q_logit(e, '1e-6')} END AS z{i}, CASE WHEN {e} IS NULL THEN 0e0 ELSE 1e0 END AS m{i}" for i, e in enumerate(EX))} FROM rs),
fz AS (SELECT ctx, cand, over_label, {_dot('z')} AS z, {_dot('m')} AS m FROM lg, cd), fx AS (SELECT ctx, cand, over_label, greatest(1e-6, least(1e0 - 1e-6, CASE WHEN m > 1e-6 THEN 1e0 / (1e0 + exp(-z / m)) ELSE 5e-1 END)) AS p FROM fz),
ll AS (SELECT ctx, cand, sum({q_loss('over_label', 'p', '1e-6')}) AS loss, count(*) AS n FROM fx GROUP BY 1, 2), gg AS (SELECT cand FROM ll GROUP BY cand ORDER BY sum(loss) / sum(n), cand LIMIT 1),
ob AS (SELECT ll.ctx, ll.n, ll.cand, loss / n + 5e-2 * ({' + '.join(f'(c.v{i} - g.v{i}) * (c.v{i} - g.v{i})' for i in range(6))}) AS obj, {', '.join(f'c.v{i} AS c{i}, g.v{i} AS g{i}' for i in range(6))} FROM ll JOIN cd c ON c.cand = ll.cand, cd g WHERE ll.cand < {N_LOCAL} AND g.cand = (SELECT cand FROM gg)),
bs AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY obj, cand) AS rn, CASE WHEN n >= 400 THEN n / (n + 500e0) ELSE 0e0 END AS pull FROM ob)"""


@query("ens_weight_search", f"WITH {SEARCH} SELECT ctx, n, {', '.join(f'{q_r6(f'pull * c{i} + (1e0 - pull) * g{i}')} AS w_{e}' for i, e in enumerate(EX))} FROM bs WHERE rn = 1")
def ens_weight_search(t):
    losses = durable(E.candidate_losses(t.resolved(), EX, CANDS))   # contexts x candidates: small
    s = E.search_weights(losses, EX, CANDS, 400, 500.0, 0.05, N_LOCAL)
    return s.select("ctx", "n", *[r6(f"w_{e}").alias(f"w_{e}") for e in EX])


@query("ens_prune", f"""WITH {RESOLVED}, xl AS ({XL}), m AS (SELECT expert, count(*) AS n, avg({q_loss('over_label', 'p', '1e-6')}) AS logloss, avg({q_hit('p', 'over_label')}) AS acc FROM xl GROUP BY 1),
u AS (SELECT avg({q_loss('over_label', q_logit_mean(EX, '1e-6'), '1e-6')}) AS u FROM rs), j AS (SELECT m.*, acc / sum(acc) OVER () AS weight, u FROM m, u), k AS (SELECT *, weight < 17e-2 AND (n < 500 OR logloss >= u) AS weak FROM j)
SELECT expert, n, {q_r6('logloss')} AS logloss, {q_r6('weight')} AS weight, weak AND row_number() OVER (PARTITION BY weak ORDER BY weight, logloss DESC, expert) <= 6 - 3 AS dropped FROM k""")
def ens_prune(t):
    from pyspark.sql import Window

    rows = t.resolved()
    m = R.unpivot(rows, EX, ["over_label"]).groupBy("expert").agg(F.count(F.lit(1)).alias("n"), F.avg(X.log_loss("over_label", "p", 1e-6)).alias("logloss"), F.avg(X.hit("p", "over_label")).alias("acc"))
    w = m.select("expert", (F.col("acc") / F.sum("acc").over(Window.partitionBy())).alias("weight"))   # one row per expert
    uniform = rows.agg(F.avg(X.log_loss("over_label", X.logit_mean(EX, 1e-6), 1e-6))).scalar()
    out = E.prune(w, m.drop("acc"), uniform, 3, 0.17, 500)
    return out.select("expert", "n", r6("logloss").alias("logloss"), r6("weight").alias("weight"), "dropped")


# --- rolling strategies --------------------------------------------------------------------------------------------
def q_rolled(part: str) -> str:
    over = f"OVER ({part} ORDER BY decision_time, id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"
    return RESOLVED + f""", hh AS (SELECT *, {', '.join(f"{q_hit(q_clip(e), 'over_label')} AS h_{e}" for e in EX)} FROM rs),
 rl AS (SELECT *, count(*) {over} AS seen, {', '.join(f'count(h_{e}) {over} AS n_{e}, avg(h_{e}) {over} AS a_{e}' for e in EX)} FROM hh)"""


AVG = q_logit_mean(CLIPPED)
_us = {e: f"({e} IS NOT NULL AND a_{e} IS NOT NULL)" for e in EX}
_top = f"greatest({', '.join(f'CASE WHEN {_us[e]} THEN a_{e} END' for e in EX)})"


def rolled(t):
    """Hit rates over the 100 rows before, once for all strategies of a query that use them."""
    return t._view("rolled", lambda: E.rolled_hits(t.resolved(), EX, ORDER, 100, []))


@query("ens_recency", f"""WITH {q_rolled('')}, tp AS (SELECT *, {_top} AS tp FROM rl)
SELECT id, {q_r6(f"CASE WHEN seen >= 10 AND tp IS NOT NULL THEN {q_pool(CLIPPED, [f'(CASE WHEN {_us[e]} THEN exp(5e0 * (a_{e} - tp)) ELSE 0e0 END)' for e in EX], '1e-7')} ELSE {AVG} END")} AS p FROM tp""")
def ens_recency(t):
    return E.recency_weighted(t.resolved(), EX, ORDER, rolled=rolled(t)).select("id", r6("p_recency").alias("p"))


_cand = union_sql([f"SELECT id, {i} AS i, a_{e} AS a, {q_clip(e)} AS v FROM rl WHERE n_{e} >= 10" for i, e in enumerate(EX)])


@query("ens_per_stat_best", f"""WITH {q_rolled('PARTITION BY stat_type')}, cd AS ({_cand}), b AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY a DESC, i) AS rn FROM cd)
SELECT rl.id, {q_r6(f'coalesce(CASE WHEN seen >= 20 THEN b.v END, {AVG})')} AS p FROM rl LEFT JOIN b ON b.id = rl.id AND rn = 1""")
def ens_per_stat_best(t):
    return E.per_stat_best(t.resolved(), EX, ORDER).select("id", r6("p_per_stat").alias("p"))


@query("ens_top_k", f"""WITH {q_rolled('')}, cd AS ({_cand}), b AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY a DESC, i) AS rn FROM cd), k AS (SELECT id, {q_sig(f"avg({q_logit('v')})")} AS p FROM b WHERE rn <= 3 AND v IS NOT NULL GROUP BY 1)
SELECT rl.id, {q_r6(f'CASE WHEN seen >= 20 AND k.p IS NOT NULL THEN k.p ELSE {AVG} END')} AS p FROM rl LEFT JOIN k ON k.id = rl.id""")
def ens_top_k(t):
    return E.top_k(t.resolved(), EX, ORDER, rolled=rolled(t)).select("id", r6("p_top_k").alias("p"))


_il = f"count(*) >= 300 AND avg(CASE WHEN (p < 5e-1) = (over_label = 1) THEN 1e0 ELSE 0e0 END) - avg({q_hit('p', 'over_label')}) >= 1e-3 AND avg({q_loss('over_label', 'p', '1e-6')}) - avg({q_loss('over_label', '(1e0 - p)', '1e-6')}) >= 1e-3"


@query("ens_inversion_apply", f"""WITH {RESOLVED}, xl AS ({XL}), ef AS (SELECT expert, {_il} AS flip FROM xl GROUP BY 1), sf AS (SELECT stat_type, {_il} AS flip FROM (SELECT *, p_forecast_cal AS p FROM rs) GROUP BY 1)
SELECT id, {', '.join(f"CASE WHEN {'sf.flip' if e == 'p_forecast_cal' else f'(SELECT flip FROM ef WHERE expert = {chr(39)}{e}{chr(39)})'} THEN {q_r6(f'1e0 - {e}')} ELSE {e} END AS {e}" for e in EX)} FROM pr LEFT JOIN sf ON sf.stat_type = pr.stat_type""")
def ens_inversion_apply(t):
    rows = t.resolved()
    gate = (F.col("n") >= 300) & (F.col("accuracy_inverted") - F.col("accuracy") >= 1e-3) & (F.col("logloss") - F.col("logloss_inverted") >= 1e-3)
    experts = R.inversion(R.unpivot(rows, EX, ["over_label"]), ["expert"], 1e-6).select("expert", gate.alias("flip"))
    stats = R.inversion_flags(rows, "p_forecast_cal", 300, 1e-3, 1e-3)
    stats = R.inversion(rows.withColumn("p", F.col("p_forecast_cal")), ["stat_type"], 1e-6).select("stat_type", gate.alias("flip"))
    return E.apply_inversions(t.predictions().select("id", "stat_type", *EX), experts, stats, EX).select("id", *[r6(e).alias(e) for e in EX])


# --- trained experts (MLlib: rows-only) -------------------------------------------------------------------------------
FEATURES = ["line_score", "n", "hist_mean", "hist_std", "rest_days", "stat_mean_3", "stat_mean_5", "stat_mean_10", "minutes_mean_5", "trend_slope", "stat_cv", "league_mean", "mu_stab", "z_line", "p_hist_over", "forecast_edge"]
ONE_HOT = ["Points", "Rebounds", "Assists", "Turnovers"]


def training_rows(t):
    """Feature frame with labels and positions in time, stored once for every fold that reads it."""
    lines = t.lines().select("id", "player_id", "stat_type", "slate", "line_score", "actual").filter("actual <> line_score")
    f = H.with_history(lines, logs(t)).withColumn("label", (F.col("actual") > F.col("line_score")).cast("double"))
    cols = [*[F.coalesce(F.col(c).cast("double"), num(0)).alias(c) for c in FEATURES], *L.one_hot("stat_type", ONE_HOT)]
    f = f.select("id", "slate", "stat_type", "label", *cols)
    seq = durable(L.positions(f, ["slate", "id"]))
    return seq, [*FEATURES, *[f"stat_type_{s}" for s in ONE_HOT]]


GBT_ROUNDS, FOLDS = 600, 5
MIN_TRAIN, MIN_TEST = 50, 10


#: Rows of a partition that trees are fitted on, about; MLlib keeps a partition as one block and a task reads it whole each round.
TREE_ROWS = 100_000


def tree_partitions(df, size: int = TREE_ROWS):
    """``df`` in partitions of about ``size`` rows if its files would give larger ones. A file split of a stored table is small,
    the vectors in it are not. Rows go by ``idx`` and are sorted by it, so that the seeded samples of the rounds are the same every time."""
    n = df.count()
    if n <= size * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-n // size), "idx").sortWithinPartitions("idx")


def fit_gbt(df, names, rounds: int = GBT_ROUNDS, late: float = 0.15):
    """Boosted trees of depth 3. The latest ``late`` share of the rows (by ``idx``) is not trained on but stops the rounds early."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    last = df.agg(F.max("idx")).scalar()
    va = VectorAssembler(inputCols=names, outputCol="features")
    rows = va.transform(tree_partitions(df).select("label", (F.col("idx") >= last * (1 - late)).alias("late"), *names)).select("label", "late", "features")
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, validationIndicatorCol="late", validationTol=1e-3, seed=42)
    return va, gbt.fit(rows)


def gbt_scores(df, va, model, out: str):
    from pyspark.ml.functions import vector_to_array

    s = model.transform(va.transform(df)).withColumn(out, vector_to_array("probability")[1])
    return s.drop("features", "rawPrediction", "probability", "prediction")


def folds_oof(seq, names, fold, out: str, scorer):
    """Train on everything before each fold, score the fold, union: one fit per fold. Folds with too few rows to train
    on or to score keep their rows, without a score, as status ``thin``."""
    rows = seq.withColumn("fold", fold)
    sizes = {r["fold"]: (r["i"], r["n"]) for r in rows.filter("fold IS NOT NULL").groupBy("fold").agg(F.min("idx").alias("i"), F.count(F.lit(1)).alias("n")).collect()}   # one row per fold
    parts = []
    for f, (start, n) in sorted(sizes.items()):
        test = rows.filter(F.col("fold") == f)
        if start < MIN_TRAIN or n < MIN_TEST:
            parts.append(test.withColumns({out: F.lit(None).cast("double"), "status": F.lit("thin")}))
        else:
            parts.append(scorer(rows.filter(F.col("idx") < start), test).withColumn("status", F.lit("scored")))
    if not parts:
        return rows.withColumns({out: F.lit(None).cast("double"), "status": F.lit("thin")}).limit(0)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def lr_scorer(names):
    def score(train, test):
        w, b = E.fit_logistic(train, names, "label", 1.0, scale=True)
        return test.withColumn("p_lr", E.logistic(names, w, b))
    return score


def gbt_scorer(names):
    def score(train, test):
        va, m = fit_gbt(train, names)
        return gbt_scores(test, va, m, "p_gbt")
    return score


def with_conformal(oof, p: str):
    q = C.fit_conformal(oof.select(F.lit(p).alias("expert"), F.col("label").cast("int").alias("over_label"), F.col(p).alias("p")))
    return oof.withColumn("q_hat", q.select("q_hat").scalar()).withColumn("set_size", X.set_size(p, "q_hat"))


@query("ens_lr_expert")
def ens_lr_expert(t):
    seq, names = training_rows(t)
    oof = with_conformal(folds_oof(seq, names, L.expanding_fold(FOLDS), "p_lr", lr_scorer(names)), "p_lr")
    return oof.select("id", "fold", "label", r6("p_lr").alias("p_lr"), "set_size", "status")


@query("ens_gbt_expert")
def ens_gbt_expert(t):
    seq, names = training_rows(t)
    oof = with_conformal(folds_oof(seq, names, L.expanding_fold(FOLDS), "p_gbt", gbt_scorer(names)), "p_gbt")
    return oof.select("id", "fold", "label", r6("p_gbt").alias("p_gbt"), "set_size", "status")


@query("ens_oof")
def ens_oof(t):
    """Prequential out-of-fold table of both trained experts, with the history forecast and the context of each row."""
    seq, names = training_rows(t)
    lr = folds_oof(seq, names, L.prequential_fold(FOLDS), "p_lr", lr_scorer(names)).select(
        "id", "fold", "label", "status", "stat_type", F.col("n").alias("n_eff"), r6("p_hist_over").alias("oof_forecast"), r6("p_lr").alias("oof_lr"))
    gbt = folds_oof(seq, names, L.prequential_fold(FOLDS), "p_gbt", gbt_scorer(names)).select("id", r6("p_gbt").alias("oof_gbt"))
    return lr.join(merged(gbt), "id")


@query("ens_importance")
def ens_importance(t):
    """Mean absolute attribution of each feature to the margin of the boosted trees, over the rows that they were fitted on."""
    seq, names = training_rows(t)
    train = seq.filter(L.holdout(0.2) == "train")
    _, model = fit_gbt(train, names)
    found = AT.mean_attributions(train, names, AT.ensemble_leaves(t.spark, model))
    place = Window.partitionBy().orderBy(F.desc("importance"), "feature")   # one row per feature
    return found.select(F.row_number().over(place).alias("rank"), "feature", r6("importance").alias("importance"))
