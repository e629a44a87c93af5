"""Reports over resolved predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, num, r6
from oddsmill.operators import reports as R
from oddsmill.operators.ordering import sorted_positions
from oddsmill.session import durable

from .adapters import LINES, PREDICTIONS, RESOLVED, q_hit, q_loss, q_pick, q_r6, q_sum, union_sql
from .registry import query

ORDER = ["decision_time", "id"]
ALL = [*K.EXPERTS, "p_final"]
LONG = union_sql([f"SELECT id, decision_time, stat_type, over_label, '{e}' AS expert, {e} AS p FROM rs WHERE {e} IS NOT NULL" for e in ALL])
TH = "(CASE WHEN conformal_set_size = 2 THEN round(6e-1 + 2e-2, 4) ELSE 6e-1 END)"
PICKED = RESOLVED + f""",
pk AS (SELECT *, {q_hit('p_final', 'over_label')} AS correct, {q_pick('p_final')} AS p_pick, {TH} AS threshold,
   {q_pick('p_final')} >= {TH} AS is_actionable, {q_pick('p_final')} >= {TH} AND conformal_set_size <> 2 AS is_placed FROM rs)"""
TIER_COLS = f"""count(*) AS n_scored, {q_r6('avg(correct)')} AS accuracy_scored,
  CAST(sum(CASE WHEN is_actionable THEN 1 ELSE 0 END) AS BIGINT) AS n_actionable,
  {q_r6('avg(CASE WHEN is_actionable THEN correct END)')} AS accuracy_actionable,
  {q_r6('avg(CASE WHEN is_actionable THEN 1e0 ELSE 0e0 END)')} AS actionable_coverage,
  CAST(sum(CASE WHEN is_placed THEN 1 ELSE 0 END) AS BIGINT) AS n_placed,
  {q_r6('avg(CASE WHEN is_placed THEN correct END)')} AS accuracy_placed,
  {q_r6('avg(CASE WHEN is_placed THEN 1e0 ELSE 0e0 END)')} AS placed_coverage,
  {q_r6('avg(p_pick)')} AS mean_p_pick, {q_r6('avg(threshold)')} AS mean_threshold"""


@query("rep_hit_rate", f"""WITH {PREDICTIONS} SELECT count(*) AS total_predictions,
  CAST(sum(CASE WHEN over_label IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS total_resolved,
  count(CASE WHEN over_label IS NOT NULL THEN is_correct END) AS total_scored,
  {q_r6('avg(CASE WHEN over_label IS NOT NULL THEN CAST(is_correct AS DOUBLE) END)')} AS overall_hit_rate FROM pr""")
def rep_hit_rate(t):
    return R.hit_rate(t.predictions())


_frame = "OVER (ORDER BY decision_time, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
_roll = ", ".join(f"CASE WHEN count(h_{e}) {_frame} >= 12 THEN avg(h_{e}) {_frame} END AS {n}_hit_rate"
                  for e, n in [("p_final", "ens"), *[(e, e) for e in K.EXPERTS]])


@query("rep_rolling_hit", f"""WITH {RESOLVED},
h AS (SELECT id, decision_time, {', '.join(f"{q_hit(e, 'over_label')} AS h_{e}" for e in ALL)} FROM rs),
w AS (SELECT row_number() OVER (ORDER BY decision_time, id) - 1 AS idx, count(*) OVER () - 11 AS np, {_roll} FROM h)
SELECT idx, {', '.join(f"{q_r6(n + '_hit_rate')} AS {n}_hit_rate" for n in ['ens', *K.EXPERTS])} FROM w
WHERE idx >= 11 AND (idx - 11) % (CASE WHEN np > 200 THEN greatest(1, np // 200) ELSE 1 END) = 0""")
def rep_rolling_hit(t):
    return R.rolling_hit(t.resolved(), 50, K.EXPERTS, ORDER)


@query("rep_tiers", f"WITH {PICKED} SELECT {TIER_COLS} FROM pk")
def rep_tiers(t):
    return R.tier_summary(R.with_pick(t.resolved()))


@query("rep_per_stat", f"WITH {PICKED} SELECT stat_type, {TIER_COLS} FROM pk GROUP BY stat_type")
def rep_per_stat(t):
    return R.tier_summary(R.with_pick(t.resolved()), ["stat_type"])


@query("rep_confidence_hist", f"""WITH {PREDICTIONS},
b AS (SELECT ({q_sum([f"CASE WHEN {q_pick('p_final')} >= {0.5 + i * 0.025!r}e0 THEN 1 ELSE 0 END" for i in range(1, 20)])}) AS bin, is_correct, over_label
  FROM pr WHERE p_final IS NOT NULL AND outcome IN ('over', 'under')),
g AS (SELECT bin, count(*) AS n, CAST(sum(is_correct) AS BIGINT) AS hits FROM b GROUP BY bin)
SELECT CAST(r.range AS BIGINT) AS bin, {q_r6('5e-1 + r.range * 25e-3')} AS range_start, coalesce(n, 0) AS count, CAST(coalesce(hits, 0) AS BIGINT) AS hits,
  CAST(coalesce(n, 0) - coalesce(hits, 0) AS BIGINT) AS misses, {q_r6('hits / CAST(n AS DOUBLE)')} AS hit_rate
FROM range(20) r LEFT JOIN g ON g.bin = r.range""")
def rep_confidence_hist(t):
    return R.confidence_hist(t.predictions(), 20)


@query("rep_frontier", f"""WITH {PICKED}, g AS (SELECT (50 + range) / 100e0 AS th FROM range(26))
SELECT round(th, 2) AS threshold, CAST(sum(CASE WHEN p_pick >= th THEN 1 ELSE 0 END) AS BIGINT) AS n_actionable,
  {q_r6('avg(CASE WHEN p_pick >= th THEN 1e0 ELSE 0e0 END)')} AS coverage,
  {q_r6('avg(CASE WHEN p_pick >= th THEN correct END)')} AS accuracy_actionable,
  CAST(sum(CASE WHEN p_pick >= th AND conformal_set_size <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_placed,
  {q_r6('avg(CASE WHEN p_pick >= th AND conformal_set_size <> 2 THEN 1e0 ELSE 0e0 END)')} AS placed_coverage,
  {q_r6('avg(CASE WHEN p_pick >= th AND conformal_set_size <> 2 THEN correct END)')} AS accuracy_placed
FROM pk, g GROUP BY th""")
def rep_frontier(t):
    return R.frontier(R.with_pick(t.resolved()))


@query("rep_direction", f"""WITH {PICKED} SELECT CASE WHEN p_final >= 5e-1 THEN 'OVER' ELSE 'UNDER' END AS direction, count(*) AS n,
  {q_r6('avg(correct)')} AS accuracy, {q_r6('count(*) / CAST((SELECT count(*) FROM pk) AS DOUBLE)')} AS coverage
FROM pk WHERE is_actionable GROUP BY 1""")
def rep_direction(t):
    return R.by_direction(R.with_pick(t.resolved()))


@query("rep_deciles", f"""WITH {PICKED} SELECT CAST({q_sum([f"CASE WHEN p_pick > {0.5 + 0.05 * i:.2f}e0 THEN 1 ELSE 0 END" for i in range(1, 10)])} AS BIGINT) AS decile,
  count(*) AS n, {q_r6('count(*) / CAST((SELECT count(*) FROM pk) AS DOUBLE)')} AS coverage, {q_r6('avg(correct)')} AS accuracy, {q_r6('avg(p_pick)')} AS mean_p_pick
FROM pk GROUP BY 1""")
def rep_deciles(t):
    return R.deciles(R.with_pick(t.resolved()))


TAIL = RESOLVED + f""", lg AS ({LONG}), tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY expert ORDER BY decision_time DESC, id DESC) AS rn FROM lg) WHERE rn <= 50)"""


def _tail(t, n=50):
    return R.tail_per_expert(t.resolved(), ALL, ORDER, n, ["over_label"])


@query("rep_last_n", f"""WITH {TAIL} SELECT expert, count(*) AS n, {q_r6('avg(' + q_hit('p', 'over_label') + ')')} AS accuracy,
  {q_r6('avg(' + q_loss('over_label', 'p') + ')')} AS logloss, {q_r6('avg(CAST(over_label AS DOUBLE))')} AS base_rate FROM tl GROUP BY expert""")
def rep_last_n(t):
    return R.expert_summary(_tail(t))


_inv = f"""count(*) AS n, avg({q_hit('p', 'over_label')}) AS a, avg(CASE WHEN (p < 5e-1) = (over_label = 1) THEN 1e0 ELSE 0e0 END) AS ai"""


@query("rep_inversion", f"""WITH {TAIL}, m AS (SELECT expert, {_inv}, avg({q_loss('over_label', 'p')}) AS l, avg({q_loss('over_label', '(1e0 - p)')}) AS li FROM tl GROUP BY expert)
SELECT expert, n, {q_r6('a')} AS accuracy, {q_r6('ai')} AS accuracy_inverted, {q_r6('l')} AS logloss, {q_r6('li')} AS logloss_inverted,
  ai > a + 2e-2 AS improves_accuracy, li < l - 2e-2 AS improves_logloss FROM m""")
def rep_inversion(t):
    return R.inversion(_tail(t)).withColumns({c: r6(c) for c in ["accuracy", "accuracy_inverted", "logloss", "logloss_inverted"]})


@query("rep_inversion_flags", f"""WITH {RESOLVED}, m AS (SELECT stat_type, count(*) AS n, avg({q_hit('p', 'over_label')}) AS a,
  avg(CASE WHEN (p < 5e-1) = (over_label = 1) THEN 1e0 ELSE 0e0 END) AS ai, avg({q_loss('over_label', 'p', '1e-6')}) AS l,
  avg({q_loss('over_label', '(1e0 - p)', '1e-6')}) AS li FROM (SELECT *, p_forecast_cal AS p FROM rs) GROUP BY stat_type)
SELECT stat_type, n, {q_r6('a')} AS accuracy, {q_r6('ai')} AS accuracy_inverted, {q_r6('l')} AS logloss, {q_r6('li')} AS logloss_inverted,
  n >= 250 AND ai - a >= 5e-2 AND l - li >= 2e-2 AS flip FROM m""")
def rep_inversion_flags(t):
    return R.inversion_flags(t.resolved(), "p_forecast_cal", 250, 0.05, 0.02)


@query("rep_confusion", f"""WITH {TAIL} SELECT expert, {', '.join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, c in [
    ('tp', 'p >= 5e-1 AND over_label = 1'), ('fp', 'p >= 5e-1 AND over_label = 0'), ('tn', 'p < 5e-1 AND over_label = 0'), ('fn', 'p < 5e-1 AND over_label = 1')])}
FROM tl GROUP BY expert""")
def rep_confusion(t):
    return R.confusion(_tail(t))


def sql_bin(p: str, bins: int) -> str:
    return q_sum([f"CASE WHEN {p} >= {i / bins!r}e0 THEN 1 ELSE 0 END" for i in range(1, bins)])


def sql_ece(src: str, bins: int) -> str:
    return f"""tb AS (SELECT stat_type, {sql_bin('p_final', bins)} AS bin, count(*) AS n, avg(p_final) AS mp, avg(CAST(over_label AS DOUBLE)) AS ma,
    sum(power(p_final - over_label, 2)) AS sq FROM {src} GROUP BY 1, 2),
  ec AS (SELECT stat_type, CAST(sum(n) AS BIGINT) AS n, sum(sq) / sum(n) AS brier, sum(abs(mp - ma) * n) / sum(n) AS ece FROM tb GROUP BY 1 HAVING sum(n) >= 10)"""


@query("rep_brier_ece", f"""WITH {RESOLVED}, sc AS (SELECT stat_type, p_final, over_label FROM rs UNION ALL SELECT '__all__', p_final, over_label FROM rs),
{sql_ece('sc', 5)} SELECT stat_type, n, {q_r6('brier')} AS brier, {q_r6('ece')} AS ece FROM ec""")
def rep_brier_ece(t):
    out = R.overall_and_each(t.resolved(), "stat_type", lambda d, k: R.brier_ece(d, 5, k))
    return out.select("stat_type", "n", r6("brier").alias("brier"), r6("ece").alias("ece"))


@query("rep_ece10", f"""WITH {RESOLVED}, sc AS (SELECT '__all__' AS stat_type, p_final, over_label FROM rs), {sql_ece('sc', 10)}
SELECT n, {q_r6('ece')} AS ece FROM ec""")
def rep_ece10(t):
    return R.brier_ece(t.resolved(), 10).select("n", r6("ece").alias("ece"))


@query("rep_calibration_bins", f"""WITH {RESOLVED} SELECT CAST({sql_bin('p_final', 10)} AS BIGINT) AS bin, count(*) AS n,
 {q_r6('avg(p_final)')} AS mean_predicted, {q_r6('avg(CAST(over_label AS DOUBLE))')} AS mean_actual FROM rs GROUP BY 1""")
def rep_calibration_bins(t):
    return R.reliability(t.resolved(), 10).select(big("bin").alias("bin"), "n", r6("mean_pred").alias("mean_predicted"), r6("mean_actual").alias("mean_actual"))


# --- drift ------------------------------------------------------------------------------------------
DRIFT_CORRECT_SQL = "(CASE WHEN (p_final >= 5e-1 AND actual_value > line_score) OR (p_final < 5e-1 AND actual_value <= line_score) THEN 1e0 ELSE 0e0 END)"
DRIFT = RESOLVED + f""",
dr AS (SELECT *, {DRIFT_CORRECT_SQL} AS correct, decision_time < clock - INTERVAL 7 DAY AS is_base
  FROM (SELECT rs.*, max(decision_time) OVER () AS clock FROM rs) WHERE decision_time >= clock - INTERVAL 37 DAY)"""


def drift_correct():
    over = X.pick_over("p_final")
    return ((over & (F.col("actual_value") > F.col("line_score"))) | (~over & (F.col("actual_value") <= F.col("line_score")))).cast("double")


def drift_frame(t):
    return time_windows(t.resolved().withColumn("correct", drift_correct()))


def time_windows(r):
    return (
        r.withColumn("_clock", r.agg(F.max("decision_time")).scalar())
        .filter(F.col("decision_time") >= F.col("_clock") - F.expr("interval 37 days"))
        .withColumn("is_base", F.col("decision_time") < F.col("_clock") - F.expr("interval 7 days"))
    )


def sql_psi(feature: str, src: str = "dr") -> str:
    qs = ", ".join(f"{i / 10!r}" for i in range(1, 10))
    return f"""(WITH e0 AS (SELECT list_sort(list_distinct(quantile_cont({feature}, [{qs}]))) AS e FROM {src} WHERE is_base),
   b AS (SELECT len(list_filter(e, lambda x: x <= {feature})) AS bin, is_base FROM {src}, e0 WHERE {feature} IS NOT NULL),
   t AS (SELECT sum(CASE WHEN is_base THEN 1e0 ELSE 0e0 END) AS tb, sum(CASE WHEN is_base THEN 0e0 ELSE 1e0 END) AS tc FROM b),
   k AS (SELECT len(e) + 1e0 AS k, e FROM e0),
   h AS (SELECT g.range AS bin, sum(CASE WHEN b.is_base THEN 1e0 ELSE 0e0 END) AS nb, sum(CASE WHEN NOT b.is_base THEN 1e0 ELSE 0e0 END) AS nc
         FROM (SELECT unnest(range(0, CAST(k AS BIGINT))) AS range FROM k) g LEFT JOIN b ON b.bin = g.range GROUP BY 1)
   SELECT '{feature}' AS feature, CASE WHEN max(tb) >= 10 AND max(tc) >= 10 AND max(k) >= 2 THEN greatest(0e0,
     sum(((nc + 1e-4) / (tc + 1e-4 * k) - (nb + 1e-4) / (tb + 1e-4 * k)) * ln(((nc + 1e-4) / (tc + 1e-4 * k)) / ((nb + 1e-4) / (tb + 1e-4 * k))))) ELSE 0e0 END AS psi,
     CAST(max(tb) AS BIGINT) AS n_baseline, CAST(max(tc) AS BIGINT) AS n_recent FROM h, t, k)"""


FEATURES = ["p_final", "line_score", "n_eff"]


@query("rep_psi", f"WITH {DRIFT} SELECT feature, {q_r6('psi')} AS psi, n_baseline, n_recent FROM ({' UNION ALL '.join(f'SELECT * FROM {sql_psi(f)}' for f in FEATURES)})")
def rep_psi(t):
    return R.psi(drift_frame(t), FEATURES, "is_base").withColumn("psi", r6("psi"))


@query("rep_perf_drift", f"""WITH {DRIFT}, m AS (SELECT CAST(sum(CASE WHEN is_base THEN 0 ELSE 1 END) AS BIGINT) AS n_recent, CAST(sum(CASE WHEN is_base THEN 1 ELSE 0 END) AS BIGINT) AS n_baseline,
  avg(CASE WHEN NOT is_base THEN correct END) AS r, avg(CASE WHEN is_base THEN correct END) AS b FROM dr)
SELECT n_recent, n_baseline, {q_r6('r')} AS accuracy_recent, {q_r6('b')} AS accuracy_baseline,
 {q_r6('CASE WHEN n_recent >= 50 AND n_baseline >= 50 THEN b - r ELSE 0e0 END')} AS delta,
 CASE WHEN n_recent >= 50 AND n_baseline >= 50 THEN b - r ELSE 0e0 END > 5e-2 AS is_drifted FROM m""")
def rep_perf_drift(t):
    return R.performance_drift(drift_frame(t), "correct", "is_base")


def drift_checks(d):
    """One row per check: performance, distribution (largest PSI), calibration (ECE of the recent window)."""
    perf = R.performance_drift(d, "correct", "is_base").select(
        F.lit("performance").alias("check_type"), F.col("delta").alias("metric_value"), num(0.05).alias("threshold"))
    dist = R.psi(d, FEATURES, "is_base").agg(F.max("psi").alias("m")).select(
        F.lit("distribution").alias("check_type"), r6("m").alias("metric_value"), num(0.2).alias("threshold"))
    recent = d.filter(~F.col("is_base")).withColumn("over_label", (F.col("actual_value") > F.col("line_score")).cast("int"))
    cal = R.brier_ece(recent, 10, min_rows=0).select(
        F.lit("calibration").alias("check_type"), r6(F.when(F.col("n") >= 30, F.col("ece")).otherwise(num(0))).alias("metric_value"), num(0.1).alias("threshold"))
    return perf.unionByName(dist).unionByName(cal).withColumn("is_drifted", F.col("metric_value") > F.col("threshold"))


CHECKS = f""",
rc AS (SELECT '__all__' AS stat_type, p_final, CASE WHEN actual_value > line_score THEN 1 ELSE 0 END AS over_label FROM dr WHERE NOT is_base),
{sql_ece('rc', 10)},
ck0 AS (SELECT 'performance' AS check_type, {q_r6('CASE WHEN count(CASE WHEN is_base THEN 1 END) >= 50 AND count(CASE WHEN NOT is_base THEN 1 END) >= 50 THEN avg(CASE WHEN is_base THEN correct END) - avg(CASE WHEN NOT is_base THEN correct END) ELSE 0e0 END')} AS metric_value, 5e-2 AS threshold FROM dr
  UNION ALL SELECT 'distribution', {q_r6('max(psi)')}, 2e-1 FROM ({' UNION ALL '.join(f'SELECT * FROM {sql_psi(f)}' for f in FEATURES)})
  UNION ALL SELECT 'calibration', CASE WHEN n >= 30 THEN {q_r6('ece')} ELSE 0e0 END, 1e-1 FROM ec),
ck AS (SELECT *, metric_value > threshold AS is_drifted FROM ck0)"""
DRIFT_CHECKS = DRIFT + CHECKS

# Fixed values of the report: rows a baseline needs, rows of the fallback's pool, hours until data count as stale.
MIN_BASELINE, FALLBACK_POOL, STALE_HOURS = 200, 5000, 48


def drift_windows(rows):
    """``rows`` with ``correct``, ``is_base`` and ``window_mode``: the last 7 days against the 30 before, or, where that baseline has
    under ``MIN_BASELINE`` rows, two row windows of equal size at the end of the log, if it is long enough."""
    late = [F.col("decision_time").desc(), F.col("id").desc()]
    rows = rows.withColumn("correct", drift_correct())
    timed = time_windows(rows)
    size = timed.agg(X.count_true(F.col("is_base")).alias("base"), X.count_true(~F.col("is_base")).alias("recent"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    pool = sorted_positions(rows, late, "_rn").withColumns({
        "_rn": F.col("_rn") + 1, "_n": F.least(total, F.lit(FALLBACK_POOL)), "_s": size.select(F.struct("base", "recent")).scalar()})
    k = F.least(F.greatest(F.lit(MIN_BASELINE), F.col("_s.recent")), F.floor(F.col("_n") / 2))
    fallback = pool.filter((F.col("_s.base") < MIN_BASELINE) & (F.col("_n") >= 2 * MIN_BASELINE) & (F.col("_rn") <= 2 * k)).withColumn("is_base", F.col("_rn") > k)
    kept = [*rows.columns, "is_base"]
    both = timed.select(*kept, F.lit("time_window").alias("window_mode")).unionByName(fallback.select(*kept, F.lit("row_fallback").alias("window_mode")))
    # the later mode in this order wins: fallback rows exist only where they are wanted
    both = durable(both)
    return both.filter(F.col("window_mode") == both.agg(F.min("window_mode")).scalar())


def report_status(checks, rows, now):
    """The checks with ``actionable``, ``window_mode`` and the report's ``status``. Drift of the distribution alone is advisory in row-fallback
    mode. First of: invalid baseline (recent rows alone), stale data, drift, insufficient data, ok."""
    facts = rows.agg(F.max("window_mode").alias("mode"), X.count_true(F.col("is_base")).alias("base"), X.count_true(~F.col("is_base")).alias("recent"), F.max(F.when(~F.col("is_base"), F.col("decision_time"))).alias("latest"))
    f = checks.withColumns({"_f": facts.select(F.struct("mode", "base", "recent", "latest")).scalar(), "_now": now})
    whole = Window.partitionBy()   # three rows, one per check
    hard = F.max(F.col("is_drifted") & (F.col("check_type") != "distribution")).over(whole)
    f = f.withColumn("actionable", F.col("is_drifted") & (hard | (F.col("_f.mode") != "row_fallback")))
    stale = F.col("_now") - F.expr(f"interval {STALE_HOURS} hours") > F.col("_f.latest")
    status = (F.when((F.col("_f.base") == 0) & (F.col("_f.recent") > 0), "invalid_baseline").when(stale, "stale_data").when(F.max("actionable").over(whole), "drift_detected")
              .when((F.col("_f.base") == 0) | (F.col("_f.recent") == 0), "insufficient_data").otherwise("ok"))
    return f.select("check_type", "metric_value", "threshold", "is_drifted", "actionable", F.col("_f.mode").alias("window_mode"), status.alias("status"))


_late = "ORDER BY decision_time DESC, id DESC"
SWITCH = DRIFT.replace("dr AS (", "dt AS (", 1) + f""",
fp AS (SELECT *, row_number() OVER ({_late}) AS rn, count(*) OVER () AS n FROM (SELECT rs.*, {DRIFT_CORRECT_SQL} AS correct FROM rs {_late} LIMIT {FALLBACK_POOL})),
fk AS (SELECT *, least(greatest({MIN_BASELINE}, (SELECT count(*) FROM dt WHERE NOT is_base)), n // 2) AS k FROM fp),
fb AS (SELECT * FROM fk WHERE n >= {2 * MIN_BASELINE} AND rn <= 2 * k AND (SELECT count(*) FROM dt WHERE is_base) < {MIN_BASELINE}),
dr AS (SELECT id, decision_time, p_final, line_score, n_eff, actual_value, correct, is_base, 'time_window' AS window_mode FROM dt WHERE NOT EXISTS (SELECT 1 FROM fb)
  UNION ALL SELECT id, decision_time, p_final, line_score, n_eff, actual_value, correct, rn > k, 'row_fallback' FROM fb)""" + CHECKS + f""",
ca AS (SELECT *, is_drifted AND ((SELECT bool_or(is_drifted AND check_type <> 'distribution') FROM ck) OR window_mode <> 'row_fallback') AS actionable FROM ck, (SELECT max(window_mode) AS window_mode, count(CASE WHEN is_base THEN 1 END) AS nb, count(CASE WHEN NOT is_base THEN 1 END) AS nr, max(CASE WHEN NOT is_base THEN decision_time END) AS latest FROM dr))"""


@query("rep_drift_report", f"""WITH {SWITCH} SELECT check_type, metric_value, threshold, is_drifted, actionable, window_mode, CASE WHEN nb = 0 AND nr > 0 THEN 'invalid_baseline'
 WHEN (SELECT max(decision_time) FROM pr) - INTERVAL {STALE_HOURS} HOUR > latest THEN 'stale_data' WHEN (SELECT bool_or(actionable) FROM ca) THEN 'drift_detected' WHEN nb = 0 OR nr = 0 THEN 'insufficient_data' ELSE 'ok' END AS status FROM ca""")
def rep_drift_report(t):
    """The newest prediction, graded or not, is the clock: graded rows that end 48 hours before it are stale."""
    rows = drift_windows(t.resolved())
    return report_status(drift_checks(rows), rows, t.predictions().agg(F.max("decision_time")).scalar())


@query("rep_drift_policy", f"""WITH {DRIFT_CHECKS} SELECT check_type, is_drifted,
 is_drifted AND (SELECT bool_or(is_drifted AND check_type <> 'distribution') FROM ck) AS actionable,
 is_drifted AND NOT (SELECT bool_or(is_drifted AND check_type <> 'distribution') FROM ck) AS suppressed FROM ck""")
def rep_drift_policy(t):
    """Row-fallback mode: drift of the distribution alone is advisory."""
    checks = drift_checks(drift_frame(t))
    other = F.max(F.col("is_drifted") & (F.col("check_type") != "distribution")).over(Window.partitionBy())   # three rows
    return checks.select("check_type", "is_drifted", (F.col("is_drifted") & other).alias("actionable"),
                         (F.col("is_drifted") & ~other).alias("suppressed"))


@query("rep_row_fallback", f"""WITH {RESOLVED}, o AS (SELECT *, row_number() OVER (ORDER BY decision_time DESC, id DESC) AS rn, count(*) OVER () AS n FROM rs),
z AS (SELECT *, least(greatest(200, 300), n // 2) AS k FROM o)
SELECT CASE WHEN rn <= k THEN 'recent' ELSE 'baseline' END AS part, count(*) AS n, CAST(min(epoch_us(decision_time)) AS BIGINT) AS first_us, CAST(max(epoch_us(decision_time)) AS BIGINT) AS last_us,
  {q_r6('avg(p_final)')} AS mean_p FROM z WHERE n >= 400 AND rn <= k + least(k, n - k) GROUP BY 1""")
def rep_row_fallback(t):
    return fallback_windows(t.resolved(), recent_hint=300, min_rows=200)


def fallback_windows(df, recent_hint: int, min_rows: int):
    """Two equal row windows at the end of the log. Both are bounded, so a top-n sort finds them."""
    want = max(min_rows, recent_hint)
    total = df.agg(F.count(F.lit(1))).scalar()
    tail = df.select("decision_time", "id", "p_final").orderBy(F.col("decision_time").desc(), F.col("id").desc()).limit(2 * want)
    rn = F.row_number().over(Window.orderBy(F.col("decision_time").desc(), F.col("id").desc()))   # <= 2*want rows
    k = F.least(F.lit(want), F.floor(total / 2))
    cut = tail.withColumns({"_rn": rn, "_k": k, "_n": total}).filter(
        (F.col("_n") >= 2 * min_rows) & (F.col("_rn") <= F.col("_k") + F.least(F.col("_k"), F.col("_n") - F.col("_k"))))
    return cut.groupBy(F.when(F.col("_rn") <= F.col("_k"), "recent").otherwise("baseline").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.unix_micros(F.col("decision_time").cast("timestamp"))).alias("first_us"),
        F.max(F.unix_micros(F.col("decision_time").cast("timestamp"))).alias("last_us"), r6(F.avg("p_final")).alias("mean_p"))


# --- windows, ablation, backtest -----------------------------------------------------------------------
WINDOWS = [50, 100, 200]
COMPONENTS = [*K.EXPERTS, "p_final", "p_raw"]
CLONG = union_sql([f"SELECT id, decision_time, over_label, '{e}' AS expert, {e} AS p FROM rs WHERE {e} IS NOT NULL" for e in COMPONENTS])
_m = f"""{q_r6('avg(' + q_hit('p', 'over_label') + ')')} AS accuracy, {q_r6('avg(' + q_loss('over_label', 'p') + ')')} AS logloss, {q_r6('avg(power(p - over_label, 2))')} AS brier"""
MULTI = RESOLVED + f""", lg AS ({CLONG}), rk AS (SELECT *, row_number() OVER (PARTITION BY expert ORDER BY decision_time DESC, id DESC) AS rn FROM lg),
mw AS (SELECT expert, count(*) AS n, {_m}, 'all_time' AS "window" FROM lg GROUP BY expert
""" + " ".join(f"UNION ALL SELECT expert, count(*) AS n, {_m}, 'last_{w}' FROM rk WHERE rn <= {w} GROUP BY expert HAVING count(*) = {w}" for w in WINDOWS) + ")"


@query("rep_multi_window", f"WITH {MULTI} SELECT * FROM mw WHERE expert = 'p_final'")
def rep_multi_window(t):
    return R.last_window_metrics(t.resolved(), ["p_final"], ORDER, WINDOWS)


@query("rep_ablation", f"""WITH {MULTI} SELECT m.*, m."window" <> 'all_time' AND m.expert NOT IN ('p_final', 'p_raw') AND m.accuracy > f.accuracy + 3e-2 AS outperforms
FROM mw m JOIN mw f ON f.expert = 'p_final' AND f."window" = m."window" """)
def rep_ablation(t):
    m = R.last_window_metrics(t.resolved(), COMPONENTS, ORDER, WINDOWS)
    final = m.filter("expert = 'p_final'").select("window", F.col("accuracy").alias("_f"))
    better = (F.col("window") != "all_time") & ~F.col("expert").isin("p_final", "p_raw") & (F.col("accuracy") > F.col("_f") + 0.03)
    return m.join(final, "window").withColumn("outperforms", better).drop("_f")


# --- trading-style metrics -----------------------------------------------------------------------------
WF = RESOLVED + f""",
lo AS (SELECT min(decision_time) AS t0, max(decision_time) AS t1 FROM rs),
fo AS (SELECT CAST(i AS BIGINT) AS fold, t0 + INTERVAL (60 + 7 * i) DAY AS a, t0 + INTERVAL (74 + 7 * i) DAY AS b
  FROM lo, (SELECT unnest(range(0, 1000)) AS i) WHERE t0 + INTERVAL (74 + 7 * i) DAY <= t1),
wf AS (SELECT fold, decision_time, stat_type, over_label, p_final AS p, {q_hit('p_final', 'over_label')} AS hit, {q_pick('p_final')} >= 52e-2 AS conf
  FROM rs JOIN fo ON decision_time >= a AND decision_time < b)"""


def walk_forward_rows(df, train=60, test=14, slide=7):
    """Each row lands in every sliding test window that covers it: the fold numbers follow from its day offset,
    so no join is needed. Test windows overlap test/slide times at most."""
    span = df.agg(F.struct(F.min("decision_time").alias("t0"), F.max("decision_time").alias("t1"))).scalar()
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    day = num(86400e6)
    off = (micros(F.col("decision_time")) - micros(span["t0"])) / day - train
    last = F.floor(((micros(span["t1"]) - micros(span["t0"])) / day - train - test) / slide)
    hi = F.least(F.floor(off / slide), last)
    lo = F.greatest(F.floor((off - test) / slide) + 1, F.lit(0))
    folds = F.when((off >= 0) & (hi >= lo), F.sequence(lo, hi))
    return df.withColumn("fold", F.explode(folds)).select(
        big("fold").alias("fold"), "decision_time", "id", "stat_type", "over_label", F.col("p_final").alias("p"),
        X.hit("p_final", "over_label").alias("hit"), (X.p_pick("p_final") >= 0.52).alias("conf"))


@query("rep_walk_forward", f"""WITH {WF},
rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2e0 AS r FROM wf)
SELECT fold, count(*) AS n, {q_r6('avg(hit)')} AS hit_rate, count(CASE WHEN conf THEN 1 END) AS n_confident,
 {q_r6('avg(CASE WHEN conf THEN hit END)')} AS hit_rate_confident, {q_r6('avg(CASE WHEN conf THEN 2 * hit - 1 END)')} AS roi,
 {q_r6('avg(' + q_loss('over_label', 'p') + ')')} AS logloss,
 {q_r6('(sum(CASE WHEN over_label = 1 THEN r END) - sum(over_label) * (sum(over_label) + 1) / 2e0) / (sum(over_label) * CAST(sum(1 - over_label) AS DOUBLE))')} AS auc
FROM rk GROUP BY fold""")
def rep_walk_forward(t):
    from oddsmill.operators.distribution import rank_auc

    w = walk_forward_rows(t.resolved())
    conf = F.col("conf")
    base = w.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("hit")).alias("hit_rate"), X.count_true(conf).alias("n_confident"),
        r6(F.avg(F.when(conf, F.col("hit")))).alias("hit_rate_confident"),
        r6(F.avg(F.when(conf, 2 * F.col("hit") - 1))).alias("roi"), r6(F.avg(X.log_loss("over_label", "p"))).alias("logloss"))
    return base.join(rank_auc(w, ["fold"], "p", "over_label"), "fold").withColumn("auc", r6("auc"))


@query("rep_drawdown", f"""WITH {RESOLVED}, h AS (SELECT is_correct, row_number() OVER (ORDER BY decision_time, id) AS a, row_number() OVER (PARTITION BY is_correct ORDER BY decision_time, id) AS b FROM rs)
SELECT coalesce(max(c), 0) AS max_drawdown FROM (SELECT count(*) AS c FROM h WHERE is_correct = 0 GROUP BY a - b)""")
def rep_drawdown(t):
    return R.longest_run(t.resolved(), "is_correct", ORDER)


@query("rep_sharpe", f"""WITH {RESOLVED}, d AS (SELECT CAST(decision_time AS DATE) AS d, sum(2 * is_correct - 1) AS pnl FROM rs WHERE {q_pick('p_final')} >= 52e-2 GROUP BY 1)
SELECT count(*) AS days, {q_r6('CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252e0) ELSE 0e0 END')} AS sharpe FROM d""")
def rep_sharpe(t):
    return R.sharpe(t.resolved().filter(X.p_pick("p_final") >= 0.52), F.to_date("decision_time"), 2 * F.col("is_correct") - 1)


@query("rep_expert_eval", f"""WITH {RESOLVED}, lg AS ({union_sql([f"SELECT over_label, '{e}' AS expert, {e} AS p FROM rs WHERE {e} IS NOT NULL" for e in K.EXPERTS])}),
rk AS (SELECT *, rank() OVER (PARTITION BY expert ORDER BY p) + (count(*) OVER (PARTITION BY expert, p) - 1) / 2e0 AS r FROM lg)
SELECT expert, count(*) AS n, {q_r6('avg(' + q_hit('p', 'over_label') + ')')} AS accuracy, {q_r6('avg(' + q_loss('over_label', 'p', '1e-6') + ')')} AS logloss,
{q_r6('(sum(CASE WHEN over_label = 1 THEN r END) - sum(over_label) * (sum(over_label) + 1) / 2e0) / (sum(over_label) * CAST(sum(1 - over_label) AS DOUBLE))')} AS auc
FROM rk GROUP BY expert""")
def rep_expert_eval(t):
    return R.expert_eval(t.resolved(), K.EXPERTS)
