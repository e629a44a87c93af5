"""Publish policy, ranking and the flagship slate query."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.functions import coerce as CO
from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, num, r6
from oddsmill.operators import calibration as C
from oddsmill.operators import matching as J
from oddsmill.operators import policy as P
from oddsmill.operators import reports as R
from oddsmill.session import durable, merged

from .adapters import PREDICTIONS, RESOLVED, pick_from, q_case, q_hit, q_logit_mean, q_pick, q_r6, q_shrink, q_sum, sql_list, union_sql
from .q_ensemble import q_clip, rolled, sql_prior_of, sql_priors, sql_priors_as_of
from .q_forecast import DIST, distribution
from .q_joins import WORLD
from .q_scalar import q_edge, q_grade
from .registry import query

EX = K.EXPERTS
TOP = 10

# --- thresholds -----------------------------------------------------------------------------------------------
_need = "th + CASE WHEN conformal_set_size = 2 THEN 2e-2 ELSE 0e0 END"
FIT = RESOLVED + f""", g(th) AS (VALUES {', '.join(f'({g}e0)' for g in P.threshold_grid())}),
sr AS (SELECT stat_type AS scope, conformal_set_size, {q_pick('p_final')} AS p, {q_hit('p_final', 'over_label')} AS ok FROM rs UNION ALL SELECT '__global__', conformal_set_size, {q_pick('p_final')}, {q_hit('p_final', 'over_label')} FROM rs),
tc AS (SELECT scope, th, count(*) AS total, round(avg(CASE WHEN p >= {_need} THEN 1e0 ELSE 0e0 END), 4) AS cov, round(avg(CASE WHEN p >= {_need} THEN ok END), 4) AS acc FROM sr, g GROUP BY 1, 2),
tr AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY CASE WHEN acc >= 55e-2 THEN 0 ELSE 1 END, acc DESC, cov DESC, th) AS rn FROM tc WHERE cov >= 4e-1 AND acc IS NOT NULL),
tb AS (SELECT s.scope, s.total AS n, coalesce(tr.th, 55e-2) AS own FROM (SELECT scope, max(total) AS total FROM tc GROUP BY 1) s LEFT JOIN tr ON tr.scope = s.scope AND rn = 1),
tf AS (SELECT scope, n, CASE WHEN scope <> '__global__' AND n < 200 THEN (SELECT own FROM tb WHERE scope = '__global__') ELSE own END AS threshold, CASE WHEN scope <> '__global__' AND n < 200 THEN 'fallback_global' ELSE 'trained' END AS status FROM tb)"""


@query("pol_threshold_fit", f"WITH {FIT} SELECT * FROM tf")
def pol_threshold_fit(t):
    return P.fit_thresholds(t.resolved())


def q_pen(rate):
    return f"(CASE WHEN {rate} >= 95e-2 THEN 2e-2 * 25e-2 WHEN {rate} >= 9e-1 THEN 2e-2 * 5e-1 WHEN {rate} >= 85e-2 THEN 2e-2 * 75e-2 ELSE 2e-2 END)"


@query("pol_threshold_apply", f"""WITH {FIT}, ar AS (SELECT snapshot_id, avg(CASE WHEN conformal_set_size = 2 THEN 1e0 ELSE 0e0 END) AS rate FROM pr GROUP BY 1)
SELECT id, greatest(5e-1, least(99e-2, round(threshold + CASE WHEN conformal_set_size = 2 THEN {q_pen('rate')} ELSE 0e0 END, 4))) AS threshold FROM pr JOIN tf ON tf.scope = pr.stat_type JOIN ar ON ar.snapshot_id = pr.snapshot_id""")
def pol_threshold_apply(t):
    p = t.predictions().select("id", "stat_type", "snapshot_id", "conformal_set_size")
    rate = p.groupBy("snapshot_id").agg(X.share(F.col("conformal_set_size") == 2).alias("rate"))
    fit = P.fit_thresholds(t.resolved()).select(F.col("scope").alias("stat_type"), F.col("threshold").alias("base"))
    return p.join(fit, "stat_type").join(rate, "snapshot_id").select("id", X.threshold_for("base", "conformal_set_size", P.ambiguity_penalty(F.col("rate"))).alias("threshold"))


# --- slate inputs ----------------------------------------------------------------------------------------------
INPUT = DIST + f""", la AS (SELECT id, player_id, stat_type, slate, line_score, CASE WHEN actual > line_score THEN 1 ELSE 0 END AS over_label FROM ln), {sql_priors_as_of('la')},
si AS (SELECT CAST(ln.slate AS VARCHAR) AS slate, ln.id, ln.player_id, ln.stat_type, ln.line_score, {', '.join(f"{q_clip('ln.' + e)} AS {e}" for e in EX)}, fd.n_eff, fd.mu_hat, fd.sigma_hat,
  CASE WHEN ln.id % 3 = 0 THEN 2 WHEN ln.id % 50 = 1 THEN NULL ELSE 1 END AS set_size, CASE WHEN ln.id % 4 = 0 THEN 'per_stat' ELSE 'raw' END AS status,
  {sql_prior_of('x', 'global_prior').replace('line_score', 'ln.line_score')} AS context_prior FROM ln LEFT JOIN fd ON fd.id = ln.id LEFT JOIN cp ON cp.stat_type = ln.stat_type AND cp.slate = ln.slate)"""
PRIOR_ONLY = "stat_type IN (" + ", ".join(f"'{s}'" for s in K.PRIOR_ONLY_STATS) + ")"
_over = q_sum([f"CASE WHEN {e} >= 5e-1 THEN 1 ELSE 0 END" for e in EX])
_under = q_sum([f"CASE WHEN {e} < 5e-1 THEN 1 ELSE 0 END" for e in EX])
ROWS = INPUT + f""",
s1 AS (SELECT *, {PRIOR_ONLY} AS is_prior_only, CASE WHEN {PRIOR_ONLY} THEN coalesce(context_prior, 5e-1) ELSE {q_logit_mean(EX)} END AS p_raw FROM si),
s2 AS (SELECT *, CASE WHEN is_prior_only THEN coalesce(context_prior, 5e-1) ELSE {q_shrink('p_raw', 'n_eff', 'context_prior')} END AS p_final FROM s1),
s3 AS (SELECT *, CASE WHEN p_final >= 5e-1 THEN 'OVER' ELSE 'UNDER' END AS pick, {q_pick('p_final')} AS p_pick, {_over} >= 1 AND {_under} >= 1 AS has_diversity, coalesce(n_eff >= 10, false) AS has_min_neff,
   CASE WHEN mu_hat IS NOT NULL AND line_score > 0 THEN abs(mu_hat - line_score) <= 4 ELSE true END AS forecast_edge_ok, {q_edge('p_final', EX, 'set_size', 'n_eff', 'mu_hat', 'line_score', 'sigma_hat')} AS edge FROM s2)"""


def q_gate(src: str, dst: str, pen: str) -> str:
    th = f"greatest(5e-1, least(99e-2, round(6e-1 + CASE WHEN set_size = 2 THEN {pen} ELSE 0e0 END, 4)))"
    rs = "list_filter([CASE WHEN is_prior_only THEN 'prior_only_stat' END, CASE WHEN NOT has_diversity THEN 'no_expert_diversity' END, CASE WHEN NOT has_min_neff THEN 'low_n_eff' END, CASE WHEN NOT forecast_edge_ok THEN 'forecast_edge_too_large' END, CASE WHEN margin < 0 THEN 'low_pick_confidence' END, CASE WHEN edge < 5 THEN 'edge_below_min' END], lambda x: x IS NOT NULL)"
    return f"{dst}0 AS (SELECT *, {th} AS threshold, p_pick - {th} AS margin FROM {src}), {dst}1 AS (SELECT *, {rs} AS reasons FROM {dst}0), {dst} AS (SELECT *, len(reasons) = 0 AS is_publishable FROM {dst}1)"


def slate_input(t):
    """Lines joined with their forecast, the context prior that their slate could know, set size and status."""
    lines = t.lines()
    d = distribution(t).select("id", "n_eff", "mu_hat", "sigma_hat")
    labelled = lines.select("stat_type", "slate", "line_score", (F.col("actual") > F.col("line_score")).cast("int").alias("over_label"))
    j = lines.select("id", "player_id", "stat_type", "slate", "line_score", *EX).join(merged(d), "id", "left")
    j = C.context_prior_as_of(j, C.priors_as_of(labelled, labelled))
    return j.withColumns({"slate": F.col("slate").cast("string"), "set_size": F.when(F.col("id") % 3 == 0, 2).when(F.col("id") % 50 == 1, None).otherwise(1),
                          "status": F.when(F.col("id") % 4 == 0, "per_stat").otherwise("raw")})


def scored_rows(t):
    """Row scores, stored because the slate passes read them more than once."""
    return durable(P.score_rows(slate_input(t), EX))


GATES = ROWS + ", " + q_gate("s3", "pg", "2e-2")


@query("pol_publish_gates", f"WITH {GATES} SELECT id, pick, {q_r6('p_final')} AS p_final, edge, threshold, array_to_string(reasons, ',') AS reasons, is_publishable FROM pg")
def pol_publish_gates(t):
    d = P.score_rows(slate_input(t), EX)
    return d.select("id", "pick", r6("p_final").alias("p_final"), "edge", "threshold", F.array_join("reasons", ",").alias("reasons"), "is_publishable")


ADAPT = ROWS + ", sa AS (SELECT s3.*, avg(CASE WHEN set_size = 2 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY slate) AS ambiguous_rate FROM s3), " + q_gate("sa", "ad", q_pen("ambiguous_rate"))


@query("pol_adaptive_penalty", f"WITH {ADAPT} SELECT id, {q_r6('ambiguous_rate')} AS ambiguous_rate, threshold, {q_r6('margin')} AS margin, is_publishable FROM ad")
def pol_adaptive_penalty(t):
    d = P.adaptive_penalty(scored_rows(t))
    return d.select("id", r6("ambiguous_rate").alias("ambiguous_rate"), "threshold", r6("margin").alias("margin"), "is_publishable")


SPREAD = ADAPT + """, sp0 AS (SELECT *, max(p_final) OVER (PARTITION BY slate) - min(p_final) OVER (PARTITION BY slate) AS spread FROM ad),
sp AS (SELECT * EXCLUDE (is_publishable), is_publishable AND spread >= 1e-1 AS is_publishable FROM sp0)"""


@query("pol_spread_abstain", f"WITH {SPREAD} SELECT id, {q_r6('spread')} AS spread, is_publishable, array_to_string(CASE WHEN spread < 1e-1 THEN list_append(reasons, 'low_model_discrimination') ELSE reasons END, ',') AS reasons FROM sp")
def pol_spread_abstain(t):
    d = P.spread_abstain(P.adaptive_penalty(scored_rows(t)))
    return d.select("id", r6("spread").alias("spread"), "is_publishable", F.array_join("reasons", ",").alias("reasons"))


def q_diverse(src: str, dst: str, where: str, top: int = TOP, order: str = "edge") -> str:
    """CTEs that pick the diverse top of ``src`` into ``dst`` (adds rank)."""
    def plan(share):
        return f"""SELECT c.slate, max(n.range) AS total, greatest(1, floor(max(n.range) * {share})) AS cap FROM {dst}s c, range(1, {top + 1}) n WHERE n.range <= c.tp
     AND (SELECT sum(least(cnt, greatest(1, floor(n.range * {share})))) FROM {dst}c k WHERE k.slate = c.slate) >= n.range GROUP BY c.slate"""
    return f"""{dst}i AS (SELECT * FROM {src} WHERE {where}), {dst}c AS (SELECT slate, stat_type, count(*) AS cnt FROM {dst}i GROUP BY 1, 2),
{dst}s AS (SELECT slate, count(*) AS k, least({top}, sum(cnt)) AS tp FROM {dst}c GROUP BY 1), {dst}a AS ({plan('7e-1')}), {dst}b AS ({plan('8e-1')}),
{dst}p AS (SELECT s.slate, CASE WHEN k <= 1 THEN tp WHEN a.total >= greatest(1, ceil(tp * 75e-2)) OR b.total < a.total THEN a.total ELSE b.total END AS total,
   CASE WHEN k <= 1 THEN tp WHEN a.total >= greatest(1, ceil(tp * 75e-2)) OR b.total < a.total THEN a.cap ELSE b.cap END AS cap FROM {dst}s s JOIN {dst}a a ON a.slate = s.slate JOIN {dst}b b ON b.slate = s.slate),
{dst}r AS (SELECT i.*, row_number() OVER (PARTITION BY i.slate, i.stat_type ORDER BY {order} DESC, id) AS rs, p.total, p.cap FROM {dst}i i JOIN {dst}p p ON p.slate = i.slate),
{dst}q AS (SELECT *, row_number() OVER (PARTITION BY slate ORDER BY {order} DESC, id) AS rank FROM {dst}r WHERE rs <= cap), {dst} AS (SELECT * EXCLUDE (rs, total, cap) FROM {dst}q WHERE rank <= total)"""


@query("pol_diverse_top", f"WITH {SPREAD}, {q_diverse('sp', 'dt', 'true')} SELECT slate, id, stat_type, edge, rank FROM dt")
def pol_diverse_top(t):
    d = durable(P.spread_abstain(P.adaptive_penalty(scored_rows(t))).select("slate", "id", "stat_type", "edge"))
    return P.diverse_top(d, TOP).select("slate", "id", "stat_type", "edge", big("rank").alias("rank"))


IMB = SPREAD + ", " + q_diverse("sp", "t1", "is_publishable") + f""",
sd0 AS (SELECT slate, avg(CASE WHEN pick = 'OVER' THEN 1e0 ELSE 0e0 END) AS ov FROM t1 GROUP BY 1), sd AS (SELECT slate, greatest(ov, 1e0 - ov) AS pct, CASE WHEN ov > 5e-1 THEN 'OVER' ELSE 'UNDER' END AS dom FROM sd0),
im0 AS (SELECT sp.*, sp.edge AS base_edge, coalesce(t1.id IS NOT NULL AND pct > 75e-2 AND sp.pick = dom, false) AS hit, pct FROM sp LEFT JOIN t1 ON t1.id = sp.id LEFT JOIN sd ON sd.slate = sp.slate),
im1 AS (SELECT * EXCLUDE (edge), CASE WHEN hit THEN round(greatest(0e0, base_edge - round(12e0 * greatest(0e0, least(1e0, (pct - 75e-2) / 25e-2)) * (1e0 - least(1e0, abs(p_final - coalesce(context_prior, 5e-1)) / 2e-1)), 1)), 1) ELSE base_edge END AS edge FROM im0),
im AS (SELECT * EXCLUDE (is_publishable), is_publishable AND NOT (hit AND edge < 5) AS is_publishable FROM im1)"""


@query("pol_imbalance", f"WITH {IMB} SELECT id, base_edge, edge, is_publishable FROM im")
def pol_imbalance(t):
    d = durable(P.spread_abstain(P.adaptive_penalty(scored_rows(t))))
    out = P.imbalance(d, P.diverse_top(d.filter("is_publishable"), TOP))
    return out.select("id", "base_edge", "edge", "is_publishable")


Q_LEVEL = """CASE WHEN NOT is_prior_only AND forecast_edge_ok AND (n_eff IS NULL OR n_eff >= 5) AND p_pick >= 58e-2 AND edge >= 25e-1 AND coalesce(set_size <> 2, true) THEN 1
 WHEN NOT is_prior_only AND forecast_edge_ok AND (n_eff IS NULL OR n_eff >= 5) AND p_pick >= 55e-2 AND edge >= 1 THEN 2 WHEN NOT is_prior_only THEN 3 ELSE 4 END"""


def q_soft(src: str, dst: str, order: str) -> str:
    return f"""{dst}l AS (SELECT *, {Q_LEVEL} AS level FROM {src}), {dst}m AS (SELECT *, min(level) OVER (PARTITION BY slate) AS mn FROM {dst}l),
{dst}o AS (SELECT *, row_number() OVER (PARTITION BY slate ORDER BY {order} DESC, id) AS ro FROM {dst}m WHERE level = mn), {q_diverse(f'{dst}o', dst, f'ro <= {TOP}', TOP, order)}"""


@query("pol_soft_fallback", f"WITH {SPREAD}, np AS (SELECT * FROM sp WHERE CASE WHEN substr(slate, 10, 1) IN ('1', '4', '7') THEN NOT forecast_edge_ok ELSE NOT is_publishable END), {q_soft('np', 'sf', 'edge')} SELECT slate, id, level, edge, rank FROM sf")
def pol_soft_fallback(t):
    d = P.spread_abstain(P.adaptive_penalty(scored_rows(t)))
    thin = F.substring("slate", 10, 1).isin("1", "4", "7")
    pool = durable(d.filter(F.when(thin, ~F.col("forecast_edge_ok")).otherwise(~F.col("is_publishable"))))
    out = P.soft_fallback(pool, TOP)
    return out.select("slate", "id", "level", "edge", big("rank").alias("rank"))


@query("pol_score_slate", f"""WITH {IMB}, {q_diverse('im', 'fn', 'is_publishable')}, em AS (SELECT * FROM im WHERE slate NOT IN (SELECT slate FROM fn)), {q_soft('em', 'fb', 'base_edge')},
al AS (SELECT slate, id, player_id, stat_type, line_score, pick, p_final, edge, threshold, margin, rank, is_publishable, n_eff, status, false AS fallback_used FROM fn UNION ALL SELECT slate, id, player_id, stat_type, line_score, pick, p_final, edge, threshold, margin, rank, is_publishable, n_eff, status, true FROM fb)
SELECT slate, rank, id, player_id, stat_type, line_score, pick, {q_r6('p_final')} AS prob_over, edge, {q_grade('edge')} AS grade, threshold, {q_r6('margin')} AS margin, is_publishable, fallback_used FROM al""")
def pol_score_slate(t):
    out = P.score_slate(slate_input(t), EX, TOP, durable)
    return out.select("slate", big("rank").alias("rank"), "id", "player_id", "stat_type", "line_score", "pick", r6("p_final").alias("prob_over"), "edge",
                      X.grade("edge").alias("grade"), "threshold", r6("margin").alias("margin"), "is_publishable", "fallback_used")


# --- logged predictions --------------------------------------------------------------------------------------------
LOGGED = PREDICTIONS + f""",
lg0 AS (SELECT id, 's' || (snapshot_id % 12) AS slate, player_id * 1000 + CAST(line_score AS BIGINT) AS line_id, stat_type, decision_time, CASE WHEN id % 5 <> 0 THEN p_final END AS prob_over, CASE WHEN id % 7 <> 0 THEN p_raw * 100 END AS rank_score, CASE WHEN id % 4 <> 0 THEN p_lr END AS confidence,
  '{{"edge":' || CASE WHEN id % 3 = 0 THEN 'null' ELSE CAST(id % 90 AS VARCHAR) END || ',"p_final":0.' || (10 + id % 80) || ',"is_publishable":' || (['"yes"', 'true', '"no"', 'null'])[CAST(id % 4 + 1 AS INT)] || ',"selection_threshold":0.5' || (id % 9) || '}}' AS details, CASE WHEN id % 6 <> 0 THEN 'over' END AS pick FROM pr),
lg1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slate, line_id ORDER BY decision_time DESC, id DESC) AS rn FROM lg0) WHERE rn = 1),
lg2 AS (SELECT *, greatest(0e0, least(1e0, coalesce(prob_over, TRY_CAST(details->>'$.p_final' AS DOUBLE), 5e-1))) AS p FROM lg1),
lg3 AS (SELECT *, coalesce(confidence, {q_pick('p')}) AS conf, coalesce(rank_score, coalesce(confidence, {q_pick('p')})) AS rk, struct_pack(a := coalesce(rank_score, -1e9), b := coalesce(confidence, -1e9)) AS stored, coalesce(TRY_CAST(details->>'$.selection_threshold' AS DOUBLE), 6e-1) AS th FROM lg2),
lg4 AS (SELECT *, round(greatest(0e0, least(100e0, coalesce(TRY_CAST(details->>'$.edge' AS DOUBLE), CASE WHEN rk <= 15e-1 THEN rk * 100 ELSE rk END))), 1) AS edge, {q_pick('p')} - th AS margin FROM lg3),
lg5 AS (SELECT *, CASE WHEN details->>'$.is_publishable' IS NULL THEN margin >= 0 AND edge >= 5 ELSE lower(details->>'$.is_publishable') IN ('1', 'true', 'yes', 'y') END AS ok, CASE WHEN upper(pick) IN ('OVER', 'UNDER') THEN upper(pick) WHEN p >= 5e-1 THEN 'OVER' ELSE 'UNDER' END AS side FROM lg4),
lg AS (SELECT *, ok OR NOT bool_or(ok) OVER (PARTITION BY slate) AS usable FROM lg5)"""


@query("pol_logged_top", f"WITH {LOGGED}, {q_diverse('lg', 'lt', 'usable', TOP, 'stored')} SELECT slate, rank, id, {q_r6('p')} AS prob_over, side AS pick, edge, {q_grade('edge')} AS grade, {q_r6('margin')} AS margin, ok AS is_publishable FROM lt")
def pol_logged_top(t):
    return logged_top(logged(t), TOP)


def logged(t):
    i = F.col("id")
    text = lambda x: x.cast("string")
    details = F.concat(F.lit('{"edge":'), F.when(i % 3 == 0, "null").otherwise(text(i % 90)), F.lit(',"p_final":0.'), text(10 + i % 80), F.lit(',"is_publishable":'),
                       pick_from(['"yes"', "true", '"no"', "null"], i % 4), F.lit(',"selection_threshold":0.5'), text(i % 9), F.lit("}"))
    return t.predictions().select(
        "id", F.concat(F.lit("s"), text(F.col("snapshot_id") % 12)).alias("slate"), (F.col("player_id") * 1000 + big("line_score")).alias("line_id"), "stat_type", "decision_time",
        F.when(i % 5 != 0, F.col("p_final")).alias("prob_over"), F.when(i % 7 != 0, F.col("p_raw") * 100).alias("rank_score"), F.when(i % 4 != 0, F.col("p_lr")).alias("confidence"),
        details.alias("details"), F.when(i % 6 != 0, "over").alias("pick"))


def logged_top(log, top: int):
    """Latest logged prediction per line, then the diverse top per slate by the stored rank score and the stored confidence,
    missing ones last; gaps are filled from the stored details for what is shown, not for the order."""
    d = J.best_per_key(log, ["slate", "line_id"], ["decision_time", "id"])
    get = lambda f: CO.json_text("details", f)
    p = X.clip(F.coalesce("prob_over", get("p_final").try_cast("double"), num(0.5)), 0.0, 1.0)
    d = d.withColumn("p", p).withColumn("conf", F.coalesce("confidence", X.p_pick("p"))).withColumns({
        "rk": F.coalesce("rank_score", "conf"), "stored": F.struct(F.coalesce("rank_score", num(-1e9)).alias("a"), F.coalesce("confidence", num(-1e9)).alias("b")), "th": F.coalesce(get("selection_threshold").try_cast("double"), num(K.PICK_THRESHOLD))})
    edge = F.coalesce(get("edge").try_cast("double"), F.when(F.col("rk") <= 1.5, F.col("rk") * 100).otherwise(F.col("rk")))
    d = d.withColumns({"edge": F.round(X.clip(edge, 0.0, 100.0), 1), "margin": X.p_pick("p") - F.col("th"), "flag": get("is_publishable")})
    d = d.withColumn("ok", F.when(F.col("flag").isNull(), (F.col("margin") >= 0) & (F.col("edge") >= K.MIN_EDGE)).otherwise(CO.flag_text("flag")))
    d = durable(d.select("slate", "id", "stat_type", "p", "stored", "edge", "margin", "ok", CO.normalize_pick("pick", F.col("p")).alias("side")))
    some = d.groupBy("slate").agg(F.max("ok").alias("_any"))
    pool = d.join(some, "slate").filter(F.col("ok") | ~F.col("_any"))
    out = P.diverse_top(pool, top, "stored")
    return out.select("slate", big("rank").alias("rank"), "id", r6("p").alias("prob_over"), F.col("side").alias("pick"), "edge", X.grade("edge").alias("grade"), r6("margin").alias("margin"), F.col("ok").alias("is_publishable"))


# --- backtest of the combination strategies ----------------------------------------------------------------------
STRATEGIES = {"logit_avg": "ens_logit_avg", "recency_weighted": "ens_recency", "per_stat": "ens_per_stat_best", "top_k": "ens_top_k"}
BT_STATS = ["Points", "Turnovers", "Rebounds", "Dunks", "Assists"]   # the five priorities stand for these measures
PRIORITY_OF = dict(zip(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], BT_STATS))


def _bt_sql() -> str:
    from .q_reports import WINDOWS
    from .registry import CATALOGUE

    st = union_sql([f"SELECT '{n}' AS strategy, {i} AS ord, id, p FROM ({CATALOGUE[q].sql})" for i, (n, q) in enumerate(STRATEGIES.items())])
    measure = q_case(PRIORITY_OF, "rs.stat_type", "rs.stat_type").replace('"', "'")
    agg = f"count(*) AS n, {q_r6('avg(correct)')} AS accuracy, {q_r6('avg(loss)')} AS logloss"
    from .adapters import q_loss

    return f"""WITH {RESOLVED}, {sql_priors('rs')}, st AS ({st}),
j0 AS (SELECT st.strategy, st.ord, st.id, rs.decision_time, {measure} AS measure, rs.over_label, rs.n_eff, rs.conformal_set_size, {', '.join('rs.' + e for e in EX)}, st.p, {sql_prior_of('x').replace('line_score', 'rs.line_score')} AS context_prior
  FROM st JOIN rs ON rs.id = st.id LEFT JOIN cp ON cp.stat_type = rs.stat_type),
j1 AS (SELECT *, CASE WHEN measure = 'Turnovers' THEN context_prior ELSE {q_shrink('p', 'n_eff', 'context_prior')} END AS pf FROM j0 WHERE measure <> 'Dunks'),
j2 AS (SELECT *, {q_hit('pf', 'over_label')} AS correct, {q_loss('over_label', 'pf')} AS loss, {q_pick('pf')} AS pp, {q_edge('pf', EX, 'NULL', 'n_eff', 'NULL', 'NULL', 'CAST(NULL AS DOUBLE)')} AS edge,
   {q_pick('pf')} >= CASE WHEN conformal_set_size = 2 THEN 62e-2 ELSE 6e-1 END AS act FROM j1),
j3 AS (SELECT *, act AND edge >= 5 AND measure <> 'Turnovers' AND conformal_set_size <> 2 AS plc, row_number() OVER (PARTITION BY strategy ORDER BY decision_time DESC, id DESC) AS rn FROM j2),
al AS (SELECT strategy, ord, 'scored' AS slice, '' AS name, {agg} FROM j3 GROUP BY 1, 2 UNION ALL SELECT strategy, ord, 'actionable', '', {agg} FROM j3 WHERE act GROUP BY 1, 2 UNION ALL SELECT strategy, ord, 'placed', '', {agg} FROM j3 WHERE plc GROUP BY 1, 2
 UNION ALL SELECT strategy, ord, 'measure', measure, {agg} FROM j3 GROUP BY 1, 2, 4 UNION ALL SELECT strategy, ord, 'direction', CASE WHEN pf >= 5e-1 THEN 'OVER' ELSE 'UNDER' END, {agg} FROM j3 GROUP BY 1, 2, 4
 UNION ALL SELECT strategy, ord, 'decile', CAST({q_sum([f"CASE WHEN pp > {0.5 + 0.05 * i:.2f}e0 THEN 1 ELSE 0 END" for i in range(1, 10)])} AS VARCHAR), {agg} FROM j3 GROUP BY 1, 2, 4
 {' '.join(f"UNION ALL SELECT strategy, ord, 'window', 'last_{w}', {agg} FROM j3 WHERE rn <= {w} GROUP BY 1, 2 HAVING count(*) = {w}" for w in WINDOWS)} UNION ALL SELECT strategy, ord, 'window', 'all_time', {agg} FROM j3 GROUP BY 1, 2)
SELECT strategy, slice, name, n, accuracy, logloss, slice = 'window' AND row_number() OVER (PARTITION BY slice, name ORDER BY accuracy DESC, ord) = 1 AS best FROM al"""


@query("rep_pipeline_backtest", _bt_sql())
@query("rep_backtest", _bt_sql())
def rep_backtest(t):
    """Every strategy through shrinking and policy, measured by tier, measure, direction, decile and recent window."""
    from pyspark.sql import Window

    from .q_reports import WINDOWS
    from .registry import CATALOGUE

    t._view("rolled", lambda: durable(rolled(t)))   # two strategies start from it
    parts = [CATALOGUE[q].plan(t).select(F.lit(n).alias("strategy"), F.lit(i).alias("ord"), "id", "p") for i, (n, q) in enumerate(STRATEGIES.items())]
    st = parts[0]
    for p in parts[1:]:
        st = st.unionByName(p)
    rows = t.resolved().select("id", "decision_time", "stat_type", "line_score", "over_label", "n_eff", "conformal_set_size", *EX)
    rows = C.context_prior(rows, C.fit_context_priors(t.resolved())).withColumn("measure", X.lookup(PRIORITY_OF, F.col("stat_type"))).filter(~F.col("measure").isin(*K.EXCLUDED_STATS))
    only = F.col("measure").isin(*K.PRIOR_ONLY_STATS)
    j = st.join(rows, "id").withColumn("pf", F.when(only, F.col("context_prior")).otherwise(X.shrink("p", "n_eff", "context_prior")))
    none = F.lit(None).cast("double")
    act = X.p_pick("pf") >= X.threshold_for(num(K.PICK_THRESHOLD), "conformal_set_size")
    j = X.with_edge(j, "pf", EX, none, "n_eff", none, none, none)
    edge = F.col("edge")
    j = j.select("strategy", "ord", "id", "decision_time", "measure", "pf", X.hit("pf", "over_label").alias("correct"), X.log_loss("over_label", "pf").alias("loss"), act.alias("act"),
                 (act & (edge >= K.MIN_EDGE) & ~only & (F.col("conformal_set_size") != 2)).alias("plc"))
    j = durable(j)
    decile = sum(((X.p_pick("pf") > num(round(0.5 + 0.05 * i, 2))).cast("int") for i in range(1, 10)), F.lit(0)).cast("string")
    cut = lambda s, n, when=F.lit(True): F.when(when, F.struct(F.lit(s).alias("slice"), n.alias("name")))
    slices = F.array_compact(F.array(cut("scored", F.lit("")), cut("actionable", F.lit(""), F.col("act")), cut("placed", F.lit(""), F.col("plc")), cut("measure", F.col("measure")),
                                     cut("direction", F.when(F.col("pf") >= 0.5, "OVER").otherwise("UNDER")), cut("decile", decile), cut("window", F.lit("all_time"))))
    agg = [F.count(F.lit(1)).alias("n"), r6(F.avg("correct")).alias("accuracy"), r6(F.avg("loss")).alias("logloss")]
    whole = j.withColumn("s", F.explode(slices)).groupBy("strategy", "ord", "s.slice", "s.name").agg(*agg)
    recent = Window.partitionBy("strategy").orderBy(F.desc("decision_time"), F.desc("id"))
    tail = j.withColumn("rn", F.row_number().over(recent)).filter(F.col("rn") <= max(WINDOWS))   # cut to 200 rows inside each task
    tail = tail.withColumn("w", F.explode(F.filter(F.array(*[F.lit(w) for w in WINDOWS]), lambda w: w >= F.col("rn"))))
    last = tail.groupBy("strategy", "ord", F.lit("window").alias("slice"), "w").agg(*agg).filter(F.col("n") == F.col("w")).withColumn("name", F.concat(F.lit("last_"), F.col("w").cast("string"))).drop("w")
    out = whole.unionByName(last)
    rank = F.row_number().over(Window.partitionBy("slice", "name").orderBy(F.desc("accuracy"), "ord"))   # one row per strategy
    return out.withColumn("best", (F.col("slice") == "window") & (rank == 1)).drop("ord")
