"""Validators, source agreement, freshness, coverage funnel and stored pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, count_true, num, r6
from oddsmill.operators import aggregates as AG
from oddsmill.operators import matching as J
from oddsmill.session import merged
from oddsmill.sources import files as FL
from oddsmill.sources import snapshot_json as SJ

from .adapters import GAME_LOG, LINES, LINE_SNAPSHOTS, PREDICTIONS, q_r6, union_sql
from .q_ingest import payloads, result_docs
from .q_joins import RESOLVE, WORLD, World, resolve_sides
from .q_labels import lab_resolve  # noqa: F401
from .registry import query


@query("qual_payload", f"""WITH {LINE_SNAPSHOTS}, d AS (SELECT snapshot_id, player_id, count(*) AS n FROM ls GROUP BY 1, 2)
SELECT snapshot_id, player_id, CAST(n AS INT) AS n_items, CAST(CASE WHEN player_id % 19 = 0 THEN n ELSE 0 END AS INT) AS missing_line, CAST(CASE WHEN player_id % 23 = 0 THEN n ELSE 0 END AS INT) AS missing_player,
 concat_ws(',', CASE WHEN player_id % 19 = 0 THEN 'all_missing_line' END, CASE WHEN player_id % 23 = 0 THEN 'all_missing_player' END) AS errors, player_id % 19 <> 0 AND player_id % 23 <> 0 AS valid FROM d""")
def qual_payload(t):
    return SJ.payload_issues(SJ.parse(payloads(t)), ["snapshot_id", "player_id"])


@query("qual_resultset", f"""WITH {GAME_LOG} SELECT player_id, player_id % 10 <> 9 AS valid, CASE WHEN player_id % 10 = 8 THEN 'no_rows' END AS warning, CAST(CASE WHEN player_id % 10 >= 8 THEN 0 ELSE count(*) END AS INT) AS rows FROM gl GROUP BY 1""")
def qual_resultset(t):
    return FL.result_issues(result_docs(t), "doc", ["player_id"])


_short = "html IS NULL OR html = ''"


@query("qual_pages", f"""SELECT page_id, CASE WHEN {_short} THEN 'empty' WHEN length(html) < 500 THEN 'too_short' ELSE concat_ws(',', CASE WHEN NOT contains(html, 'pgl_basic') THEN 'no_table' END, CASE WHEN contains(html, 'Rate limit') OR contains(html, '429') THEN 'rate_limited' END) END AS log_errors,
 CASE WHEN length(html) >= 500 AND contains(lower(html), 'did not play') THEN 'did_not_play' END AS log_warnings, CASE WHEN {_short} THEN 'empty' WHEN length(html) < 500 THEN 'too_short' WHEN NOT contains(lower(html), '<table') THEN 'no_table' ELSE '' END AS search_errors,
 CASE WHEN length(html) >= 500 AND (contains(lower(html), 'no results') OR contains(lower(html), 'couldn''t find')) THEN 'no_results' END AS search_warnings FROM pages""")
def qual_pages(t):
    h, low = F.col("html"), F.lower("html")
    long = F.length("html") >= 500
    short = F.when(h.isNull() | (h == ""), "empty").when(~long, "too_short")
    log = F.concat_ws(",", F.when(~h.contains("pgl_basic"), "no_table"), F.when(h.contains("Rate limit") | h.contains("429"), "rate_limited"))
    return t.base("pages").select("page_id", F.coalesce(short, log).alias("log_errors"), F.when(long & low.contains("did not play"), "did_not_play").alias("log_warnings"),
                                  F.coalesce(short, F.when(~low.contains("<table"), "no_table").otherwise("")).alias("search_errors"), F.when(long & (low.contains("no results") | low.contains("couldn't find")), "no_results").alias("search_warnings"))


RULES = {"points_gte_0": "points >= 3e0", "rebounds_gte_0": "rebounds >= 0", "minutes_gte_0": "minutes >= 2", "fg_pct_range": "fgm / nullif(fga, 0) >= 0 AND fgm / nullif(fga, 0) <= 5e-1", "line_gt_0": "assists > 0"}


@query("qual_checks", f"WITH {GAME_LOG} {union_sql([f'''SELECT '{n}' AS rule, count(CASE WHEN NOT ({c}) THEN 1 END) AS violations, count(*) AS rows FROM gl''' for n, c in RULES.items()])}")
def qual_checks(t):
    pct = F.col("fgm") / F.when(F.col("fga") != 0, F.col("fga"))
    rules = {"points_gte_0": F.col("points") >= 3.0, "rebounds_gte_0": F.col("rebounds") >= 0, "minutes_gte_0": F.col("minutes") >= 2, "fg_pct_range": (pct >= 0) & (pct <= 0.5), "line_gt_0": F.col("assists") > 0}
    return AG.rule_counts(t.game_log(), rules)


AGREE = GAME_LOG + """, b AS (SELECT player_id, game_date, CASE WHEN (player_id + day(game_date)) % 7 = 0 THEN points + 1 ELSE points END AS points, rebounds, CASE WHEN day(game_date) % 5 <> 0 THEN assists + CASE WHEN player_id % 10 = 0 THEN 1 ELSE 0 END END AS assists FROM gl WHERE player_id % 3 <> 0),
 j AS (SELECT gl.player_id, gl.game_date, u.stat, u.a, u.b FROM gl JOIN b ON b.player_id = gl.player_id AND b.game_date = gl.game_date, LATERAL (SELECT 'points' AS stat, gl.points AS a, b.points AS b UNION ALL SELECT 'rebounds', gl.rebounds, b.rebounds UNION ALL SELECT 'assists', gl.assists, b.assists) u WHERE u.a IS NOT NULL AND u.b IS NOT NULL),
 m AS (SELECT *, row_number() OVER (PARTITION BY stat ORDER BY player_id, game_date) AS rn FROM j WHERE abs(a - b) > 1e-6)"""


@query("qual_source_agree", f"""WITH {AGREE} SELECT stat, count(*) AS compared, count(CASE WHEN abs(a - b) <= 1e-6 THEN 1 END) AS matches, round(avg(CASE WHEN abs(a - b) <= 1e-6 THEN 1e0 ELSE 0e0 END), 4) AS accuracy, (SELECT count(*) FROM m WHERE m.stat = j.stat AND rn <= 20) AS samples,
 (SELECT CAST(sum(player_id) AS BIGINT) FROM m WHERE m.stat = j.stat AND rn <= 20) AS sample_players FROM j GROUP BY stat""")
def qual_source_agree(t):
    g, p = t.game_log().select("player_id", "game_date", "points", "rebounds", "assists"), F.col("player_id")
    d = F.dayofmonth("game_date")
    other = g.filter(p % 3 != 0).select("player_id", "game_date", F.when((p + d) % 7 == 0, F.col("points") + 1).otherwise(F.col("points")).alias("points"), "rebounds", F.when(d % 5 != 0, F.col("assists") + F.when(p % 10 == 0, 1).otherwise(0)).alias("assists"))
    return source_agreement(g, other, ["player_id", "game_date"], ["points", "rebounds", "assists"])


def source_agreement(a, b, keys, measures, tolerance: float = 1e-6, samples: int = 20):
    """Match rate per measure on shared keys, with the first mismatches (a bounded top-n per measure)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("stat"), F.col(m).alias("a"), F.col(f"_b_{m}").alias("b")) for m in measures]))
    j = a.join(b.select(*keys, *[F.col(m).alias(f"_b_{m}") for m in measures]), keys).select(*keys, pairs.alias("p")).select(*keys, "p.*").dropna(subset=["a", "b"])
    j = j.withColumn("same", F.abs(F.col("a") - F.col("b")) <= tolerance)
    rates = j.groupBy("stat").agg(F.count(F.lit(1)).alias("compared"), count_true(F.col("same")).alias("matches"), F.round(X.share(F.col("same")), 4).alias("accuracy"))
    first = J.first_per_key(j.filter(~F.col("same")), ["stat"], keys, samples).groupBy("stat").agg(F.count(F.lit(1)).alias("samples"), F.sum("player_id").alias("sample_players"))
    return rates.join(first, "stat", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))


@query("qual_freshness", """WITH p AS (SELECT count(DISTINCT o_custkey) AS pending_games FROM orders WHERE o_orderstatus = 'P'), s AS (SELECT count(*) AS stats_rows, count(DISTINCT l_suppkey) AS stats_games FROM lineitem), z AS (SELECT *, CASE WHEN pending_games <= 0 THEN 1e0 ELSE stats_games / CAST(greatest(1, pending_games) AS DOUBLE) END AS ratio FROM p, s)
SELECT pending_games, stats_games, stats_rows, round(ratio, 4) AS coverage_ratio, pending_games >= 2 AS needs_fresh_data, concat_ws(',', CASE WHEN pending_games >= 2 AND stats_rows < 20 THEN 'few_stats_rows' END, CASE WHEN pending_games >= 2 AND ratio < 6e-1 THEN 'low_coverage' END) AS reasons,
 NOT (pending_games >= 2 AND (stats_rows < 20 OR ratio < 6e-1)) AS is_fresh FROM z""")
def qual_freshness(t):
    o, l = t.base("orders"), t.base("lineitem")
    pending = o.filter("o_orderstatus = 'P'").select("o_custkey").distinct().agg(F.count(F.lit(1))).scalar()
    games = l.select("l_suppkey").distinct().agg(F.count(F.lit(1))).scalar()
    z = l.agg(F.count(F.lit(1)).alias("stats_rows"), pending.alias("pending_games"), games.alias("stats_games"))
    n = F.col("pending_games")
    z = z.withColumn("ratio", F.when(n <= 0, num(1)).otherwise(F.col("stats_games") / F.greatest(F.lit(1), n)))
    need = n >= 2
    reasons = F.array_compact(F.array(F.when(need & (F.col("stats_rows") < 20), "few_stats_rows"), F.when(need & (F.col("ratio") < 0.6), "low_coverage")))
    return z.select("pending_games", "stats_games", "stats_rows", F.round("ratio", 4).alias("coverage_ratio"), need.alias("needs_fresh_data"), F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("is_fresh"))


@query("qual_preflight", f"""WITH {WORLD}, {RESOLVE} SELECT 'lines' AS step, count(*) AS n, CAST(min(slate) AS VARCHAR) AS first_day, CAST(max(slate) AS VARCHAR) AS last_day FROM ln
UNION ALL SELECT 'games', count(*), CAST(min(CAST(start_time AS DATE)) AS VARCHAR), CAST(max(CAST(start_time AS DATE)) AS VARCHAR) FROM games UNION ALL SELECT 'official_games', count(*), CAST(min(game_date) AS VARCHAR), CAST(max(game_date) AS VARCHAR) FROM official
UNION ALL SELECT 'matched_games', count(*), NULL, NULL FROM gm UNION ALL SELECT 'mapped_players', count(*), NULL, NULL FROM src JOIN dim ON dim.name_key = src.name_key
UNION ALL SELECT 'lines_with_game', count(*), NULL, NULL FROM ft WHERE game_id IN (SELECT game_id FROM gm) UNION ALL SELECT 'lines_with_stats', count(*), NULL, NULL FROM ft WHERE game_id IN (SELECT game_id FROM gm) AND player_id % 11 <> 0""")
def qual_preflight(t):
    w = World(t)
    src, dim = resolve_sides(t)
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    span = lambda df, step, day: df.agg(F.count(F.lit(1)).alias("n"), text(F.min(day)).alias("first_day"), text(F.max(day)).alias("last_day")).select(F.lit(step).alias("step"), "n", "first_day", "last_day")
    size = lambda df, step: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), "n", none.alias("first_day"), none.alias("last_day"))
    with_game = w.features().select("player_id", "game_id", "slate").join(w.game_map(), "game_id", "left_semi")
    boxes = t.game_log().filter("player_id % 11 <> 0").select("player_id", F.col("game_date").alias("slate"))
    parts = [span(t.lines(), "lines", F.col("slate")), span(w.games, "games", F.to_date("start_time")), span(w.official, "official_games", F.col("game_date")), size(w.game_map(), "matched_games"),
             size(src.join(merged(dim), "name_key"), "mapped_players"), size(with_game, "lines_with_game"), size(with_game.join(merged(boxes), ["player_id", "slate"], "left_semi"), "lines_with_stats")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def game_pages(t):
    """Stored game-log pages: one per player, one table row per day, a repeated header row and two date formats."""
    head = F.lit("<tr><th>Rk</th><th>Date</th><th>PTS</th><th>TRB</th><th>FGA</th></tr>")
    day = F.when(F.col("player_id") % 2 == 0, F.col("game_date").cast("string")).otherwise(F.date_format("game_date", "MMM d, yyyy"))
    cell = lambda c: F.concat(F.lit("<td class='r'>"), c, F.lit("</td>"))
    pts = F.when(F.dayofmonth("game_date") % 11 == 0, "Did Not Play").otherwise(F.col("points").cast("string"))
    row = F.concat(F.lit("<tr>"), cell(F.dayofmonth("game_date").cast("string")), cell(day), cell(F.concat(F.lit("<b>"), pts, F.lit("</b>"))), cell(F.col("rebounds").cast("string")), cell(F.col("fga").cast("string")), F.lit("</tr>"))
    rows = t.game_log().groupBy("player_id").agg(F.array_sort(F.collect_list(F.struct("game_date", row.alias("r")))).alias("_r"))   # at most one entry per day
    body = F.array_join(F.col("_r")["r"], "\n")
    return rows.select("player_id", F.concat(F.lit('<html><table class="x"><tr><td>menu</td></tr></table><table id="pgl_basic">'), head, body, head, F.lit("</table></html>")).alias("html"))


@query("qual_page_gamelog", f"WITH {GAME_LOG} SELECT player_id, CAST(game_date AS VARCHAR) AS game_date, CASE WHEN day(game_date) % 11 <> 0 THEN points END AS pts, rebounds AS reb, fga FROM gl")
def qual_page_gamelog(t):
    rows = FL.page_rows(game_pages(t), "html", ["player_id"])
    g = FL.page_games(rows, ["player_id"])
    return g.select("player_id", F.col("game_date").cast("string").alias("game_date"), F.col("PTS").alias("pts"), F.col("REB").alias("reb"), F.col("FGA").alias("fga"))
