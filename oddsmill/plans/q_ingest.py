"""Sources, sinks, ingest and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.functions import coerce as C
from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.functions.exprs import big, num, r6
from oddsmill.operators import ingest as I
from oddsmill.operators import matching as J
from oddsmill.operators import snapshots as S
from oddsmill.sources import files as FL
from oddsmill.sources import market as MK
from oddsmill.sources import snapshot_json as SJ
from oddsmill.sources.files import scratch_path

from .adapters import EPOCH_DAY, GAME_LOG, LINES, LINE_SNAPSHOTS, MARKET, PREDICTIONS, TEAM_GAMES, pick_from, q_case, q_r6, sql_list, union_sql
from .q_joins import FLAGS, SOURCE_CODES, flagged
from .registry import query

# --- nested snapshot documents: one per (snapshot, player), so a document stays small -----------------------------
ODDS = ["standard", "goblin", "demon", "0", "", "odd"]


def payloads(t):
    ls = t.line_snapshots()
    s, text = F.col("snapshot_id"), lambda c: F.col(c).cast("string")
    ref = lambda kind, ident: F.struct(F.struct(ident.alias("id"), F.lit(kind).alias("type")).alias("data"))
    line = F.struct(
        F.concat_ws("-", text("snapshot_id"), text("player_id"), F.substring("stat_type", 1, 1)).alias("id"), F.lit("projection").alias("type"),
        F.struct(F.when(F.col("player_id") % 19 != 0, text("line_score")).alias("line_score"), F.col("stat_type"), pick_from(ODDS, (s + F.col("player_id")) % 6).alias("odds_type"),
                 F.concat(F.date_format(F.make_date(F.floor((s - 1) / 12).cast("int"), ((s - 1) % 12 + 1).cast("int"), F.lit(2)), "yyyy-MM-dd"), F.lit("T23:30:00Z")).alias("start_time"),
                 F.when(F.col("player_id") % 2 == 0, "yes").otherwise("no").alias("is_live")).alias("attributes"),
        F.struct(F.when(F.col("player_id") % 23 != 0, ref("new_player", text("player_id"))).alias("new_player"),
                 F.struct(F.array(F.struct(F.lit("m1").alias("id"), F.lit("market").alias("type")), F.struct(F.substring("stat_type", 1, 1).alias("id"), F.lit("market").alias("type"))).alias("data")).alias("markets")).alias("relationships"))
    player = F.struct(text("player_id").alias("id"), F.lit("new_player").alias("type"),
                      F.struct(F.concat(F.lit("Player "), text("player_id"), F.lit(" Jr.")).alias("name"), F.when(F.col("player_id") % 5 == 0, "true").alias("combo")).alias("attributes"))
    docs = ls.groupBy("snapshot_id", "player_id").agg(F.collect_list(line).alias("data"), F.first(player).alias("_p"))   # at most one line per measure
    body = F.struct(F.col("data"), F.array("_p").alias("included"))
    return docs.select("snapshot_id", "player_id", F.to_json(body).alias("payload"))


def doc_items(t):
    return SJ.items(SJ.parse(payloads(t)), ["snapshot_id", "player_id"])


_lid = "snapshot_id || '-' || player_id || '-' || substr(stat_type, 1, 1)"


@query("src_json_flatten", f"""WITH {LINE_SNAPSHOTS} SELECT snapshot_id, {_lid} AS id, 'data' AS source, CASE WHEN player_id % 19 <> 0 THEN CAST(line_score AS VARCHAR) END AS line_score, stat_type,
 CASE WHEN player_id % 23 <> 0 THEN CAST(player_id AS VARCHAR) END AS new_player_id, CASE WHEN player_id % 23 <> 0 THEN 'new_player' END AS new_player_type, 'm1,' || substr(stat_type, 1, 1) AS markets_ids, 'market,market' AS markets_types FROM ls""")
def src_json_flatten(t):
    f = SJ.flatten(doc_items(t), "projection", ["line_score", "stat_type"], ["new_player"], ["markets"], ["snapshot_id", "player_id"]).drop("player_id")
    return f.withColumns({"markets_ids": F.array_join("markets_ids", ","), "markets_types": F.array_join("markets_types", ",")})


@query("src_typed_rows", f"""WITH {LINE_SNAPSHOTS} SELECT {_lid} AS id, 'line' AS kind, CASE WHEN player_id % 19 <> 0 THEN line_score END AS line, CASE WHEN player_id % 23 <> 0 THEN CAST(player_id AS VARCHAR) END AS ref,
  player_id % 2 = 0 AS flag, CAST(epoch_us(make_timestamp(CAST((snapshot_id - 1) // 12 AS BIGINT), CAST((snapshot_id - 1) % 12 + 1 AS BIGINT), 2, 23, 30, 0.0)) AS BIGINT) AS start_us, NULL AS name_key
 FROM ls WHERE (snapshot_id + player_id) % 6 IN (0, 3, 4)
 UNION ALL SELECT snapshot_id || '-' || player_id, 'player', NULL, CAST(player_id AS VARCHAR), CASE WHEN player_id % 5 = 0 THEN true END, NULL, 'player' || player_id FROM (SELECT DISTINCT snapshot_id, player_id FROM ls)""")
def src_typed_rows(t):
    rows = doc_items(t)
    keep = ["snapshot_id"]
    lines = SJ.projection_rows(rows, keep).select(F.col("projection_id").alias("id"), F.lit("line").alias("kind"), F.col("line_score").cast("double").alias("line"), F.col("player_id").alias("ref"),
                                                  F.col("is_live").alias("flag"), F.unix_micros("start_time").alias("start_us"), F.lit(None).cast("string").alias("name_key"))
    players = SJ.dimension_rows(rows, "new_player", keep).select(F.concat_ws("-", F.col("snapshot_id").cast("string"), "id").alias("id"), F.lit("player").alias("kind"), F.lit(None).cast("double").alias("line"), F.col("id").alias("ref"),
                                                                 F.col("combo").alias("flag"), F.lit(None).cast("bigint").alias("start_us"), "name_key")
    return lines.unionByName(players)


@query("src_tables", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= DATE '1998-01-01' AND c_mktsegment = 'MACHINERY'")
def src_tables(t):
    o = t.base("orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey", "o_totalprice")
    c = t.base("customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return o.join(c, "o_custkey").select("o_orderkey", "c_name", "o_totalprice")


def result_docs(t):
    """One result-set document per player: headers plus string rows, at most one row per day."""
    g = t.game_log()
    row = F.array(F.col("game_date").cast("string"), F.col("minutes").cast("string"), F.col("points").cast("string"), F.col("team"))
    sets = F.array(F.struct(F.lit("GameLog").alias("name"), F.array(*[F.lit(h) for h in ("GAME_DATE", "MIN", "PTS", "TEAM")]).alias("headers"), F.collect_list(row).alias("rowSet")),
                   F.struct(F.lit("Empty").alias("name"), F.array(F.lit("X")).alias("headers"), F.array().cast("array<array<string>>").alias("rowSet")))
    docs = g.groupBy("player_id").agg(sets.alias("resultSets"))
    hollow = F.transform("resultSets", lambda s: F.struct(s["name"].alias("name"), s["headers"].alias("headers"), F.array().cast("array<array<string>>").alias("rowSet")))
    return docs.select("player_id", F.to_json(F.struct(F.when(F.col("player_id") % 10 != 9, F.when(F.col("player_id") % 10 == 8, hollow).otherwise(F.col("resultSets"))).alias("resultSets"))).alias("doc"))


@query("src_resultset", f"WITH {GAME_LOG} SELECT player_id, CAST(game_date AS VARCHAR) AS game_date, minutes, points, team FROM gl WHERE player_id % 10 < 8")
def src_resultset(t):
    r = FL.result_rows(result_docs(t), "doc", "GameLog", ["player_id"])
    get = lambda k: F.col("row")[k]
    return r.select("player_id", get("GAME_DATE").alias("game_date"), C.parse_double(get("MIN")).alias("minutes"), C.parse_double(get("PTS")).alias("points"), get("TEAM").alias("team"))


@query("src_jsonl", f"WITH {GAME_LOG} SELECT player_id, CAST(game_date AS VARCHAR) AS game_date, points FROM gl")
def src_jsonl(t):
    path = scratch_path(t.spark, "gamelogs")
    t.game_log().select("player_id", "game_date", F.struct("points", "minutes").alias("stats")).write.json(path)
    return FL.read_jsonl(t.spark, path, "player_id bigint, game_date date, stats struct<points:double,minutes:double>").select("player_id", F.col("game_date").cast("string").alias("game_date"), "stats.points")


def calibration_set(t):
    i = F.col("id")
    return t.lines().select("id", "stat_type", F.col("actual").alias("y_true"), F.when(i % 9 == 0, num(float("inf"))).when(i % 9 == 1, num(float("nan"))).otherwise(F.col("line_score")).alias("mu_hat"),
                            F.when(i % 8 == 0, num(0)).otherwise(F.col("minutes")).alias("sigma_hat"))


@query("src_csv_parquet", f"WITH {LINES} SELECT id, actual AS y_true, line_score AS mu_hat, minutes AS sigma_hat, f AS format FROM ln, (SELECT unnest(['csv', 'parquet']) AS f) WHERE id % 9 > 1 AND id % 8 <> 0")
def src_csv_parquet(t):
    root = scratch_path(t.spark, "calibration")
    d = calibration_set(t)
    d.write.option("header", True).csv(f"{root}/csv")
    d.write.parquet(f"{root}/parquet")
    schema = "id bigint, stat_type string, y_true double, mu_hat double, sigma_hat double"
    read = lambda kind: FL.read_calibration(t.spark, f"{root}/{kind}", schema).select("id", "y_true", "mu_hat", "sigma_hat", F.lit(kind).alias("format"))
    return read("csv").unionByName(read("parquet"))


@query("snk_jsonl_csv", f"""WITH {LINE_SNAPSHOTS} SELECT {_lid} AS id, stat_type, CASE WHEN player_id % 19 <> 0 THEN CAST(line_score AS VARCHAR) END AS line_score, '["m1","' || substr(stat_type, 1, 1) || '"]' AS markets_ids FROM ls""")
def snk_jsonl_csv(t):
    """Write a flattened table with a nested column both ways and read the CSV back."""
    f = SJ.flatten(doc_items(t), "projection", ["line_score", "stat_type"], ["new_player"], ["markets"], ["snapshot_id", "player_id"])
    _, csv = FL.write_tables(f, scratch_path(t.spark, "normalised"))
    return t.spark.read.option("header", True).option("escape", '"').csv(csv).select("id", "stat_type", "line_score", "markets_ids")


@query("snk_append_log", "SELECT o_orderkey, o_orderstatus, NULL AS p, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, o_custkey, NULL FROM orders WHERE o_orderkey % 2 = 1")
def snk_append_log(t):
    """Append rows whose columns differ from the stored ones: the log keeps the union of both."""
    o = t.base("orders")
    old = o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return old.unionByName(o.filter("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("p")), allowMissingColumns=True)


# --- dedupe, upsert, insert --------------------------------------------------------------------------------------
@query("ing_dedupe_merge", """SELECT user_id, event_type, arg_max(value, ts) FILTER (WHERE event_id % 3 <> 0) AS value, arg_max(event_id, ts) FILTER (WHERE event_id % 4 <> 1) AS ref FROM events GROUP BY 1, 2""")
def ing_dedupe_merge(t):
    e = t.base("events").select("user_id", "event_type", "ts", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 4 != 1, F.col("event_id")).alias("ref"))
    return I.merge_duplicates(e, ["user_id", "event_type"], ["ts", "event_id"], ["value", "ref"])


OLDNEW = """od AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0),
nw AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name || ' new' END AS c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal + 1 END AS c_acctbal, CASE WHEN c_custkey % 11 <> 0 THEN 'S' || (c_custkey % 9) END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0)"""


def old_new(t):
    c, k = t.base("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), F.col("c_custkey")
    new = c.filter(k % 2 == 0).select("c_custkey", F.when(k % 5 != 0, F.concat("c_name", F.lit(" new"))).alias("c_name"), F.when(k % 7 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"),
                                      F.when(k % 11 != 0, F.concat(F.lit("S"), (k % 9).cast("string"))).alias("c_mktsegment"))
    return c.filter(k % 3 != 0), new


@query("ing_upsert_coalesce", f"WITH {OLDNEW} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, {q_r6('coalesce(n.c_acctbal, o.c_acctbal)')} AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM od o FULL JOIN nw n ON n.c_custkey = o.c_custkey")
def ing_upsert_coalesce(t):
    return I.upsert(*old_new(t), ["c_custkey"]).withColumn("c_acctbal", r6("c_acctbal"))


@query("ing_upsert_mixed", f"WITH {OLDNEW} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, {q_r6('CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END')} AS c_acctbal, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_mktsegment ELSE o.c_mktsegment END AS c_mktsegment FROM od o FULL JOIN nw n ON n.c_custkey = o.c_custkey")
def ing_upsert_mixed(t):
    return I.upsert(*old_new(t), ["c_custkey"], ["c_name"]).withColumn("c_acctbal", r6("c_acctbal"))


@query("ing_insert_ignore", f"WITH {OLDNEW} SELECT c_custkey, c_name FROM od UNION ALL SELECT c_custkey, c_name FROM nw WHERE c_custkey NOT IN (SELECT c_custkey FROM od)")
def ing_insert_ignore(t):
    old, new = old_new(t)
    return I.insert_ignore(old, new, ["c_custkey"]).select("c_custkey", "c_name")


@query("ing_backfill_new", f"""WITH {PREDICTIONS} SELECT id, snapshot_id, p_final AS prob_over, CASE WHEN id % 3 = 0 THEN 'OVER' WHEN p_final IS NOT NULL THEN CASE WHEN p_final >= 5e-1 THEN 'OVER' ELSE 'UNDER' END END AS pick
 FROM (SELECT id, snapshot_id, CASE WHEN id % 10 <> 0 THEN p_final END AS p_final FROM pr) WHERE id % 4 <> 0""")
def ing_backfill_new(t):
    p = t.predictions().select("id", "snapshot_id", F.when(F.col("id") % 10 != 0, F.col("p_final")).alias("prob_over"), F.when(F.col("id") % 3 == 0, "OVER").alias("pick"))
    stored = p.filter("id % 4 = 0")
    fresh = p.join(stored.select("id", "snapshot_id"), ["id", "snapshot_id"], "left_anti")
    return fresh.withColumn("pick", C.normalize_pick("pick", F.col("prob_over")))


@query("ing_dedupe_first", """WITH k AS (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN user_id END AS player, CASE WHEN event_id % 17 <> 0 THEN event_type END AS game, value FROM events)
SELECT player, game, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM k WHERE player IS NOT NULL AND game IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT player, game, event_id, value FROM k WHERE player IS NULL OR game IS NULL""")
def ing_dedupe_first(t):
    i = F.col("event_id")
    e = t.base("events").select(F.when(i % 13 != 0, F.col("user_id")).alias("player"), F.when(i % 17 != 0, F.col("event_type")).alias("game"), "event_id", "value")
    return I.first_keyed(e, ["player", "game"], ["event_id"])


WIDE = GAME_LOG + f""", wd AS (SELECT player_id, 'P' || player_id AS player_name, ({sql_list(SOURCE_CODES)})[CAST(player_id % 30 + 1 AS INT)] AS team, least(player_id % 30, 29 - player_id % 30) * 100000 + {EPOCH_DAY.format('game_date')} AS game_id, game_date,
  minutes, points, rebounds, assists, {EPOCH_DAY.format('game_date')} * 1000000000 + player_id AS seq, (list_position({sql_list(K.TEAMS)}, team) - 1 + day(game_date)) % 2 = 0 AS home FROM gl)"""


def wide_log(t):
    g, i = t.game_log(), F.col("player_id") % 30
    own, opp = pick_from(SOURCE_CODES, i), pick_from(SOURCE_CODES, 29 - i)
    home = (i + F.dayofmonth("game_date")) % 2 == 0
    return g.select("player_id", F.concat(F.lit("P"), F.col("player_id").cast("string")).alias("player_name"), own.alias("team"), (F.least(i, 29 - i) * 100000 + F.unix_date("game_date")).alias("game_id"), "game_date",
                    "minutes", "points", "rebounds", "assists", (F.unix_date("game_date").cast("bigint") * 1000000000 + F.col("player_id")).alias("seq"),
                    F.when(home, F.concat_ws(" vs. ", own, opp)).otherwise(F.concat_ws(" @ ", own, opp)).alias("matchup"))


_own = f"({sql_list(K.TEAMS)})[CAST(player_id % 30 + 1 AS INT)]"
_opp = f"({sql_list(K.TEAMS)})[CAST(29 - player_id % 30 + 1 AS INT)]"
_hm = "(player_id % 30 + day(game_date)) % 2 = 0"


@query("ing_log_split", f"""WITH {WIDE} SELECT 'players' AS tbl, CAST(player_id AS VARCHAR) AS k1, NULL AS k2, min(player_name) AS a, min({_own}) AS b, NULL AS v FROM wd GROUP BY player_id
 UNION ALL SELECT 'games', CAST(game_id AS VARCHAR), CAST(max(game_date) AS VARCHAR), max(CASE WHEN {_hm} THEN {_own} ELSE {_opp} END), max(CASE WHEN {_hm} THEN {_opp} ELSE {_own} END), NULL FROM wd GROUP BY game_id
 UNION ALL SELECT 'stats', CAST(game_id AS VARCHAR), CAST(player_id AS VARCHAR), {_own}, NULL, points FROM wd""")
def ing_log_split(t):
    parts = I.split_game_log(wide_log(t))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("double")
    pl = parts["players"].select(F.lit("players").alias("tbl"), F.col("player_id").alias("k1"), none.alias("k2"), F.col("player_name").alias("a"), F.col("team_code").alias("b"), nothing.alias("v"))
    gm = parts["games"].select(F.lit("games").alias("tbl"), F.col("game_id").alias("k1"), F.col("game_date").cast("string").alias("k2"), F.col("home").alias("a"), F.col("away").alias("b"), nothing.alias("v"))
    st = parts["stats"].select(F.lit("stats").alias("tbl"), F.col("game_id").alias("k1"), F.col("player_id").alias("k2"), F.col("team_code").alias("a"), none.alias("b"), F.col("points").alias("v"))
    return pl.unionByName(gm).unionByName(st)


@query("ing_odds_filter", f"""WITH s AS (SELECT o_orderkey, ({sql_list(ODDS)})[CAST(o_orderkey % 7 + 1 AS INT)] AS o FROM orders)
SELECT o_orderkey, o AS raw, 0 AS odds_type FROM s WHERE o IS NULL OR o IN ('standard', '', '0')""")
def ing_odds_filter(t):
    i = F.col("o_orderkey")
    s = t.base("orders").select("o_orderkey", F.when(i % 7 != 6, pick_from(ODDS, F.least(i % 7, F.lit(5)))).alias("raw"))
    return s.withColumn("odds_type", SJ.odds_code(F.col("raw"))).filter("odds_type = 0")


PURGE = """pj AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderkey % 5 AS INT) END AS odds_type, CASE WHEN o_orderkey % 5 = 3 THEN 'Goblin' WHEN o_orderkey % 5 = 4 AND o_orderkey % 2 = 0 THEN 'standard' END AS raw FROM orders),
ef AS (SELECT *, coalesce(odds_type, CASE lower(coalesce(raw, 'standard')) WHEN 'goblin' THEN 1 WHEN 'demon' THEN 2 ELSE 0 END) AS eff FROM pj)"""


@query("ing_purge_nonstd", f"""WITH {PURGE} SELECT 'before' AS stage, CASE WHEN coalesce(odds_type, 0) = 0 THEN 'standard' WHEN odds_type = 1 THEN 'goblin' WHEN odds_type = 2 THEN 'demon' END AS odds, count(*) AS lines, CAST(NULL AS BIGINT) AS child_rows FROM pj GROUP BY 2
 UNION ALL SELECT 'after', 'standard', count(*), (SELECT count(*) FROM lineitem JOIN ef ON ef.id = l_orderkey WHERE eff = 0) FROM ef WHERE eff = 0""")
def ing_purge_nonstd(t):
    i = F.col("o_orderkey")
    p = t.base("orders").select(i.alias("id"), F.when(i % 5 < 3, (i % 5).cast("int")).alias("odds_type"), F.when(i % 5 == 3, "Goblin").when((i % 5 == 4) & (i % 2 == 0), "standard").alias("raw"))
    before = p.groupBy(I.odds_label(F.col("odds_type"), F.col("raw")).alias("odds")).agg(F.count(F.lit(1)).alias("lines")).select(F.lit("before").alias("stage"), "odds", "lines", F.lit(None).cast("bigint").alias("child_rows"))
    kept = p.filter(I.effective_odds(F.col("odds_type"), F.col("raw")) == 0).withColumn("odds_type", F.lit(0))
    child = t.base("lineitem").select(F.col("l_orderkey").alias("id")).join(kept.select("id"), "id", "left_semi")
    after = kept.agg(F.count(F.lit(1)).alias("lines")).select(F.lit("after").alias("stage"), F.lit("standard").alias("odds"), "lines", child.agg(F.count(F.lit(1))).scalar().alias("child_rows"))
    return before.unionByName(after)


NAMESPACE = "b1d0a6e32f1c4a1b9c359f9f6f0c7c8e"   # fixed value: namespace of snapshot ids
PATHS = "'snapshots/lines_' || strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || '3015.json'"


@query("ing_snapshot_id", f"""WITH p AS (SELECT o_orderkey, {PATHS} AS path, o_orderdate, o_orderkey % 24 AS h FROM orders), s AS (SELECT *, sha1(unhex('{NAMESPACE}') || encode(path)) AS x FROM p)
SELECT o_orderkey, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || ('89ab')[CAST((strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4 + 1 AS INT)] || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS snapshot_id,
 CAST(epoch_us(o_orderdate + to_hours(CAST(h AS INT)) + INTERVAL '30 minutes 15 seconds') AS BIGINT) AS fetched_us FROM s""")
def ing_snapshot_id(t):
    p = t.base("orders").select("o_orderkey", F.concat(F.lit("snapshots/lines_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit("3015.json")).alias("path"))
    stamp = F.to_timestamp(F.regexp_extract("path", r"(\d{8}_\d{6})", 1), "yyyyMMdd_HHmmss")
    return p.select("o_orderkey", I.uuid5(NAMESPACE, F.col("path")).alias("snapshot_id"), F.unix_micros(stamp).alias("fetched_us"))


@query("ing_line_id", "SELECT event_id, substr(sha1('feed|book' || (event_id % 3) || '|' || event_id || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S')), 1, 40) AS line_id FROM events")
def ing_line_id(t):
    e = t.base("events")
    s = F.col("event_id").cast("string")
    return e.select("event_id", MK.stable_id(F.lit("feed"), F.concat(F.lit("book"), (F.col("event_id") % 3).cast("string")), s, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("line_id"))


def odds_docs(t):
    """Odds events over team games: two books per event; spreads, totals and prices as nested markets."""
    g = t.team_games().filter("is_home = 1")
    text = lambda c: c.cast("string")
    out = lambda name, point=None, price=None: F.struct(name.alias("name"), (point if point is not None else F.lit(None).cast("string")).alias("point"), (price if price is not None else F.lit(None).cast("string")).alias("price"))

    def book(i):
        spread = F.when(F.col("fga") % 4 != i, F.round(F.col("fga") - F.col("fta") + num(0.5 + i), 1))
        markets = F.array(
            F.struct(F.lit("spreads").alias("key"), F.array(out(F.lit("Home side"), text(spread)), out(F.lit("away side"), text(-spread))).alias("outcomes")),
            F.struct(F.lit("totals").alias("key"), F.array(out(F.lit("Over"), text(F.round(F.col("points") + 180, 1)))).alias("outcomes")),
            F.struct(F.lit("h2h").alias("key"), F.array(out(F.col("_h"), None, text(F.lit(-110 - i))), out(F.upper("_a"), None, text(F.lit(100 + i)))).alias("outcomes")))
        return F.struct(F.lit(f" Book{i} ").alias("key"), markets.alias("markets"))

    idx = F.array_position(F.array(*[F.lit(x) for x in K.TEAMS]), F.col("team")) - 1
    g = g.withColumns({"_h": pick_from(SOURCE_CODES, idx), "_a": pick_from(SOURCE_CODES, 29 - idx)})
    event = F.struct(F.concat_ws("-", "team", F.col("game_date").cast("string")).alias("id"), F.concat(F.date_add("game_date", 1).cast("string"), F.lit("T02:30:00Z")).alias("commence_time"),
                     F.col("_h").alias("home_team"), F.col("_a").alias("away_team"), F.array(book(0), book(1)).alias("bookmakers"))
    return g.select(F.to_json(event).alias("doc"))


@query("ing_market_parse", f"""WITH {TEAM_GAMES}, b AS (SELECT unnest([0, 1]) AS i), h AS (SELECT *, CASE WHEN fga % 4 <> i THEN round(fga - fta + 5e-1 + i, 1) END AS sp FROM tg, b WHERE is_home = 1)
SELECT team || '-' || CAST(game_date AS VARCHAR) AS event_id, 'book' || i AS book, CAST(game_date AS VARCHAR) AS game_date, {q_case({**{t: t for t in K.TEAMS}, 'PHX': 'PHO'}, 'team', 'team')} AS home, {q_case({**{t: t for t in K.TEAMS}, 'PHX': 'PHO'}, 'opp', 'opp')} AS away,
 sp AS home_spread, -sp AS away_spread, round(points + 180, 1) AS total_points, CAST(-110 - i AS INT) AS home_moneyline, CAST(100 + i AS INT) AS away_moneyline FROM h""")
def ing_market_parse(t):
    return MK.parse_events(odds_docs(t), "doc").withColumn("game_date", F.col("game_date").cast("string"))


def competition_docs(t):
    """The same games in the other event shape: the first entry gives spread and total itself, the second by its closing lines."""
    g = t.team_games().filter("is_home = 1")
    text = lambda c: c.cast("string")
    idx = F.array_position(F.array(*[F.lit(x) for x in K.TEAMS]), F.col("team")) - 1
    team = lambda side, code: F.struct(F.lit(side).alias("homeAway"), F.struct(code.alias("abbreviation")).alias("team"))
    none = F.lit(None).cast("string")
    close = lambda field, value: F.struct(F.struct(value.alias(field)).alias("close"))

    def entry(i):
        spread, total = text(F.round(F.col("fga") - F.col("fta") + num(0.5 + i), 1)), text(F.round(F.col("points") + 180, 1))
        return F.to_json(F.struct(
            F.struct(F.lit(f"Book {i}!").alias("displayName")).alias("provider"), (none if i else spread).alias("spread"), (none if i else total).alias("overUnder"),
            F.struct(close("line", spread if i else none).alias("home")).alias("pointSpread"), F.struct(close("line", F.concat(F.lit("o"), total)).alias("over")).alias("total"),
            F.struct(close("odds", F.lit(str(-110 - i))).alias("home"), close("odds", F.lit(str(100 + i))).alias("away")).alias("moneyline")))

    head = F.to_json(F.struct(F.concat_ws("-", "team", F.col("game_date").cast("string")).alias("id"), F.concat(F.date_add("game_date", 1).cast("string"), F.lit("T02:30:00Z")).alias("date")))
    sides = F.to_json(F.array(team("home", pick_from(SOURCE_CODES, idx)), team("away", pick_from(SOURCE_CODES, 29 - idx))))
    return g.select(F.concat(F.expr("'{'"), F.substring(head, F.lit(2), F.length(head) - 2), F.lit(',"competitions":[{"competitors":'), sides, F.lit(',"odds":['), entry(0), F.lit(","), entry(1), F.lit("]}]}")).alias("doc"))


@query("ing_market_competitions", f"""WITH {TEAM_GAMES}, b AS (SELECT unnest([0, 1]) AS i), h AS (SELECT *, round(fga - fta + 5e-1 + i, 1) AS sp FROM tg, b WHERE is_home = 1)
SELECT team || '-' || CAST(game_date AS VARCHAR) AS event_id, 'feed' AS provider, 'book_' || i AS book, CAST(game_date AS VARCHAR) AS game_date, {q_case({**{t: t for t in K.TEAMS}, 'PHX': 'PHO'}, 'team', 'team')} AS home, {q_case({**{t: t for t in K.TEAMS}, 'PHX': 'PHO'}, 'opp', 'opp')} AS away,
 sp AS home_spread, -sp AS away_spread, round(points + 180, 1) AS total_points, CAST(-110 - i AS INT) AS home_moneyline, CAST(100 + i AS INT) AS away_moneyline FROM h""")
def ing_market_competitions(t):
    return MK.parse_competitions(competition_docs(t), "doc", "feed").drop("source_payload").withColumn("game_date", F.col("game_date").cast("string"))


@query("ing_dunk_count", f"""WITH {GAME_LOG}, s AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS dunks FROM events WHERE event_type = 'click' AND event_id % 2 = 0 AND event_id % 3 <> 0 GROUP BY 1, 2)
SELECT player_id, CAST(game_date AS VARCHAR) AS game_date, CAST(coalesce(dunks, 0) AS BIGINT) AS dunks, fga FROM gl LEFT JOIN s ON s.user_id = gl.player_id AND s.d = gl.game_date""")
def ing_dunk_count(t):
    e, i = t.base("events"), F.col("event_id")
    shots = e.filter("event_type = 'click'").select("user_id", F.to_date("ts").alias("game_date"), F.when(i % 3 != 0, "Driving DUNK Shot").otherwise("Jump Shot").alias("action"), ((i + 1) % 2).alias("made"))
    made = shots.filter(F.lower("action").contains("dunk") & (F.col("made") == 1)).groupBy(F.col("user_id").alias("player_id"), "game_date").agg(F.count(F.lit(1)).alias("dunks"))
    g = t.game_log().select("player_id", "game_date", F.create_map(F.lit("FGA"), F.col("fga").cast("string")).alias("stats"))
    merged = g.join(made, ["player_id", "game_date"], "left").withColumn("stats", F.to_json(F.map_concat("stats", F.create_map(F.lit("DUNKS"), F.coalesce("dunks", F.lit(0)).cast("string")))))
    return merged.select("player_id", F.col("game_date").cast("string").alias("game_date"), F.get_json_object("stats", "$.DUNKS").cast("bigint").alias("dunks"), F.get_json_object("stats", "$.FGA").cast("double").alias("fga"))


FEATS = LINE_SNAPSHOTS + """, ft AS (SELECT ls.*, c_name, c_nationkey, make_timestamp(CAST((snapshot_id - 1) // 12 AS BIGINT), CAST((snapshot_id - 1) % 12 + 1 AS BIGINT), 2, 10, 0, 0.0) AS fetched_at,
  CASE WHEN player_id % 13 <> 0 THEN make_timestamp(CAST((snapshot_id - 1) // 12 AS BIGINT), CAST((snapshot_id - 1) % 12 + 1 AS BIGINT), 2, 10, 0, 0.0) + to_seconds(CAST(player_id * 97 - 3000 AS BIGINT)) END AS start_time FROM ls LEFT JOIN customer ON c_custkey = player_id WHERE (snapshot_id + player_id) % 3 = 0)"""


def snapshot_time(s):
    return F.make_timestamp(F.floor((s - 1) / 12).cast("int"), ((s - 1) % 12 + 1).cast("int"), F.lit(2), F.lit(10), F.lit(0), F.lit(0))


def feature_rows(t):
    p = F.col("player_id")
    pl = t.base("customer").select(F.col("c_custkey").alias("player_id"), "c_name", F.col("c_nationkey").alias("team_id"))
    f = t.line_snapshots().filter((F.col("snapshot_id") + p) % 3 == 0).withColumn("fetched_at", snapshot_time(F.col("snapshot_id")))
    f = f.withColumn("start_time", F.when(p % 13 != 0, F.col("fetched_at") + F.make_dt_interval(secs=p * 97 - 3000)))
    return f.join(pl, "player_id", "left").withColumn("minutes_to_start", I.minutes_between(F.col("start_time"), F.col("fetched_at")))


@query("ing_feature_build", f"WITH {FEATS} SELECT snapshot_id, player_id, stat_type, line_score, c_nationkey AS team_id, CAST(floor((epoch_us(start_time) - epoch_us(fetched_at)) / 60e6) AS BIGINT) AS minutes_to_start FROM ft")
def ing_feature_build(t):
    return feature_rows(t).select("snapshot_id", "player_id", "stat_type", "line_score", "team_id", "minutes_to_start")


@query("ing_append_pred", f"""WITH {PREDICTIONS}, r AS (SELECT CASE WHEN id % 6 = 0 THEN '' WHEN id % 2 = 0 THEN id || '.0' ELSE CAST(id AS VARCHAR) END AS pid, CASE WHEN id % 3 <> 0 THEN p_raw END AS a, p_final AS b, CASE WHEN id % 4 <> 0 THEN decision_time END AS dt, decision_time AS ct,
 (['over', ' Under', 'x', NULL])[CAST(id % 4 + 1 AS INT)] AS pick, CASE WHEN id % 9 <> 0 THEN stat_type ELSE '' END AS st FROM pr)
SELECT regexp_replace(pid, '[.]0$', '') AS projection_id, CAST(epoch_us(coalesce(dt, ct)) AS BIGINT) AS decided_us, coalesce(a, b) AS probability, CASE WHEN upper(trim(pick)) IN ('OVER', 'UNDER') THEN upper(trim(pick)) WHEN coalesce(a, b) >= 5e-1 THEN 'OVER' ELSE 'UNDER' END AS side, nullif(st, '') AS stat_type FROM r WHERE pid <> ''""")
def ing_append_pred(t):
    i, text = F.col("id"), lambda c: c.cast("string")
    raw = t.predictions().select(F.when(i % 6 == 0, "").when(i % 2 == 0, F.concat(text(i), F.lit(".0"))).otherwise(text(i)).alias("projection_id"), F.when(i % 3 != 0, text(F.col("p_raw"))).alias("prob_over"), text(F.col("p_final")).alias("p_final"),
                                 F.when(i % 4 != 0, text(F.col("decision_time"))).alias("decision_time"), text(F.col("decision_time")).alias("created_at"), pick_from(["over", " Under", "x"], F.least(i % 4, F.lit(2))).alias("_p"),
                                 (i % 4 == 3).alias("_none"), F.when(i % 9 != 0, F.col("stat_type")).otherwise("").alias("stat_type"), text(F.col("line_score")).alias("line_score"))
    raw = raw.withColumn("pick", F.when(~F.col("_none"), F.col("_p"))).drop("_p", "_none")
    return I.prediction_rows(raw).select("projection_id", F.unix_micros("decided_at").alias("decided_us"), "probability", "side", "stat_type")


# --- snapshots -------------------------------------------------------------------------------------------------------
SNAPS = LINE_SNAPSHOTS + """, sn AS (SELECT snapshot_id, snapshot_id % 2 AS league, make_timestamp(CAST((snapshot_id - 1) // 12 AS BIGINT), CAST((snapshot_id - 1) % 12 + 1 AS BIGINT), 2, 10, 0, 0.0) AS fetched_at, count(*) AS data_count FROM ls GROUP BY 1),
pv AS (SELECT *, lag(snapshot_id) OVER (PARTITION BY league ORDER BY fetched_at) AS prev FROM sn),
kl AS (SELECT snapshot_id * 1000000000000 + player_id * 10 + CAST(substr(stat_type, 1, 1) AS BIGINT) AS id, snapshot_id, player_id, stat_type, CASE WHEN player_id % 3 <> 0 THEN player_id % 10 END AS game_id, CASE WHEN player_id % 17 <> 0 THEN line_score END AS line_score FROM ls),
mv AS (SELECT c.*, o.line_score AS prev_line, c.line_score - o.line_score AS delta, CASE WHEN c.line_score IS NULL THEN NULL WHEN o.line_score IS NULL THEN 'new' WHEN c.line_score > o.line_score THEN 'up' WHEN c.line_score < o.line_score THEN 'down' ELSE 'same' END AS movement
  FROM kl c JOIN pv ON pv.snapshot_id = c.snapshot_id LEFT JOIN kl o ON o.snapshot_id = pv.prev AND o.player_id = c.player_id AND o.stat_type = c.stat_type AND o.game_id IS NOT DISTINCT FROM c.game_id)"""


def snapshots(t):
    s = F.col("snapshot_id")
    return t.line_snapshots().groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("data_count")).select("snapshot_id", (s % 2).alias("league"), snapshot_time(s).alias("fetched_at"), "data_count")


def keyed_lines(t):
    p = F.col("player_id")
    return t.line_snapshots().select((F.col("snapshot_id") * 1000000000000 + p * 10 + F.substring("stat_type", 1, 1).cast("bigint")).alias("id"), "snapshot_id", "player_id", "stat_type",
                                     F.when(p % 3 != 0, p % 10).alias("game_id"), F.when(p % 17 != 0, F.col("line_score")).alias("line_score"))


def moved(t):
    return S.line_movement(keyed_lines(t), snapshots(t), ["player_id", "stat_type", "game_id"])


@query("snap_prev", f"WITH {SNAPS} SELECT snapshot_id, league, prev AS prev_snapshot_id FROM pv")
def snap_prev(t):
    return S.previous_snapshot(snapshots(t)).select("snapshot_id", "league", "prev_snapshot_id")


@query("snap_line_move", f"WITH {SNAPS} SELECT id, line_score, prev_line, delta, movement FROM mv")
def snap_line_move(t):
    return moved(t).select("id", "line_score", "prev_line", "delta", "movement")


@query("snap_move_counts", f"WITH {SNAPS} SELECT movement, count(*) AS n FROM mv WHERE snapshot_id = (SELECT arg_max(snapshot_id, fetched_at) FROM sn) GROUP BY 1")
def snap_move_counts(t):
    latest = S.latest_of(snapshots(t), "snapshot_id", ["fetched_at"])
    return moved(t).filter(F.col("snapshot_id") == latest).groupBy("movement").agg(F.count(F.lit(1)).alias("n"))


@query("snap_list", f"WITH {SNAPS} SELECT snapshot_id, CAST(epoch_us(fetched_at) AS BIGINT) AS fetched_us, data_count FROM sn ORDER BY fetched_at DESC LIMIT 20")
def snap_list(t):
    return snapshots(t).orderBy(F.desc("fetched_at")).limit(20).select("snapshot_id", F.unix_micros("fetched_at").alias("fetched_us"), "data_count")


@query("snap_for_date", f"""WITH {FEATS} SELECT snapshot_id FROM ft WHERE player_id % 4 <> 1 AND CAST((start_time AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) = DATE '1998-03-02' ORDER BY fetched_at DESC LIMIT 1""")
def snap_for_date(t):
    return S.snapshot_for_date(feature_rows(t).withColumn("odds_type", F.when(F.col("player_id") % 4 == 1, 1)), "1998-03-02")


@query("snap_logged_for_date", f"""WITH {PREDICTIONS} SELECT snapshot_id FROM pr WHERE CAST(((decision_time + to_hours(CAST(id % 24 AS INT))) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) = DATE '1997-06-10' ORDER BY decision_time DESC, id DESC LIMIT 1""")
def snap_logged_for_date(t):
    p = t.predictions().select("id", "snapshot_id", "decision_time", (F.col("decision_time") + F.make_dt_interval(hours=F.col("id") % 24)).cast("timestamp").alias("start"))
    hits = p.filter(J.eastern_date(F.col("start")) == F.lit("1997-06-10").cast("date"))
    return hits.agg(F.max(F.struct("decision_time", "id", "snapshot_id")).alias("m")).select("m.snapshot_id").filter("snapshot_id IS NOT NULL")


@query("snap_latest_per_key", f"WITH {PREDICTIONS} SELECT player_id, stat_type, id, p_final FROM (SELECT *, row_number() OVER (PARTITION BY player_id, stat_type ORDER BY decision_time DESC, id DESC) AS rn FROM pr) WHERE rn = 1")
def snap_latest_per_key(t):
    return J.best_per_key(t.predictions().select("player_id", "stat_type", "decision_time", "id", "p_final"), ["player_id", "stat_type"], ["decision_time", "id"]).drop("decision_time")


@query("snap_recent_summaries", f"""WITH {PREDICTIONS}, h AS (SELECT snapshot_id, max(decision_time) AS seen FROM pr GROUP BY 1 ORDER BY seen DESC, snapshot_id DESC LIMIT 5), l AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, player_id ORDER BY decision_time DESC, id DESC) AS rn FROM pr WHERE snapshot_id IN (SELECT snapshot_id FROM h))
SELECT l.snapshot_id, CAST(epoch_us(max(seen)) AS BIGINT) AS scored_us, count(*) AS total_scored, count(CASE WHEN id % 4 IN (0, 1) THEN 1 END) AS publishable_count, round(count(CASE WHEN id % 4 IN (0, 1) THEN 1 END) / CAST(count(*) AS DOUBLE), 4) AS publishable_ratio FROM l JOIN h ON h.snapshot_id = l.snapshot_id WHERE rn = 1 GROUP BY 1""")
def snap_recent_summaries(t):
    flag = pick_from(['{"is_publishable":"yes"}', '{"is_publishable":true}', '{"is_publishable":"no"}', "{}"], F.col("id") % 4)
    log = t.predictions().select("id", "snapshot_id", F.col("player_id").alias("line_id"), "decision_time", F.coalesce(C.flag_text(C.json_text(flag, "is_publishable")), F.lit(False)).alias("publishable"))
    s = S.recent_summaries(log, 5)
    return s.select("snapshot_id", F.unix_micros(F.col("scored_at").cast("timestamp")).alias("scored_us"), "total_scored", "publishable_count", "publishable_ratio")


@query("snap_scoring_frame", f"""WITH {PREDICTIONS}, {FLAGS} SELECT pr.id, pr.stat_type, pr.line_score, coalesce(nullif(c_name, ''), 'unknown') AS player_name FROM pr JOIN fl ON fl.id = pr.id JOIN customer ON c_custkey = pr.player_id
 WHERE pr.snapshot_id = (SELECT max(snapshot_id) FROM pr) AND (combo IS NULL OR NOT combo) AND (is_live IS NULL OR NOT is_live) AND (in_game IS NULL OR NOT in_game) AND coalesce(today, true) AND (minutes_to_start IS NULL OR minutes_to_start >= 0) AND lower(coalesce(event_type, '')) <> 'combo'""")
def snap_scoring_frame(t):
    from .q_joins import eligible

    p = t.predictions().select("id", "snapshot_id", "player_id", "stat_type", "line_score")
    p = p.filter(F.col("snapshot_id") == p.agg(F.max("snapshot_id")).scalar())
    names = t.base("customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("player_name"))
    return p.join(eligible(flagged(t)).select("id"), "id").join(names, "player_id").select("id", "stat_type", "line_score", F.coalesce(F.nullif("player_name", F.lit("")), F.lit("unknown")).alias("player_name"))
