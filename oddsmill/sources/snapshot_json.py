"""Nested line snapshots (``data``/``included`` items with attributes and relationships) as flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import coerce as C
from oddsmill.functions import constants as K
from oddsmill.functions import names as N

ITEM = "struct<id:string,type:string,attributes:map<string,string>,relationships:map<string,string>>"
PAYLOAD = f"struct<data:array<{ITEM}>,included:array<{ITEM}>,links:map<string,string>,meta:map<string,string>>"
REFS = "array<struct<id:string,type:string>>"


def parse(docs: DataFrame, text: str = "payload") -> DataFrame:
    """Adds ``doc``: the parsed payload. Attribute and relationship values stay JSON text until they are asked for."""
    return docs.withColumn("doc", F.from_json(text, PAYLOAD))


def items(docs: DataFrame, keep: list[str] = (), data: bool = True, included: bool = True) -> DataFrame:
    """One row per item of both lists, with its source list and position."""
    parts = []
    for source, wanted in (("data", data), ("included", included)):
        if wanted:
            parts.append(docs.select(*keep, F.lit(source).alias("source"), F.posexplode(F.col(f"doc.{source}")).alias("position", "item")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*keep, "source", "position", F.col("item.id").alias("id"), F.coalesce("item.type", F.lit("unknown")).alias("type"),
                      F.col("item.attributes").alias("attributes"), F.col("item.relationships").alias("relationships"))


def attribute(name: str) -> Column:
    return F.col("attributes")[name]


def related(name: str, field: str = "id") -> Column:
    """Id or type of a to-one relationship; null when the data is null or a list."""
    return F.get_json_object(F.col("relationships")[name], f"$.data.{field}")


def related_list(name: str) -> Column:
    """Entries of a to-many relationship."""
    return F.from_json(F.get_json_object(F.col("relationships")[name], "$.data"), REFS)


def flatten(rows: DataFrame, kind: str, attributes: list[str], one: list[str] = (), many: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Flat table of one item type. Repeated ids merge: per column the last non-null value wins (included after data)."""
    cols = {a: attribute(a) for a in attributes}
    for r in one:
        cols |= {f"{r}_id": related(r), f"{r}_type": related(r, "type")}
    for r in many:
        cols |= {f"{r}_ids": related_list(r)["id"], f"{r}_types": related_list(r)["type"]}
    key = F.coalesce(F.nullif("id", F.lit("")), F.concat_ws("_", "source", "type", F.col("position").cast("string")))
    flat = rows.filter(F.col("type") == kind).select(*keep, "source", "position", "id", key.alias("key"), *[v.alias(k) for k, v in cols.items()])
    place = F.struct(F.when(F.col("source") == "data", 0).otherwise(1).alias("s"), F.col("position"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    return flat.groupBy(*keep, "key").agg(last("id"), last("source"), *[last(c) for c in cols]).drop("key")


def odds_code(raw: Column) -> Column:
    """Text or numeric odds type as a code; missing means standard, an unknown text is null."""
    t = F.lower(F.trim(raw))
    named = F.coalesce(*[F.when(t == k, v) for k, v in K.ODDS_CODES.items()])
    return F.when(raw.isNull() | (t == ""), 0).otherwise(F.coalesce(named, C.parse_int(raw).cast("int")))


def projection_rows(rows: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Typed line rows of standard odds."""
    a = attribute
    ids = {n: related(r) for n, r in {"league_id": "league", "player_id": "new_player", "stat_type_id": "stat_type", "projection_type_id": "projection_type",
                                      "game_id": "game", "duration_id": "duration"}.items()}
    text = ["status", "stat_type", "stat_display_name", "projection_type", "description", "event_type", "group_key", "tv_channel"]
    out = rows.filter((F.col("source") == "data")).select(
        *keep, F.col("id").alias("projection_id"), *[v.alias(k) for k, v in ids.items()],
        *[C.parse_decimal(a(n)).alias(n) for n in ("line_score", "adjusted_odds", "discount_percentage", "flash_sale_line_score")],
        odds_code(a("odds_type")).alias("odds_type"), *[C.parse_int(a(n)).alias(n) for n in ("rank", "trending_count")],
        *[a(n).alias(n) for n in text], *[C.parse_timestamp(a(n)).alias(n) for n in ("start_time", "board_time", "end_time", "updated_at")],
        *[C.parse_bool(a(n)).alias(n) for n in ("is_promo", "is_live", "is_live_scored", "in_game", "today", "refundable")],
        F.to_json("attributes").alias("attributes"), F.to_json("relationships").alias("relationships"))
    return out.filter(F.col("odds_type") == 0)


# included item type -> (text, integer, boolean, time attributes, to-one relationships)
DIMENSIONS = {
    "new_player": (["name", "display_name", "team", "team_name", "position", "market", "jersey_number", "image_url", "league_id", "league"], [], ["combo"], [], {"team_id": "team_data"}),
    "team": (["abbreviation", "market", "name", "primary_color", "secondary_color", "tertiary_color"], [], [], [], {}),
    "stat_type": (["name", "lfg_ignored_leagues"], ["rank"], [], [], {}),
    "game": (["status", "external_game_id", "metadata"], [], ["is_live"], ["start_time", "end_time", "created_at", "updated_at"], {"home_team_id": "home_team_data", "away_team_id": "away_team_data"}),
    "projection_type": (["name"], [], [], [], {}),
    "league": (["name", "icon", "image_url", "parent_id", "parent_name", "league_icon_id"], ["rank", "projections_count"], ["active", "f2p_enabled", "has_live_projections", "last_five_games_enabled", "show_trending"], [], {}),
    "duration": (["name"], [], [], [], {}),
}


def dimension_rows(rows: DataFrame, kind: str, keep: list[str] = ()) -> DataFrame:
    """Typed rows of one included item type."""
    text, ints, flags, times, refs = DIMENSIONS[kind]
    cols = [attribute(n).alias(n) for n in text] + [C.parse_int(attribute(n)).alias(n) for n in ints] + [C.parse_bool(attribute(n)).alias(n) for n in flags]
    cols += [C.parse_timestamp(attribute(n)).alias(n) for n in times] + [related(r).alias(n) for n, r in refs.items()]
    if kind == "new_player":
        cols.append(N.name_key(attribute("name")).alias("name_key"))
    return rows.filter((F.col("source") == "included") & (F.col("type") == kind)).select(*keep, "id", *cols)


def payload_issues(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Missing lines and players per document, with the validity verdict."""
    size = F.coalesce(F.size("doc.data"), F.lit(0))
    bad = lambda test: F.size(F.filter("doc.data", test))
    no_line = bad(lambda i: i["attributes"]["line_score"].isNull())
    player = lambda i: F.coalesce(i["relationships"]["new_player"], i["relationships"]["player"])
    no_player = bad(lambda i: F.nullif(F.get_json_object(player(i), "$.data.id"), F.lit("")).isNull())
    d = docs.select(*keep, size.alias("n_items"), no_line.alias("missing_line"), no_player.alias("missing_player"))
    n = F.col("n_items")
    errors = F.array_compact(F.array(F.when(n <= 0, "empty"), F.when((n > 0) & (F.col("missing_line") == n), "all_missing_line"), F.when((n > 0) & (F.col("missing_player") == n), "all_missing_player")))
    return d.withColumns({"errors": F.array_join(errors, ","), "valid": F.size(errors) == 0})
