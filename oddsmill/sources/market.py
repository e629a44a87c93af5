"""Odds events: nested bookmakers and markets to one row per (event, book)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.functions import coerce as C
from oddsmill.functions import constants as K
from oddsmill.functions import exprs as X
from oddsmill.operators.matching import eastern_date

EVENT = ("struct<id:string,commence_time:string,home_team:string,away_team:string,bookmakers:array<struct<key:string,markets:array<struct<key:string,"
         "outcomes:array<struct<name:string,point:string,price:string>>>>>>>")


def stable_id(*parts: Column) -> Column:
    """First forty hex digits of the SHA-1 of the parts joined by a pipe."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 40)


def _outcomes(key: str) -> Column:
    return F.get(F.filter("book.markets", lambda m: m["key"] == key), 0)["outcomes"]


def _last(items: Column) -> Column:
    """Last entry, null when there is none: of several outcomes the last that parses counts."""
    return F.get(items, F.size(items) - 1)


def parse_events(docs: DataFrame, text: str, keep: list[str] = ()) -> DataFrame:
    """One row per (event, book). Events without an id, a time or either team, and books without a key, are left out."""
    filled = lambda c: F.nullif(F.trim(c), F.lit("")).isNotNull()
    e = docs.select(*keep, F.from_json(text, EVENT).alias("e")).filter(filled("e.id") & filled("e.commence_time") & filled("e.home_team") & filled("e.away_team"))
    books = e.select(*keep, "e", F.explode("e.bookmakers").alias("book")).filter(filled("book.key"))
    value = lambda key, field, fits: C.parse_double(_last(F.filter(_outcomes(key), lambda o: fits(o) & C.parse_double(o[field]).isNotNull()))[field])
    named = lambda key, word, field: value(key, field, lambda o: F.upper(o["name"]).contains(word))
    price = lambda team: value("h2h", "price", lambda o: F.upper(F.trim(o["name"])) == F.upper(F.trim(team))).cast("int")
    total = value("totals", "point", lambda o: F.lit(True))
    return books.select(
        *keep, F.trim("e.id").alias("event_id"), F.lower(F.trim("book.key")).alias("book"), eastern_date(C.parse_timestamp("e.commence_time")).alias("game_date"),
        X.team_code("e.home_team", K.MARKET_TEAM_OVERRIDES).alias("home"), X.team_code("e.away_team", K.MARKET_TEAM_OVERRIDES).alias("away"),
        named("spreads", "HOME", "point").alias("home_spread"), named("spreads", "AWAY", "point").alias("away_spread"), total.alias("total_points"),
        price(F.col("e.home_team")).alias("home_moneyline"), price(F.col("e.away_team")).alias("away_moneyline"))


COMPETITIONS = ("struct<id:string,date:string,competitions:array<struct<date:string,competitors:array<struct<homeAway:string,team:struct<abbreviation:string>>>,odds:array<string>>>>")
_close = lambda field: f"struct<close:struct<{field}:string>>"
ODDS = (f"struct<provider:struct<displayName:string,name:string>,spread:string,overUnder:string,pointSpread:struct<home:{_close('line')}>,total:struct<over:{_close('line')}>,"
        f"moneyline:struct<home:{_close('odds')},away:{_close('odds')}>>")


def parse_competitions(docs: DataFrame, text: str, provider: str, keep: list[str] = ()) -> DataFrame:
    """The other event shape, teams and odds under the first competition: one row per (event, odds entry) with its raw
    entry as ``source_payload``. The spread and total of the entry come before those of its closing lines."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    e = docs.select(*keep, F.from_json(text, COMPETITIONS).alias("e")).withColumn("comp", F.get("e.competitions", 0))
    side = lambda name: _last(F.filter(F.col("comp.competitors"), lambda t: (F.lower(F.trim(t["homeAway"])) == name) & blank(t["team"]["abbreviation"]).isNotNull()))["team"]["abbreviation"]
    e = e.select(*keep, blank("e.id").alias("event_id"), eastern_date(C.parse_timestamp(F.coalesce(blank("comp.date"), "e.date"))).alias("game_date"),
                 X.team_code(side("home"), K.MARKET_TEAM_OVERRIDES).alias("home"), X.team_code(side("away"), K.MARKET_TEAM_OVERRIDES).alias("away"), F.explode("comp.odds").alias("source_payload"))
    e = e.dropna(subset=["event_id", "game_date", "home", "away", "source_payload"]).withColumn("o", F.from_json("source_payload", ODDS))
    shown = F.coalesce(blank("o.provider.displayName"), blank("o.provider.name"), F.lit("espn"))
    book = F.coalesce(blank(F.regexp_replace(F.regexp_replace(F.lower(shown), "[^a-z0-9]+", "_"), "^_+|_+$", "")), F.lit("espn"))
    spread = F.coalesce(C.parse_double("o.spread"), C.parse_double("o.pointSpread.home.close.line"))
    total = F.coalesce(C.parse_double("o.overUnder"), C.parse_double(F.regexp_replace(F.trim("o.total.over.close.line"), "^[^0-9.-]+", "")))
    price = lambda team: C.parse_double(f"o.moneyline.{team}.close.odds").cast("int")
    return e.select(*keep, "event_id", F.lit(provider).alias("provider"), book.alias("book"), "game_date", "home", "away", spread.alias("home_spread"), (-spread).alias("away_spread"),
                    total.alias("total_points"), price("home").alias("home_moneyline"), price("away").alias("away_moneyline"), "source_payload")
