"""Odds events: the last outcome that parses counts, incomplete events are left out, both event shapes."""

import json

from oddsmill.sources import market as MK


def frame(spark, docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")


def test_last_parsing_outcome_counts(spark):
    spreads = {"key": "spreads", "outcomes": [{"name": "Home", "point": "1.5"}, {"name": "home", "point": "2.5"}, {"name": "HOME", "point": "none"}, {"name": "away", "point": None}]}
    prices = {"key": "h2h", "outcomes": [{"name": "BOS", "price": "-120"}, {"name": " bos ", "price": "-125"}, {"name": "NYK", "price": "x"}]}
    event = {"id": "e1", "commence_time": "2024-01-02T02:30:00Z", "home_team": "BOS", "away_team": "NYK", "bookmakers": [{"key": "A", "markets": [spreads, prices]}, {"key": " ", "markets": []}]}
    blank = [{**event, "id": "e2", "home_team": " "}, {**event, "id": "e3", "commence_time": ""}, {**event, "id": ""}, {**event, "id": "e4", "away_team": None}]
    rows = MK.parse_events(frame(spark, [event, *blank]), "doc").collect()
    assert [(r.event_id, r.book, str(r.game_date), r.home_spread, r.away_spread, r.total_points, r.home_moneyline, r.away_moneyline) for r in rows] == [("e1", "a", "2024-01-01", 2.5, None, None, -125, None)]


def test_competitions(spark):
    sides = [{"homeAway": "Home", "team": {"abbreviation": "BOS"}}, {"homeAway": "away", "team": {"abbreviation": "NYK"}}]
    odds = [{"spread": -3.5, "overUnder": "220.5"}, {"provider": {"name": "Big Book!"}, "spread": "x", "pointSpread": {"home": {"close": {"line": "+4"}}}, "total": {"over": {"close": {"line": "o221"}}}, "moneyline": {"home": {"close": {"odds": "EVEN"}}, "away": {"close": {"odds": "-110"}}}}]
    event = {"id": " g1 ", "date": "2024-01-02T02:30:00Z", "competitions": [{"competitors": sides, "odds": odds}, {"competitors": [], "odds": odds}]}
    other = [{"id": "g2", "competitions": []}, {"id": "g3", "date": "2024-01-02T02:30:00Z", "competitions": [{"competitors": sides[:1], "odds": odds}]}, {"id": "g4", "competitions": [{"competitors": sides, "odds": odds}]}]
    rows = MK.parse_competitions(frame(spark, [event, *other]), "doc", "feed").orderBy("book").collect()
    got = [(r.event_id, r.provider, r.book, str(r.game_date), r.home_spread, r.away_spread, r.total_points, r.home_moneyline, r.away_moneyline) for r in rows]
    assert got == [("g1", "feed", "big_book", "2024-01-01", 4.0, -4.0, 221.0, None, -110), ("g1", "feed", "espn", "2024-01-01", -3.5, 3.5, 220.5, None, None)]
    assert json.loads(rows[1].source_payload) == odds[0]
