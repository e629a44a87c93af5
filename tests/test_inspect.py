"""Payloads without a known schema: counts against plain Python, odd payloads included."""

import json
from collections import Counter

from oddsmill.sources import inspect as IN

DOCS = [
    {"data": [{"id": "1", "type": "projection", "attributes": {"line_score": 1.5, "new": None}, "relationships": {"new_player": {"data": {"id": "7"}}, "markets": {"data": []}, "game": {"data": None}}},
              {"id": "1", "type": "projection", "attributes": {}, "relationships": {}}, {"id": None, "attributes": None}],
     "included": [{"id": "7", "type": "new_player", "attributes": {"name": "x"}}], "links": {"self": "u"}, "meta": {"page": 1}},
    {"data": [], "other": 3},
    {"data": [{"id": str(i), "type": "projection", "relationships": {"league": 5}} for i in range(2, 6)]},
]


def tables(spark):
    texts = [json.dumps(d) for d in DOCS] + [None, "", "no json", "[1, 2]", "{}"]
    return spark.createDataFrame([(t, "v") for t in texts], "payload string, v string")


def test_inspect(spark):
    got = {(r.section, r.type, r.part, r.name): r.n for r in IN.inspect(tables(spark)).collect()}
    want = Counter()
    for d in DOCS:
        want.update(("payload", None, "top_level", k) for k in d)
        want.update(("payload", None, f"{p}_key", k) for p, at in (("links", "links"), ("meta", "meta")) for k in d.get(at, {}))
        for section in IN.SECTIONS:
            for item in d.get(section, []):
                kind = item.get("type", "unknown")
                want[section, kind, "total", "items"] += 1
                want.update((section, kind, "attribute", k) for k in item.get("attributes") or {})
                for k, v in (item.get("relationships") or {}).items():
                    data = v.get("data") if isinstance(v, dict) else None
                    shape = {type(None): "null", list: "list", dict: "object"}[type(data)]
                    want[section, kind, f"relationship:{shape}", k] += 1
    samples = {k: n for k, n in got.items() if k[2] == "sample_id"}
    assert {k: n for k, n in got.items() if k[2] != "sample_id"} == dict(want)
    assert {k[3]: n for k, n in samples.items() if k[1] == "projection"} == {"1": 2, "2": 1, "3": 1}


def test_audit(spark):
    got = {(r.section, r.part, r.name): r.n for r in IN.audit(tables(spark)).collect()}
    data = [i for d in DOCS for i in d.get("data", [])]
    assert got["data", "items", "total"] == len(data) and got["included", "items", "total"] == 1
    for k in IN.REQUIRED["data"]:
        assert got["data", "required_missing", k] == sum(i.get(k) is None for i in data)
    for k in IN.LINE_ATTRIBUTES:
        assert got["data", "attribute_null", k] == sum((i.get("attributes") or {}).get(k) is None for i in data)
    for k in IN.LINE_RELATIONSHIPS:
        rel = [(i.get("relationships") or {}).get(k) for i in data]
        assert got["data", "relationship_missing", k] == sum(not isinstance(r, dict) or r.get("data") is None for r in rel)
    assert got["data", "duplicates", "id,type"] == 1 and got["data", "type", "unknown"] == 1 and got["included", "type", "new_player"] == 1
    assert IN.audit(tables(spark).limit(0)).count() == 0


def test_items_are_taken_apart_once(spark, monkeypatch):
    """The counts, the ids among them, come from one pass over the items."""
    stored, keep = [], IN.durable
    monkeypatch.setattr(IN, "durable", lambda df: stored.append(df) or keep(df))
    out = IN.inspect(tables(spark))
    assert len(stored) == 1 and "sample_id" in {r.part for r in stored[0].collect()}
    assert {r.n for r in out.filter("part = 'sample_id' AND name = '1'").collect()} == {2}
