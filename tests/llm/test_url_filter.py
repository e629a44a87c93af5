import re

from oddsmill.llm import registry, url_filter

SHAPE = "page_id bigint, url string, html string, host string, verdict string, path string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :])[0]


def rule_of(url, rules=url_filter.RULES):
    host, path = split(url)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_on_all_pages_match_plain_python(spark):
    folder = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()}
    rows = registry.op6_url_filter(spark, folder).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rule, verdict = rule_of(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (*split(urls[r.page_id]), rule)
        assert verdict in (None, r.verdict)


def canonical(href):
    return f'<html><LINK class=x href="{href}"\n rel="canonical"><body>'


def refresh(href):
    return f'<meta http-equiv="Refresh" content="0; url={href}">'


PAGES = [
    (1, "http://a.org/x", canonical("http://bad.net/y")),  # an alias of a blocked url
    (2, "http://b.org/1", refresh("/2")), (3, "http://b.org/2", canonical("3?k=1&amp;j")), (4, "http://B.org/3?k=1&j#frag", canonical("//c.example.com/de/z")),  # a chain to a blocked url
    (5, "http://example.net/en/q", canonical("http://d.org/w")), (6, "http://d.org/w", canonical("http://bad.net/y2")),  # an allow rule in the group comes before the block
    (7, "http://e.org/fr/1", refresh("http://bad.net/")),  # its own rule allows it
    (8, "http://f.net/", canonical("http://g.org/free")), (9, "http://g.org/free", None),  # blocked by its own rule, and the url it names follows
    (10, None, canonical("http://bad.net/y")), (11, "no scheme", ""), (12, "http://h.org", canonical("#top")), (13, "http://h.org/", canonical("mailto:x@y")),
    (14, "http://a.org/x", None), (14, "http://a.org/x", None), (None, "HTTP://X.EXAMPLE.NET/en/", ""), (15, "http://net/?", ""), (16, "http://notnet/a", ""), (17, "http://x.net", ""),
]
VERDICTS = {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "allow", 11: "allow", 12: "allow", 13: "allow", 14: "block", None: "allow", 15: "block", 16: "allow", 17: "allow"}


def test_decisions_reach_aliases(spark):
    pages = spark.createDataFrame([(*p, "h", "v", "p") for p in PAGES], SHAPE)
    rows = url_filter.judge(pages).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in rows) == sorted((p[0] or 0, VERDICTS[p[0]]) for p in PAGES)
    for r in rows:
        if r.page_id:
            url = dict((p[0], p[1]) for p in PAGES)[r.page_id]
            assert (r.host, r.path) == split(url) and r.rule == rule_of(url)[0]


def test_sql_twin_follows_aliases_too(spark):
    import duckdb
    import pandas as pd

    from oddsmill.llm.oracles import URL_FILTER

    con = duckdb.connect()
    con.register("pages", pd.DataFrame([p[:3] for p in PAGES], columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    want = sorted(map(str, con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({URL_FILTER})").fetchall()))
    got = url_filter.judge(spark.createDataFrame([(*p, "h", "v", "p") for p in PAGES], SHAPE)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_redirect_tables_rule_tables_and_defaults(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "", "", "", ""), (2, "http://b.org/", "", "", "", ""), (3, "http://q.org/zz", "", "", "", "")], SHAPE)
    redirects = spark.createDataFrame([("http://a.org/", "http://t.co/1"), ("http://t.co/1", "http://bad.xyz/p"), (None, "http://b.org/"), ("http://b.org/", "http://b.org/")], "source string, target string")
    rules = [("block", "bad.xyz", "/"), ("block", "org", "/z"), ("allow", "q.org", "/zz"), ("allow", "q.org", "/z")]
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, redirects, default="block").collect()}
    assert out == {1: (None, "block"), 2: (None, "block"), 3: ("q.org/zz", "allow")}
    assert {r.verdict for r in url_filter.judge(pages.where("page_id = 2"), rules, redirects).collect()} == {"allow"}


def test_no_pages(spark):
    assert url_filter.judge(spark.createDataFrame([], SHAPE)).count() == 0
