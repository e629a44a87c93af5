"""SQL twins of the dealt operators that SQL can express, for DuckDB."""

from __future__ import annotations

from .tables import LOWER, UPPER
from .url_filter import CANONICAL, HREF, REFRESH, RULES, TAGS, TARGET


def q_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def q_lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def q_get(x: str, pattern: str) -> str:
    return f"regexp_extract({x}, {q_text(pattern)}, 1)"


SITE, HOST, PATH = r"(?s)^(.*?://[^/?#]*)", r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"


def q_node(u: str) -> str:
    return f"CASE WHEN contains({u}, '://') THEN {q_lower(q_get(u, SITE))} || {q_get(u, r'(?s)^.*?://[^/?#]*([^#]*)')} END"


_resolved = f"""CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN starts_with(l, '//') THEN {q_get('url', '^([^/?#]*?:)//')} || l WHEN starts_with(l, '/') THEN {q_get('url', SITE)} || l
 WHEN starts_with(l, '?') THEN {q_get('url', r'(?s)^(.*?://[^/?#]*[^?#]*)')} || l WHEN starts_with(l, '#') THEN url WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
 ELSE {q_get('url', SITE)} || coalesce(nullif({q_get('url', r'(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)')}, ''), '/') || l END"""

URL_FILTER = f"""WITH RECURSIVE rl(verdict, host, path) AS (VALUES {', '.join(str(r) for r in RULES)}),
pg AS (SELECT page_id, url, {q_node('url')} AS node, coalesce(html, '') AS html FROM pages),
tg AS (SELECT url, node, unnest(list_transform(regexp_extract_all(html, {q_text(TAGS)}), lambda x: regexp_replace(x, '\\s+', ' ', 'g'))) AS tag FROM pg WHERE node IS NOT NULL),
lk AS (SELECT url, node, nullif(trim(replace(CASE WHEN regexp_matches(tag, {q_text(CANONICAL)}) THEN {q_get('tag', HREF)} WHEN regexp_matches(tag, {q_text(REFRESH)}) THEN {q_get('tag', TARGET)} END, '&amp;', '&')), '') AS l FROM tg),
tr AS (SELECT node AS a, {_resolved} AS t FROM lk WHERE l IS NOT NULL), ed AS (SELECT DISTINCT a, {q_node('t')} AS b FROM tr),
bi AS (SELECT a, b FROM ed WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM ed WHERE b IS NOT NULL AND a <> b), rc(x, y) AS (SELECT a, b FROM bi UNION SELECT rc.x, bi.b FROM rc JOIN bi ON bi.a = rc.y),
us AS (SELECT DISTINCT u, {q_lower(q_get('u', HOST))} AS host, {q_get('u', PATH)} AS path FROM (SELECT coalesce(url, '') AS u FROM pages UNION SELECT x FROM rc)),
ru AS (SELECT u, arg_max(rl.host || rl.path, (length(rl.host || rl.path), rl.host || rl.path)) AS rule, arg_max(verdict, (length(rl.host || rl.path), rl.host || rl.path)) AS verdict FROM us JOIN rl ON (us.host = rl.host OR ends_with(us.host, '.' || rl.host)) AND starts_with(us.path, rl.path) GROUP BY u),
sp AS (SELECT rc.x, CASE WHEN bool_or(ru.verdict = 'allow') THEN 'allow' WHEN bool_or(ru.verdict = 'block') THEN 'block' END AS spread FROM (SELECT x, y FROM rc UNION SELECT x, x FROM rc) rc JOIN ru ON ru.u = rc.y GROUP BY rc.x)
SELECT page_id, us.host, us.path, ru.rule, coalesce(ru.verdict, sp.spread, 'allow') AS verdict FROM pg JOIN us ON us.u = coalesce(pg.url, '') LEFT JOIN ru ON ru.u = us.u LEFT JOIN sp ON sp.x = pg.node"""

NORMALISED = q_lower("coalesce(text, '')")
EXACT_DEDUP = f"""WITH d AS (SELECT doc_id, sha256({NORMALISED}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

_draw = lambda k: f"CAST('0x' || substr(x, {8 * k - 7}, 8) AS BIGINT)"
_part = lambda a, b: f"array_to_string(u[{a} + 1:{b}], '')"
FILL_IN_MIDDLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
c AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, {_draw(1)} AS h1, {_draw(2)} AS h2, {_draw(3)} AS h3, {_draw(4)} AS h4 FROM d),
f AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, {_part('0', 'lo')} AS pre, {_part('lo', 'hi')} AS mid, {_part('hi', 'n')} AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(pre || mid || suf) AS restored_sha256 FROM p"""


def q_whole(scale: int, others: str = "") -> str:
    fine = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS w{others} FROM embeddings WHERE {fine}"


_product = lambda a, b: f"CAST(coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT)"
MAX_SCORE = f"""WITH v AS ({q_whole(1024)}), s AS (SELECT q.vec_id AS query_id, c.vec_id, {_product('q.w', 'c.w')} AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 10"""
HARD_NEGATIVES = f"""WITH v AS ({q_whole(256, ', CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label')}), l AS (SELECT * FROM v WHERE label IS NOT NULL),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, {_product('q.w', 'c.w')} AS score FROM l q JOIN l c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10"""

ORACLE_SQL = {"op6_url_filter": URL_FILTER, "op10_exact_dedup": EXACT_DEDUP, "op11_fill_in_middle": FILL_IN_MIDDLE, "op12_max_score": MAX_SCORE, "op13_hard_negatives": HARD_NEGATIVES}
