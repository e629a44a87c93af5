"""URL filter: host and path rules, and block decisions that spread over redirect and canonical-link aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.session import durable

from .components import connected_components
from .tables import LOWER, UPPER, ascii_lower

#: (verdict, host, path). A rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

TAGS = r"(?i)<(?:link|meta)\b[^>]*>"
CANONICAL, HREF = r"(?i)^<link\b.*\brel\s*=\s*[\"']?canonical\b", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH, TARGET = r"(?i)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b", r"(?is)\burl\s*=\s*([^\"'\s>;]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#``
    or the end. Both are empty for null and where there is no ``://``."""
    text = F.coalesce(url, F.lit(""))
    host = ascii_lower(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1))
    return host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """The url as a name of a page: scheme and host lower-cased, no fragment; null if there is no ``://``."""
    parts = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(F.translate(parts, UPPER, LOWER), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def resolved(base: Column, href: Column) -> Column:
    """``href`` as an absolute url: with a scheme as it is, ``//host``, ``/path`` and ``?query`` against ``base``, others
    beside the last part of its path. Null or empty: null."""
    link = F.nullif(F.trim(F.replace(href, F.lit("&amp;"), F.lit("&"))), F.lit(""))
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*[^?#]*)", 1)
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(base, r"(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/")))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^/?#]*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(site, link)).when(link.startswith("?"), F.concat(page, link)).when(link.startswith("#"), base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string")).otherwise(F.concat(folder, link))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b)``: canonical links and refresh redirects that the pages themselves declare. Null html declares none."""
    base = F.col(url_col)
    tags = F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(TAGS), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", " "))
    links = F.transform(tags, lambda x: F.when(x.rlike(CANONICAL), F.regexp_extract(x, HREF, 1)).when(x.rlike(REFRESH), F.regexp_extract(x, TARGET, 1)))
    found = pages.select(base.alias("base"), node(base).alias("a"), F.explode(links).alias("link")).where("link IS NOT NULL")
    found = found.select("a", node(resolved(F.col("base"), F.col("link"))).alias("b"))
    return found.where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(v, h, p, h + p) for v, h, p in rules], "rule_verdict string, rule_host string, rule_path string, rule string")


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(url, ..)``, one row per url, with ``host``, ``path`` and the longest ``rule`` that fits with its
    ``rule_verdict`` (null: none). Of equally long ones the later in the alphabet counts.

    The host's suffixes join the rules by equality; a rule table of any size can be given. Each distinct host and path
    is looked up once, however many pages have it."""
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumn("host", host).withColumn("path", path)
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    spots = urls.select("host", "path").distinct().withColumn("rule_host", F.explode(ends))
    best = F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "rule")).alias("best")
    fit = spots.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(best)
    return urls.join(fit, ["host", "path"], "left").select(*urls.columns, "best.rule", "best.rule_verdict")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, default: str = "allow", key: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict, alias`` of every page.

    A page's own rule decides first. A page without one takes the decision of its aliases, the urls connected with its
    own over redirects (``redirects(source, target)``, and refresh tags) and canonical links: allow if a rule allows one
    of them, else block if a rule blocks one, else ``default``. Urls that are only linked to are aliases too and meet
    the rules. ``alias`` names the alias group (its smallest url; null: none). Urls are compared without
    fragments. A null url, or one without ``://``, has no host, no rule and no alias. Repeated pages are
    returned as often as they occur. Runs on DataFrame functions alone."""
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b")))
    groups = durable(connected_components(edges))
    members = with_rule(groups.withColumnRenamed("node", "url"), rules)
    allowed, blocked = F.max(F.when(F.col("rule_verdict") == "allow", 1)), F.max(F.when(F.col("rule_verdict") == "block", 1))
    spread = members.groupBy("component").agg(F.when(allowed == 1, "allow").when(blocked == 1, "block").alias("spread"))
    aliases = groups.join(spread, "component").select(F.col("node").alias("_node"), F.col("component").alias("alias"), "spread")
    judged = with_rule(pages.select(F.col(key).alias("page_id"), F.col("url")), rules).withColumn("_node", node(F.col("url")))
    judged = judged.join(aliases, "_node", "left")
    verdict = F.coalesce("rule_verdict", "spread", F.lit(default))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias")
