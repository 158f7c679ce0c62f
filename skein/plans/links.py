"""Queries from pages to admitted links: extraction, scope, robots, traps, the seen set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import Scope
from skein.functions.ids import address_id, host_folded_id, host_of
from skein.functions.urls import canonical_url, rooted
from skein.operators import admission, extract, jobs
from skein.operators.content import charset, decode_text
from skein.plans.urls import DOMAIN, ID
from skein.runtime import table
from skein.schemas import URL_CLASSES

SCOPE = Scope(
    include_domains=(r"\.test$", r"example\.(org|net)"),
    include_urls=(r"[^/]*/(news|map)\b", r"[^/]*/docs/.*harbour"),
    exclude_domains=("forum|media", "quartz"),
    exclude_urls=(r"^[^/]*/(login|register)\b", r"[^/]*/(wiki|tags)/"),
)
AGENT = "skein/1.0"
RULES = [
    ("ochre-market.example", "*", "disallow", "/wiki/"), ("ochre-market.example", "*", "allow", "/wiki/*harvest"),
    ("www.yarrowatlas.test", "skein", "disallow", "/"), ("www.yarrowatlas.test", "skein", "allow", "/guides/"), ("www.yarrowatlas.test", "*", "disallow", "/guides/"),
    ("kestrel-depot.example", "googlebot", "disallow", "/*.html$"), ("kestrel-depot.example", "*", "disallow", "/tags/"),
    ("docs.cobaltworks.example", "*", "disallow", ""), ("www.pebblegazette.test", "*", "disallow", "/lists/"), ("www.pebblegazette.test", "*", "allow", "/lists/"),
    ("forum.larchguild.test", "other", "disallow", "/"),
]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, body, content_type), in the charset that the content-type names."""
    kind = F.element_at("meta", "content-type")
    return table(spark, sf_dir, "crawled_content").select(
        F.col("content_id").alias("page_id"), F.col("original_url").alias("url"), decode_text(F.col("contents"), charset(kind)).alias("body"), kind.alias("content_type")
    )


def robots_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "domain string, agent string, rule string, path string")


def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.html_links(pages(spark, sf_dir))
    return found.groupBy("page_id", "page_url", "value", "link").agg(F.count(F.lit(1)).alias("n"))


def extract_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the stored pages by their content types; site maps are those whose address ends in sitemap.xml or .txt."""
    named = F.when(F.col("url").rlike(r"(?i)/sitemap[^/?]*\.(xml|txt)$"), "sitemap").otherwise(F.col("content_type"))
    found = extract.extract_links(pages(spark, sf_dir).withColumn("content_type", named))
    return found.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


def extract_links_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.link_edges(extract.html_links(pages(spark, sf_dir))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.link_edges(extract.html_links(pages(spark, sf_dir))).select("page_id", "referrer_id", "id")


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that link to each id."""
    return link_edges(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n_pages"))


FIXTURES = {
    "html": [
        (1, "http://h.test/a/b.html", '<base href="http://base.test/root/"><a href="x.html">x</a><img src=\'/i.png\'><a href=y>y</a>'),
        (2, "http://h.test/a/b.html", '<a href="javascript:go()">j</a><a href="mailto:x@h.test">m</a><a href="">e</a><a href="b.html">self</a><a href="/c">c</a><a href="/c">c</a>'),
        (3, "http://h.test/", '<object data="http://o.test/f.swf"></object><object data="/rel.swf"></object>'),
        (4, "http://h.test/", None),
    ],
    "css": [
        (1, "http://h.test/css/s.css", "/* url(c.png) */ a{background:url('i/a.png')} @import url(n.css); @media print{b{background:url(p.png)}} c{background:url( /r.png )}"),
        (2, "http://h.test/css/t.css", "d{background:url()} e{src:url(\"http://f.test/w.woff\")}"),
    ],
    "sitemap": [
        (1, "http://h.test/map.txt", "http://h.test/a\n http://h.test/b \nftp://h.test/c\n"),
        (2, "http://h.test/index.xml", '<sitemapindex xmlns="http://s.test/0.9"><sitemap><loc> http://h.test/m1.xml </loc></sitemap></sitemapindex>'),
        (3, "http://h.test/urls.xml", '<urlset xmlns:image="http://i.test/1"><url><loc>http://h.test/p</loc><image:image><image:loc>http://h.test/p.png</image:loc></image:image></url></urlset>'),
        (4, "http://h.test/bad.xml", "<urlset><url><loc>http://h.test/q</loc>"),
        (5, "http://h.test/map.json", '["http://h.test/r"]'),
    ],
    "robots": [
        (1, "http://h.test/robots.txt", "User-agent: *\nDisallow: /x\nSitemap: http://h.test/one.xml\nsitemap:http://h.test/two.xml\n"),
        (2, "https://k.test/robots.txt", ""),
    ],
}


def _fixture(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(FIXTURES[name], "page_id long, url string, body string")


def extract_fixture_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.html_links(_fixture(spark, "html")).select("page_id", "link")


def extract_object_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.object_links(_fixture(spark, "html")).select("page_id", "link")


def extract_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.css_links(_fixture(spark, "css")).select("page_id", "link")


def extract_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.sitemap_links(_fixture(spark, "sitemap")).select("page_id", "link")


def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.robots_sitemaps(_fixture(spark, "robots")).select("page_id", "link")


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "crawled_urls")
    return rows.select("row_id", "url", address_id(F.col("url")).alias("id"), host_of(address_id(F.col("url"))).alias("domain"))


def scope_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("row_id", admission.scope_class(F.col("url"), SCOPE).cast("long").alias("class"))


def scope_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[x for name, value in URL_CLASSES.items() for x in (F.lit(value), F.lit(name))])
    classed = _ids(spark, sf_dir).select(F.element_at(names, admission.scope_class(F.col("url"), SCOPE)).alias("class_name"))
    return classed.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))


def scope_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.scope_hits(_ids(spark, sf_dir), SCOPE).groupBy("section", "pattern").agg(F.count(F.lit(1)).alias("n"))


def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.robots_allowed(_ids(spark, sf_dir), robots_rules(spark), AGENT).select("row_id", "allowed")


def robots_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "crawled_urls").select("row_id", "url", "robot_exclusion_reasons", "googlebot_exclusion_reasons")
    keyed = rows.withColumn("id", address_id(F.col("url"))).withColumn("domain", host_of(F.col("id")))
    reasons = admission.robots_reasons(keyed, robots_rules(spark), AGENT)
    return reasons.select("row_id", F.coalesce(F.size("robot_exclusion_reasons"), F.lit(0)).cast("long").alias("n_robot"), F.coalesce(F.size("googlebot_exclusion_reasons"), F.lit(0)).cast("long").alias("n_google"), admission.robot_excluded(True, False).alias("excluded"))


def spider_trap_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("row_id", admission.is_spider_trap(F.col("id"), repeats=2, depth=4).alias("trap"))


def seen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "seen_urls").select(host_folded_id(F.col("url")).alias("id")).distinct()
    return _ids(spark, sf_dir).withColumn("id", host_folded_id(F.col("url"))).join(seen, "id", "left_anti").select("row_id")


def seen_rebuild_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name: table(spark, sf_dir, name).select(address_id(F.col("url")).alias("id"))
    return jobs.rebuild_seen(of("crawled_urls"), of("redirected_urls"), of("seen_urls"))


def frontier_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link of the pages once: admitted (null reason), seen (0) or the class for which it is not crawled."""
    links = extract.link_edges(extract.html_links(pages(spark, sf_dir)))
    crawled = table(spark, sf_dir, "crawled_urls").select(address_id(rooted(canonical_url(F.col("url"), drop_fragment=True))).alias("id"))
    return admission.admit(links, crawled, SCOPE, robots_rules(spark), AGENT).select("id", F.col("reason").cast("long").alias("reason"))


def frontier_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "crawled_urls").select("row_id", "url", F.col("referrer_id").isNull().alias("is_seed"))
    return admission.recheck(rows, SCOPE, robots_rules(spark), AGENT).select("row_id", F.col("reason").cast("long").alias("reason"))


QUERIES = {
    f.__name__: f
    for f in (
        extract_links, extract_by_type, extract_links_distinct, link_edges, link_targets, extract_fixture_html, extract_object_base, extract_css, extract_sitemaps, robots_sitemaps,
        scope_classify, scope_class_counts, scope_pattern_hits, robots_decision, robots_exclusions, spider_trap_flag, seen_anti_join, seen_rebuild_union,
        frontier_admission, frontier_recheck,
    )
}


def _either(column: str, patterns: tuple[str, ...], prefix: str) -> str:
    return f"regexp_matches({column}, '" + "|".join(f"^{prefix}(?:{p})" for p in patterns) + "')"


def scope_sql(url: str, id_: str, host: str) -> str:
    """The class of a URL as an SQL expression, from the same lists."""
    ind, ind_u = _either(host, SCOPE.include_domains, ".*"), _either(id_, SCOPE.include_urls, "")
    exd, exd_u = _either(host, SCOPE.exclude_domains, ".*"), _either(id_, SCOPE.exclude_urls, "")
    return f"""CASE WHEN {url} IS NULL THEN NULL WHEN NOT starts_with({url}, 'http') THEN -2
 WHEN {ind} AND {exd} AND {ind_u} THEN 1 WHEN {ind} AND {exd} THEN -4 WHEN {ind} AND {exd_u} THEN -1 WHEN {ind} THEN 1 WHEN {ind_u} THEN 1 ELSE -2 END"""


_IDS = f"SELECT row_id, url, referrer_id, robot_exclusion_reasons, googlebot_exclusion_reasons, {ID} AS id, {DOMAIN} AS domain FROM crawled_urls"
_RAW_LINKS = r"""
SELECT content_id AS page_id, original_url AS page_url,
  unnest(regexp_extract_all(replace(cast(contents AS VARCHAR), '\x22', '"'), '(?i)\b(?:href|src)\s*=\s*"([^"]*)"', 1)) AS value
FROM crawled_content
"""
_LINKS = rf"""
SELECT page_id, page_url, value, CASE WHEN regexp_matches(value, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN value
  WHEN starts_with(value, '/') THEN regexp_extract(page_url, '^([a-zA-Z]+://[^/?#]*)', 1) || value ELSE 'relative' END AS link
FROM ({_RAW_LINKS}) AS raw
WHERE value <> '' AND NOT contains(lower(value), 'javascript:') AND NOT contains(lower(value), 'mailto:')
"""


def _canonical(url: str) -> str:
    """Canonical form of URLs without dot segments."""
    url = f"regexp_replace({url}, '#.*', '')"
    path = f"lower(regexp_extract({url}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1))"
    return (
        f"lower(regexp_extract({url}, '^([a-zA-Z]+://[^/?#:]*)', 1)) || regexp_replace(regexp_extract({url}, '^[a-zA-Z]+://[^/?#:]*(:[0-9]*)?', 1), '^:(80|443)?$', '')"
        f" || CASE WHEN {path} = '' THEN '/' ELSE {path} END || regexp_extract({url}, '^[^?#]*(.*)$', 1)"
    )


_EDGES = f"""
SELECT DISTINCT page_id, referrer_id, id, link FROM (
  SELECT page_id, regexp_replace({_canonical('page_url')}, '^[a-z]+://', '') AS referrer_id,
    regexp_replace({_canonical('link')}, '^[a-z]+://', '') AS id, {_canonical('link')} AS link FROM ({_LINKS}) AS l) AS e
WHERE id <> referrer_id
"""
_RULES = ", ".join(f"('{d}', '{a}', '{r}', '{p}')" for d, a, r, p in RULES)


def allowed_sql(ids: str, key: str, agent: str) -> str:
    """(key, allowed) of the rows of ``ids`` (key, id, domain)."""
    return rf"""
SELECT {key}, coalesce(arg_max(allow, weight * 2 + CASE WHEN allow THEN 1 ELSE 0 END), true) AS allowed FROM (
  SELECT i.{key}, r.rule = 'allow' AS allow, length(r.path) AS weight
  FROM ({ids}) AS i LEFT JOIN (
    SELECT * FROM (
      SELECT *, max(CASE WHEN agent <> '*' THEN length(agent) ELSE 0 END) OVER (PARTITION BY domain) AS named
      FROM (VALUES {_RULES}) AS v(domain, agent, rule, path) WHERE agent = '*' OR contains(lower('{agent}'), agent)) AS g
    WHERE path <> '' AND ((named > 0 AND agent <> '*' AND length(agent) = named) OR (named = 0 AND agent = '*'))) AS r
  ON i.domain = r.domain AND regexp_matches(lower(regexp_replace(i.id, '^[^/?]*', '')),
     '^' || replace(replace(replace(regexp_replace(r.path, '\$$', ''), '.', '\.'), '?', '\?'), '*', '.*') || CASE WHEN ends_with(r.path, '$') THEN '$' ELSE '' END)) AS m
GROUP BY {key}
"""


_SEGMENTS = f"SELECT row_id, unnest(string_split(regexp_extract({ID}, '^[^/?#]*/([^?#]*)', 1), '/')) AS s FROM crawled_urls"
_FOLDED = f"lower({DOMAIN}) || substr({ID}, length({DOMAIN}) + 1)"

SQL = {
    "extract_links": f"SELECT page_id, page_url, value, link, CAST(count(*) AS BIGINT) AS n FROM ({_LINKS}) AS l GROUP BY ALL",
    "extract_by_type": f"""
SELECT l.page_id, link, CAST(count(*) AS BIGINT) AS n FROM ({_LINKS}) AS l JOIN crawled_content c ON l.page_id = c.content_id
WHERE lower(trim(string_split(c.meta['content-type'], ';')[1])) IN ('text/html', 'application/xhtml+xml') AND NOT regexp_matches(c.original_url, '(?i)/sitemap[^/?]*\\.(xml|txt)$') GROUP BY 1, 2""",
    "extract_links_distinct": f"SELECT page_id, CAST(count(*) AS BIGINT) AS n_links FROM (SELECT DISTINCT page_id, id FROM ({_EDGES}) AS e) AS d GROUP BY page_id",
    "link_edges": f"SELECT DISTINCT page_id, referrer_id, id FROM ({_EDGES}) AS e",
    "link_targets": f"SELECT id, CAST(count(*) AS BIGINT) AS n_pages FROM (SELECT DISTINCT page_id, id FROM ({_EDGES}) AS e) AS d GROUP BY id",
    "extract_fixture_html": """
SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'http://base.test/root/'), (1, 'http://base.test/root/x.html'), (1, 'http://base.test/i.png'), (1, 'http://base.test/root/y'),
  (2, 'http://h.test/a/b.html'), (2, 'http://h.test/c'), (2, 'http://h.test/c')) AS t(page_id, link)""",
    "extract_object_base": "SELECT CAST(3 AS BIGINT) AS page_id, 'http://o.test/f.swf' AS link",
    "extract_css": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'http://h.test/css/i/a.png'), (1, 'http://h.test/r.png'), (2, 'http://f.test/w.woff')) AS t(page_id, link)",
    "extract_sitemaps": """
SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'http://h.test/a'), (1, 'http://h.test/b'), (2, 'http://h.test/m1.xml'), (3, 'http://h.test/p'), (3, 'http://h.test/p.png')) AS t(page_id, link)""",
    "robots_sitemaps": """
SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'http://h.test/one.xml'), (1, 'http://h.test/two.xml'), (1, 'http://h.test/sitemap.xml'), (2, 'https://k.test/sitemap.xml')) AS t(page_id, link)""",
    "scope_classify": f"SELECT row_id, CAST({scope_sql('url', 'id', 'domain')} AS BIGINT) AS class FROM ({_IDS}) AS i",
    "scope_class_counts": f"""
SELECT CASE {scope_sql('url', 'id', 'domain')} WHEN 1 THEN 'InScope' WHEN -1 THEN 'ExcludeUrl' WHEN -2 THEN 'OutOfScope' WHEN -4 THEN 'ExcludedDomain' END AS class_name,
  CAST(count(*) AS BIGINT) AS n FROM ({_IDS}) AS i GROUP BY 1""",
    "scope_pattern_hits": " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{p}' AS pattern, CAST(count(*) AS BIGINT) AS n FROM ({_IDS}) AS i WHERE {_either(column, (p,), prefix)} HAVING count(*) > 0"
        for section, patterns, column, prefix in (
            ("IncludeDomains", SCOPE.include_domains, "domain", ".*"), ("IncludeUrls", SCOPE.include_urls, "id", ""),
            ("ExcludeDomains", SCOPE.exclude_domains, "domain", ".*"), ("ExcludeUrls", SCOPE.exclude_urls, "id", ""),
        )
        for p in patterns
    ),
    "robots_decision": allowed_sql(_IDS, "row_id", AGENT),
    "robots_exclusions": f"""
WITH i AS ({_IDS}), a AS ({allowed_sql(_IDS, 'row_id', AGENT)}), g AS ({allowed_sql(_IDS, 'row_id', 'GoogleBot')}),
n AS (
  SELECT i.row_id,
    CASE WHEN a.allowed OR list_contains(coalesce(i.robot_exclusion_reasons, []), 'robots.txt') THEN 0 ELSE 1 END + coalesce(len(list_distinct(i.robot_exclusion_reasons)), 0) AS n_robot,
    CASE WHEN g.allowed OR list_contains(coalesce(i.googlebot_exclusion_reasons, []), 'robots.txt') THEN 0 ELSE 1 END + coalesce(len(list_distinct(i.googlebot_exclusion_reasons)), 0) AS n_google
  FROM i JOIN a ON i.row_id = a.row_id JOIN g ON i.row_id = g.row_id)
SELECT row_id, CAST(n_robot AS BIGINT) AS n_robot, CAST(n_google AS BIGINT) AS n_google, n_robot > 0 AS excluded FROM n""",
    "spider_trap_flag": f"""
SELECT c.row_id, coalesce(t.n > 4 OR t.most >= 2, false) AS trap FROM crawled_urls c LEFT JOIN (
  SELECT row_id, sum(n) AS n, max(n) AS most FROM (SELECT row_id, s, count(*) AS n FROM ({_SEGMENTS}) AS g WHERE s <> '' GROUP BY row_id, s) AS h GROUP BY row_id) AS t
ON c.row_id = t.row_id""",
    "seen_anti_join": f"SELECT row_id FROM crawled_urls WHERE {_FOLDED} NOT IN (SELECT {_FOLDED} FROM seen_urls)",
    "seen_rebuild_union": " UNION ".join(f"SELECT {ID} AS id FROM {t}" for t in ("crawled_urls", "redirected_urls", "seen_urls")),
    "frontier_admission": f"""
WITH l AS (SELECT id, min(link) AS link, regexp_extract(id, '^([^?/:]*)', 1) AS domain FROM ({_EDGES}) AS e GROUP BY id),
s AS (SELECT DISTINCT regexp_replace({_canonical('url')}, '^[a-z]+://', '') AS id FROM crawled_urls),
a AS ({allowed_sql('SELECT id, domain FROM l', 'id', AGENT)}),
t AS (SELECT id, max(n) AS most, sum(n) AS depth FROM (SELECT id, s, count(*) AS n FROM (SELECT id, unnest(string_split(regexp_extract(id, '^[^/?#]*/([^?#]*)', 1), '/')) AS s FROM l) AS g WHERE s <> '' GROUP BY id, s) AS h GROUP BY id)
SELECT l.id, CAST(CASE WHEN s.id IS NOT NULL THEN 0 WHEN {scope_sql('l.link', 'l.id', 'l.domain')} <> 1 THEN {scope_sql('l.link', 'l.id', 'l.domain')}
  WHEN NOT a.allowed THEN -5 WHEN t.most >= 3 OR t.depth > 20 THEN -8 END AS BIGINT) AS reason
FROM l LEFT JOIN s ON l.id = s.id LEFT JOIN a ON l.id = a.id LEFT JOIN t ON l.id = t.id""",
    "frontier_recheck": f"""
WITH i AS ({_IDS}), a AS ({allowed_sql(_IDS, 'row_id', AGENT)})
SELECT i.row_id, CAST(CASE WHEN i.referrer_id IS NOT NULL THEN NULL WHEN {scope_sql('i.url', 'i.id', 'i.domain')} <> 1 THEN {scope_sql('i.url', 'i.id', 'i.domain')}
  WHEN NOT a.allowed THEN -5 END AS BIGINT) AS reason FROM i JOIN a ON i.row_id = a.row_id""",
}
