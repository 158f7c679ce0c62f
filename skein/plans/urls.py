"""URL queries (canonical form, parts, tokens, rules)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import urls as U
from skein.functions.ids import address_id, host_of
from skein.runtime import table

RULES = [(r"(\.pdf[^?]*)\?.*", "$1"), (r"/caf%c3%a9-", "/cafe-"), (r"\.php(\?|$)", ".html$1")]
REMOVED = [(r"(?:ref|sort)=[^&]*?(&|$)", ""), (r"view=[^&]*?(&|$)", "")]
LINKS = ["../x", "./y?z=1", "?q=1", "#top", "//other.example/a", "/root/../up", "https://abs.example/", "", "a/b/../c"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawled_urls")


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("row_id", U.canonical_url(F.col("raw_url"), drop_fragment=True).alias("canonical"))


def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("row_id", address_id(F.col("url")).alias("id"), host_of(address_id(F.col("url"))).alias("domain"))


def url_sld(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _rows(spark, sf_dir).select(host_of(address_id(F.col("url"))).alias("host"))
    return hosts.groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumn("sld", U.registered_domain(F.col("host")))


def url_s3_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("row_id", U.storage_key(address_id(F.col("url"))).alias("s3_key"), U.change_scheme(F.col("url"), F.lit("https")).alias("secure"))


def url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = address_id(F.col("url"))
    return _rows(spark, sf_dir).select("row_id", F.array_join(U.url_tokens(address), "|").alias("tokens"), F.array_join(F.array_sort(U.query_keys(address)), "|").alias("query_keys"))


def url_transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = U.transform_url(F.col("url"), RULES)
    return _rows(spark, sf_dir).select("row_id", changed.alias("transformed"), (changed != F.col("url")).alias("applied"))


def url_remove_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("row_id", U.remove_parameters(F.col("url"), REMOVED).alias("stripped"))


def url_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct site root joined with a set of references."""
    bases = _rows(spark, sf_dir).select(F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), F.lit("/d/e/f.html?k=v")).alias("base")).distinct()
    refs = F.explode(F.array(*[F.lit(x) for x in LINKS])).alias("reference")
    return bases.select("base", refs).withColumn("joined", U.join_url(F.col("base"), F.col("reference")))


QUERIES = {f.__name__: f for f in (url_canonical, url_domain, url_sld, url_s3_key, url_tokens, url_transform_chain, url_remove_param, url_join)}

ID = r"regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '')"
DOMAIN = f"regexp_extract({ID}, '^([^?/:]*)', 1)"
_SUFFIXES = ", ".join(f"'{s}'" for s in U.TWO_LABEL_SUFFIXES)
_JOINED = " ".join(
    f"WHEN '{ref}' THEN {sql}"
    for ref, sql in (
        ("../x", "root || '/d/x'"), ("./y?z=1", "root || '/d/e/y?z=1'"), ("?q=1", "root || '/d/e/f.html?q=1'"), ("#top", "root || '/d/e/f.html?k=v#top'"),
        ("//other.example/a", "scheme || '//other.example/a'"), ("/root/../up", "root || '/up'"), ("https://abs.example/", "'https://abs.example/'"),
        ("", "root || '/d/e/f.html?k=v'"), ("a/b/../c", "root || '/d/e/a/c'"),
    )
)

SQL = {
    "url_canonical": r"""
WITH raw AS (SELECT row_id, trim(raw_url) AS r FROM crawled_urls),
parts AS (
  SELECT row_id,
    CASE WHEN regexp_matches(r, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN lower(regexp_extract(r, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) ELSE 'http' END AS scheme,
    regexp_replace(regexp_replace(r, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '(?s)#.*', '') AS rest
  FROM raw),
split AS (
  SELECT row_id, scheme, regexp_replace(lower(regexp_extract(rest, '^([^/?#]*)', 1)), ':$', '') AS host,
    lower(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)) AS path, regexp_replace(rest, '^[^?#]*', '') AS tail
  FROM parts),
dots AS (
  SELECT row_id, scheme, host, tail,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '/(\./)+', '/', 'g'), '/[^/]+/\.\./', '/', 'g'), '/[^/]+/\.\./', '/', 'g'), '/[^/]+/\.\.$|/\.$', '/') AS path
  FROM split)
SELECT row_id, scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END || path || tail AS canonical
FROM dots
""",
    "url_domain": f"SELECT row_id, {ID} AS id, {DOMAIN} AS domain FROM crawled_urls",
    "url_sld": f"""
WITH h AS (SELECT {DOMAIN} AS host, CAST(count(*) AS BIGINT) AS n FROM crawled_urls GROUP BY 1)
SELECT host, n, CASE WHEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) IN ({_SUFFIXES})
  THEN CASE WHEN regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) = '' THEN host ELSE regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) END
  ELSE CASE WHEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) = '' THEN host ELSE regexp_extract(host, '([^.]+\\.[^.]+)$', 1) END END AS sld FROM h
""",
    "url_s3_key": f"SELECT row_id, rtrim({ID}, '?/') AS s3_key, 'https://' || {ID} AS secure FROM crawled_urls",
    "url_tokens": rf"""
WITH a AS (SELECT row_id, {ID} AS id FROM crawled_urls),
k AS (
  SELECT row_id, string_agg(k, '|' ORDER BY k) AS query_keys FROM (
    SELECT DISTINCT row_id, url_decode(replace(regexp_extract(pair, '^([^=]*)', 1), '+', ' ')) AS k
    FROM (SELECT row_id, unnest(string_split(replace(regexp_extract(id, '\?([^#]*)', 1), ';', '&'), '&')) AS pair FROM a) AS pairs
    WHERE regexp_matches(pair, '^[^=]*=.+')) AS keys GROUP BY row_id)
SELECT a.row_id, regexp_extract(id, '^([^/?#]*)', 1) || '|' || replace(trim(regexp_extract(id, '^[^/?#]*([^?#]*)', 1), '/'), '/', '|') AS tokens,
  CASE WHEN id IS NOT NULL THEN coalesce(query_keys, '') END AS query_keys FROM a LEFT JOIN k ON a.row_id = k.row_id""",
    "url_transform_chain": r"""
SELECT row_id, t AS transformed, t <> url AS applied FROM (
  SELECT row_id, url, regexp_replace(regexp_replace(regexp_replace(url, '(?i)(\.pdf[^?]*)\?.*', '\1', 'g'), '(?i)/caf%c3%a9-', '/cafe-', 'g'), '(?i)\.php(\?|$)', '.html\1', 'g') AS t
  FROM crawled_urls) AS x
""",
    "url_remove_param": r"""
SELECT row_id, trim(regexp_replace(regexp_replace(url, '(?i)(?:ref|sort)=[^&]*?(&|$)', '', 'g'), '(?i)view=[^&]*?(&|$)', '', 'g'), '?&') AS stripped FROM crawled_urls
""",
    "url_join": f"""
WITH b AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, regexp_extract(url, '^([a-z]+:)', 1) AS scheme FROM crawled_urls),
r AS (SELECT unnest([{', '.join(f"'{x}'" for x in LINKS)}]) AS reference)
SELECT root || '/d/e/f.html?k=v' AS base, reference, CASE reference {_JOINED} END AS joined FROM b CROSS JOIN r
""",
}
