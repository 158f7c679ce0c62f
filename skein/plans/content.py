"""Queries on bodies: fingerprints, copies, near copies along referrers, caching, redundancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import address_id
from skein.functions.urls import canonical_url, rooted, storage_key
from skein.operators import admission, extract
from skein.operators import content as C
from skein.operators import redundancy as R
from skein.plans.links import AGENT, SCOPE, pages, robots_rules
from skein.plans.links import SQL as LINKS_SQL
from skein.plans.urls import ID
from skein.runtime import stage, table

NOW = "2014-02-01 00:00:00"
NOW_EPOCH = 1391212800
PATH, FILE, KEY = 12, 4, 3


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "crawled_content").select("content_id", "contents", F.element_at("meta", "content-type").alias("kind"))
    # Latin-1 keeps each byte one character; the mark-up is ASCII and all else is deleted
    text = F.decode("contents", "iso-8859-1")
    html = C.content_type(F.col("kind")) == "text/html"
    stripped = C.strip_markup(F.lit("text/html"), text)
    digest = F.when(html & (stripped != text), F.sha1(stripped)).otherwise(F.sha1("contents"))
    return rows.select("content_id", F.when(F.col("contents").isNotNull(), digest).alias("fingerprint"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_groups(content_fingerprint(spark, sf_dir).withColumnRenamed("content_id", "id"))


def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locality digests of the bodies, for the similarity of copies that differ a little."""
    rows = table(spark, sf_dir, "crawled_content").select(F.col("content_id").alias("key"), F.col("contents").alias("body"))
    return C.nilsimsa(rows).withColumnRenamed("key", "content_id")


def document_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha1(F.col("text").cast("binary")).alias("fingerprint"))
    return C.duplicate_groups(rows)


def original_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "crawled_urls").select("row_id", address_id(F.col("url")).alias("id"), "fetched", "fingerprint")
    return C.originals(rows).select("row_id", "original")


def content_cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "crawled_urls").select(address_id(F.col("url")).alias("id")).distinct()
    store = table(spark, sf_dir, "crawled_content").groupBy(F.col("s3_key").alias("key")).agg(F.max("content_id").alias("body"))
    hits = C.cache_lookup(wanted, store)
    return hits.select("id", F.col("stored_body").isNotNull().alias("hit"), F.col("stored_body").alias("content_id"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "crawled_urls").select("row_id", "fetched", "response_headers", "referrer_id")
    get = lambda n: C.header(F.col("response_headers"), n)
    return rows.select("row_id", "fetched", "referrer_id", C.http_date(get("expires")).alias("expires"), C.http_date(get("last-modified")).alias("modified"), get("etag").alias("etag"), get("content-type").alias("content_type"))


def http_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = lambda c: F.unix_timestamp(c).alias(f"{c}_s")
    return _dated(spark, sf_dir).select("row_id", seconds("expires"), seconds("modified"), C.content_type(F.col("content_type")).alias("content_type"), C.charset(F.col("content_type")).alias("charset"))


def use_cached_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.timestamp_seconds(F.lit(NOW_EPOCH))
    return _dated(spark, sf_dir).select("row_id", C.use_cached(F.col("fetched"), F.col("expires"), F.col("modified"), now).alias("use_cached"))


def request_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    referrer = F.concat(F.lit("http://"), F.col("referrer_id"))
    held = C.request_headers(referrer, C.format_http_date(F.col("modified")), F.col("etag"))
    return _dated(spark, sf_dir).select("row_id", F.array_join(F.transform(F.array_sort(F.map_entries(held)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("headers"))


def dust_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page how many ancestors in a row are near it in size and of its type; the parent is the page it was found on, fetched before it.

    As in its SQL this compares headers only, sizes up to a half apart; ``dust_near_copies`` compares the bodies.
    """
    get = lambda n: C.header(F.col("response_headers"), n)
    rows = table(spark, sf_dir, "crawled_urls").select("row_id", address_id(F.col("url")).alias("address"), "referrer_id", get("content-length").try_cast("int").alias("size"), get("content-type").alias("kind"))
    first = stage(rows.groupBy("address").agg(F.min(F.struct("row_id", "referrer_id", "size", "kind")).alias("f")).select("address", "f.*"), "pages")
    parents = first.select(F.col("address").alias("referrer_id"), F.col("row_id").alias("parent"), F.col("kind").alias("parent_kind"))
    linked = first.join(parents, "referrer_id", "left").withColumn("parent", F.when(F.col("parent") < F.col("row_id"), F.col("parent")))
    nodes = linked.select(F.col("row_id").alias("id"), "parent", "size", (F.col("kind") == F.col("parent_kind")).alias("similar"))
    return C.similar_runs(nodes, 0.5).select(F.col("id").alias("row_id"), "count")


def dust_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page how many ancestors in a row its body is a near copy of, and whether it is dust by that.

    The parent is the page it was found on, if on the same host and fetched before it. Bodies are those stored under the
    page's key (of several the last), HTML without mark-up; other types, and pages without a stored body, have no digest.
    """
    rows = table(spark, sf_dir, "crawled_urls").select("row_id", address_id(F.col("url")).alias("address"), "referrer_id")
    host = lambda c: F.lower(F.regexp_extract(c, "^([^?/:]*)", 1))
    first = stage(rows.filter("address is not null").groupBy("address").agg(F.min(F.struct("row_id", "referrer_id")).alias("f")).select("address", "f.*"), "pages")
    parents = first.select(F.col("address").alias("referrer_id"), F.col("row_id").alias("parent"))
    own = (F.col("parent") < F.col("row_id")) & (host("address") == host("referrer_id"))
    pages = first.join(parents, "referrer_id", "left").select(F.col("row_id").alias("id"), F.when(own, F.col("parent")).alias("parent"), storage_key(F.col("address")).alias("key"))
    stored = table(spark, sf_dir, "crawled_content").filter("s3_key is not null").groupBy(F.col("s3_key").alias("key")).agg(
        F.max_by(F.struct(F.element_at("meta", "content-type").alias("kind"), "contents"), "content_id").alias("last")
    )
    text = C.strip_markup(F.lit("text/html"), F.decode("last.contents", "iso-8859-1"))
    html = C.content_type(F.col("last.kind")) == "text/html"
    bodies = stored.filter(html).select("key", F.encode(text, "iso-8859-1").alias("body"))
    return C.near_copies(pages, bodies).withColumnRenamed("id", "row_id")


def dust_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the stored pages, skipped (-6) where the page is dust, and whether they carry its state on."""
    found = extract.link_edges(extract.html_links(pages(spark, sf_dir)))
    rows = table(spark, sf_dir, "crawled_urls").select(address_id(rooted(canonical_url(F.col("url"), drop_fragment=True))).alias("referrer_id"), "row_id")
    named = found.join(rows.groupBy("referrer_id").agg(F.min("row_id").alias("row_id")), "referrer_id", "left")
    runs = dust_near_copies(spark, sf_dir).select("row_id", "dust", "has_digest")
    links = named.select("page_id", "referrer_id", "id", "row_id").join(runs, "row_id", "left")
    states = links.groupBy("page_id").agg(F.max("dust").alias("dust"), F.max("has_digest").alias("has_digest"))
    return C.dust_skips(links.select("page_id", "referrer_id", "id"), states)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "crawled_urls").filter("original is not null")
    return rows.select(F.col("row_id").alias("seq"), address_id(F.col("url")).alias("id"), (F.col("original") != "self").alias("redundant"))


def redundancy_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.support(_log(spark, sf_dir)).withColumn("node", F.replace("node", F.lit("\u0001"), F.lit("|")))


def redundancy_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.probe(table(spark, sf_dir, "seen_urls").select(address_id(F.col("url")).alias("id")), R.support(_log(spark, sf_dir)), PATH, FILE, KEY)


def redundancy_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.probe_as_of(_log(spark, sf_dir), PATH, FILE, KEY)


def frontier_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontier rows before they are fetched: redundant ones (-7) first, then seeds that scope or robots rules forbid; null if nothing does."""
    rows = table(spark, sf_dir, "crawled_urls").select("row_id", "url", F.col("referrer_id").isNull().alias("is_seed")).withColumn("id", address_id(F.col("url")))
    probed = R.probe(rows, R.support(_log(spark, sf_dir)), PATH, FILE, KEY)
    checked = admission.recheck(rows, SCOPE, robots_rules(spark), AGENT)
    return admission.skip_redundant(checked, probed).select("row_id", F.col("reason").cast("long").alias("reason"))


def redundancy_tree_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.created(_log(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        content_fingerprint, exact_duplicates, content_digests, document_duplicates, original_assignment, content_cache_hit, http_dates, use_cached_decision, request_headers,
        dust_lineage, dust_near_copies, dust_gate, redundancy_support, redundancy_probe, redundancy_asof, redundancy_tree_count, frontier_gate,
    )
}

_ESCAPED = r"""replace(replace(cast(contents AS VARCHAR), '\x22', '"'), '\x0A', chr(10))"""
_STRIPPED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _ESCAPED + r", '\\x[0-9A-F]{2}', ' ', 'g'), "
    r"'(?is)<(script|style)\b.*?</(script|style)\s*>', '', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\W+', '', 'g')"
)
_FINGERPRINT = f"""
SELECT content_id, CASE WHEN contents IS NULL THEN NULL WHEN kind = 'text/html' AND s <> '' THEN sha1(s) ELSE sha1(contents) END AS fingerprint
FROM (SELECT content_id, contents, lower(trim(string_split(meta['content-type'], ';')[1])) AS kind, {_STRIPPED} AS s FROM crawled_content) AS x
"""


def _date(name: str) -> str:
    return f"try_strptime(CASE WHEN length({name}) = 29 THEN {name} END, '%a, %d %b %Y %H:%M:%S GMT')"


_HEADERS = """
SELECT row_id, fetched, referrer_id, url, max(CASE WHEN lower(e.key) = 'expires' THEN e.value END) AS expires, max(CASE WHEN lower(e.key) = 'last-modified' THEN e.value END) AS modified,
  max(CASE WHEN lower(e.key) = 'etag' THEN e.value END) AS etag, max(CASE WHEN lower(e.key) = 'content-type' THEN e.value END) AS kind,
  max(CASE WHEN lower(e.key) = 'content-length' THEN e.value END) AS size
FROM (SELECT row_id, fetched, referrer_id, url, unnest(map_entries(response_headers)) AS e FROM crawled_urls) AS h GROUP BY row_id, fetched, referrer_id, url
"""
_ROWS = f"SELECT c.row_id, c.fetched, c.referrer_id, c.url, expires, modified, etag, kind, size FROM crawled_urls c LEFT JOIN ({_HEADERS}) AS h ON c.row_id = h.row_id"
_NODES = rf"""
WITH log AS (SELECT row_id AS seq, {ID} AS id, original <> 'self' AS redundant FROM crawled_urls WHERE original IS NOT NULL),
"""


def _nodes(source: str, columns: str) -> str:
    """Nodes of a source with id, as SQL: paths, the leaf and keys."""
    tokens = r"list_concat([regexp_extract(id, '^([^/?#]*)', 1)], string_split(trim(regexp_extract(id, '^[^/?#]*([^?#]*)', 1), '/'), '/'))"
    return rf"""
  SELECT {columns}, domain, array_to_string(list_slice(tokens, 1, k), '|') AS node, CASE WHEN k = len(tokens) THEN 'leaf' ELSE 'path' END AS role
  FROM (SELECT {columns}, domain, tokens, unnest(generate_series(1, len(tokens))) AS k FROM (SELECT {columns}, regexp_extract(id, '^([^?/:]*)', 1) AS domain, {tokens} AS tokens FROM {source}) AS t) AS p
  UNION ALL
  SELECT DISTINCT {columns}, domain, array_to_string(tokens, '|') || '|' || url_decode(replace(regexp_extract(pair, '^([^=]*)', 1), '+', ' ')) AS node, 'key' AS role
  FROM (SELECT {columns}, regexp_extract(id, '^([^?/:]*)', 1) AS domain, {tokens} AS tokens, unnest(string_split(replace(regexp_extract(id, '\?([^#]*)', 1), ';', '&'), '&')) AS pair FROM {source}) AS q
  WHERE regexp_matches(pair, '^[^=]*=.+')
"""


_SUPPORT = f"""
{_NODES} nodes AS (SELECT domain, node, seq, bool_or(redundant) AS redundant FROM ({_nodes('log', 'id, seq, redundant')}) AS n GROUP BY domain, node, seq),
numbered AS (SELECT *, row_number() OVER (PARTITION BY domain, node ORDER BY seq) AS rn FROM nodes),
support AS (SELECT domain, node, CAST(CASE WHEN bool_or(NOT redundant AND rn > 1) THEN -1 ELSE count(*) FILTER (WHERE redundant) END AS BIGINT) AS support FROM numbered GROUP BY domain, node)
"""
_HIT = f"coalesce(bool_or(CASE role WHEN 'key' THEN support >= {KEY} WHEN 'leaf' THEN support >= {FILE} OR support >= {PATH} ELSE support >= {PATH} END), false)"

SQL = {
    "content_fingerprint": _FINGERPRINT,
    "exact_duplicates": f"SELECT fingerprint, CAST(count(*) AS BIGINT) AS n, min(content_id) AS first_id FROM ({_FINGERPRINT}) AS f WHERE fingerprint IS NOT NULL GROUP BY fingerprint HAVING count(*) > 1",
    "document_duplicates": "SELECT sha1(text) AS fingerprint, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "original_assignment": f"""
SELECT row_id, CASE WHEN fingerprint IS NULL THEN NULL WHEN id = first THEN 'self' ELSE first END AS original FROM (
  SELECT row_id, fingerprint, {ID} AS id, first_value({ID}) OVER (PARTITION BY fingerprint ORDER BY fetched NULLS LAST, {ID}) AS first FROM crawled_urls) AS x""",
    "content_cache_hit": f"""
SELECT w.id, s.body IS NOT NULL AS hit, s.body AS content_id FROM (SELECT DISTINCT {ID} AS id FROM crawled_urls) AS w
LEFT JOIN (SELECT s3_key, max(content_id) AS body FROM crawled_content GROUP BY s3_key) AS s ON rtrim(w.id, '?/') = s.s3_key""",
    "http_dates": f"""
SELECT row_id, CAST(epoch({_date('expires')}) AS BIGINT) AS expires_s, CAST(epoch({_date('modified')}) AS BIGINT) AS modified_s,
  lower(trim(string_split(kind, ';')[1])) AS content_type, nullif(lower(regexp_extract(kind, '(?i)charset\\s*=\\s*["'']?([\\w.:-]+)', 1)), '') AS charset FROM ({_ROWS}) AS r""",
    "use_cached_decision": f"""
SELECT row_id, CASE WHEN fetched IS NULL THEN false WHEN coalesce({_date('expires')} > TIMESTAMP '{NOW}', false) THEN true
  WHEN {_date('modified')} IS NOT NULL THEN {NOW_EPOCH} - epoch({_date('modified')}) > 10 * ({NOW_EPOCH} - fetched) ELSE false END AS use_cached FROM ({_ROWS}) AS r""",
    "request_headers": f"""
SELECT row_id, array_to_string(list_filter([CASE WHEN {_date('modified')} IS NOT NULL THEN 'If-Modified-Since=' || modified END, 'If-None-Match=' || etag, 'Referer=http://' || referrer_id], lambda x: x IS NOT NULL), '|') AS headers
FROM ({_ROWS}) AS r""",
    "dust_lineage": f"""
WITH RECURSIVE first AS (
  SELECT row_id, id, referrer_id, try_cast(size AS INTEGER) AS size, kind FROM (SELECT *, {ID} AS id, row_number() OVER (PARTITION BY {ID} ORDER BY row_id) AS rn FROM ({_ROWS}) AS r) AS x WHERE rn = 1),
node AS (
  SELECT c.row_id, p.row_id AS parent, coalesce(c.kind = p.kind AND CASE WHEN c.size = 0 AND p.size = 0 THEN 0 ELSE abs(c.size - p.size) / CAST(greatest(c.size, p.size) AS DOUBLE) END < 0.5, false) AS near
  FROM first c LEFT JOIN first p ON c.referrer_id = p.id AND p.row_id < c.row_id),
runs AS (
  SELECT row_id, CAST(0 AS BIGINT) AS n FROM node WHERE NOT near
  UNION ALL SELECT node.row_id, runs.n + 1 FROM node JOIN runs ON node.parent = runs.row_id WHERE node.near)
SELECT row_id, n AS count FROM runs""",
    "redundancy_support": f"{_SUPPORT} SELECT domain, node, support FROM support",
    "redundancy_probe": f"""
{_SUPPORT}, probes AS (SELECT DISTINCT {ID} AS id FROM seen_urls), pn AS ({_nodes('probes', 'id')})
SELECT pn.id, {_HIT} AS redundant FROM pn LEFT JOIN support s ON pn.domain = s.domain AND pn.node = s.node GROUP BY pn.id""",
    "redundancy_asof": f"""
{_NODES} nodes AS (SELECT domain, node, seq, bool_or(redundant) AS redundant, max(role) AS role FROM ({_nodes('log', 'id, seq, redundant')}) AS n GROUP BY domain, node, seq),
numbered AS (SELECT *, row_number() OVER (PARTITION BY domain, node ORDER BY seq) AS rn FROM nodes),
held AS (
  SELECT seq, role, CASE WHEN rn > 1 THEN CASE WHEN bool_or(NOT redundant AND rn > 1) OVER w THEN -1 ELSE count(*) FILTER (WHERE redundant) OVER w END END AS support
  FROM numbered WINDOW w AS (PARTITION BY domain, node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, {_HIT} AS redundant FROM held GROUP BY seq""",
    "frontier_gate": f"""
{_SUPPORT}, probes AS (SELECT DISTINCT {ID} AS id FROM crawled_urls), pn AS ({_nodes('probes', 'id')}),
hit AS (SELECT pn.id, {_HIT} AS redundant FROM pn LEFT JOIN support s ON pn.domain = s.domain AND pn.node = s.node GROUP BY pn.id)
SELECT r.row_id, CASE WHEN hit.redundant THEN -7 ELSE r.reason END AS reason
FROM ({LINKS_SQL['frontier_recheck']}) AS r JOIN (SELECT row_id, {ID} AS id FROM crawled_urls) AS c ON r.row_id = c.row_id LEFT JOIN hit ON c.id = hit.id""",
    "redundancy_tree_count": f"""
{_NODES} nodes AS (SELECT domain, node, min(seq) AS seq FROM ({_nodes('log', 'id, seq, redundant')}) AS n GROUP BY domain, node)
SELECT domain, CAST(count(DISTINCT seq) AS BIGINT) AS n_urls FROM nodes GROUP BY domain""",
}
