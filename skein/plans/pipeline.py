"""The crawl step over the stream of messages, metrics and management look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import address_id, host_of
from skein.operators import content as C
from skein.operators import reports as R
from skein.plans.frontier import _ACTIVITY, _consumers, queue_activity
from skein.plans.frontier import _CONSUMERS as CONSUMERS_SQL
from skein.plans.links import SCOPE, scope_sql
from skein.plans.outcomes import _MESSAGES
from skein.plans.urls import DOMAIN, ID
from skein.runtime import table
from skein.streaming import windows as S
from skein.streaming.crawl import ROUTED, run_crawl

MACHINES = [("i-0", "m3.medium", "running", 0.067), ("i-1", "m1.medium", "terminated", 0.087), ("i-2", "m1.medium", "pending", 0.087), ("i-3", "c3.large", "running", 0.105), ("i-4", "m3.medium", "shutting-down", 0.067)]
BIDS = [("s-0", "open", 0.02), ("s-1", "active", 0.03), ("s-2", "closed", 0.9)]
IMAGES = [("ami-1", 20140101), ("ami-3", 20140301), ("ami-2", 20140201)]


def stream_crawl_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all messages of the frontier, handled as a stream; an id whose fetch failed is tried again when it is delivered again."""
    messages = S.open_stream(spark, f"{sf_dir}/frontier_messages.parquet", ["delivery_id", "frontier_message"])
    columns = ["url", "http_status"]
    answers = table(spark, sf_dir, "crawled_urls").select(columns).union(table(spark, sf_dir, "redirected_urls").select(columns))
    bodies = table(spark, sf_dir, "crawled_content").select(F.col("s3_key").alias("key"), "content_id")
    folder = run_crawl(messages, answers.select(address_id(F.col("url")).alias("id"), "http_status"), bodies, SCOPE, S.run_batches)
    routed = spark.read.schema(ROUTED).parquet(f"{folder}/routed").filter("outcome <> 'dead'")
    return routed.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"), F.count("content_id").alias("n_stored"))


def stored_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the content store would hold of the crawled pages."""
    rows = table(spark, sf_dir, "crawled_urls").select(address_id(F.col("url")).alias("id"), "url", "original", F.lit(None).cast("binary").alias("body"), "response_headers", "fetched")
    return C.store_rows(rows).select("key", F.element_at("meta", "original").alias("original"), F.element_at("meta", "content-type").alias("content_type"))


def charset_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "crawled_content").select("content_id", "contents", F.element_at("meta", "content-type").alias("kind"))
    name = C.charset(F.col("kind"))
    return rows.select("content_id", F.coalesce(name, F.lit("utf-8")).alias("charset"), F.length(C.decode_text(F.col("contents"), name)).cast("long").alias("n_chars"))


def metrics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = {"active": "Count", "queues": "Count", "needed": "Count"}
    rows = R.metric_rows(_consumers(spark, sf_dir), units, "consumer")
    return rows.select("name", "unit", F.element_at("dimensions", "consumer").alias("consumer"), "value")


def assignment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    queues = queue_activity(spark, sf_dir).select("queue", "active", F.col("skips").alias("waiting"))
    return R.assignment_plan(queues, 6).select("queue", "consumer_no")


def robots_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of robots files, here of the pages of each host: the last answer counts, errors stand for files that could not be had."""
    rows = table(spark, sf_dir, "crawled_urls").filter("fetched is not null")
    expires = F.unix_timestamp(C.http_date(C.header(F.col("response_headers"), "expires"))).cast("double")
    files = rows.select(host_of(address_id(F.col("url"))).alias("domain"), F.col("fetched").alias("at"), expires.alias("expires"), (F.col("http_status") >= 400).alias("failed"))
    return R.robots_cache(files, F.lit(1388700000.0)).select("domain", "refetch")


def live_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(MACHINES, "instance string, kind string, state string, price double")
    return R.live(rows).select("instance", "state", R.preference(F.col("kind")).cast("long").alias("preference"))


def machine_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.live(spark.createDataFrame(MACHINES, "instance string, kind string, state string, price double")).agg(F.sum("price").alias("fetchers"), F.count(F.lit(1)).alias("n_machines"))
    bids = spark.createDataFrame(BIDS, "request string, state string, bid double").filter(F.col("state") == "open").agg(F.sum("bid")).scalar()
    return rows.select("n_machines", F.round(R.hourly_cost(F.lit(0.067), F.lit(None).cast("double"), bids, F.col("fetchers")), 6).alias("hourly"))


def latest_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(spark.createDataFrame(IMAGES, "image string, created long"), "created", "image")


QUERIES = {f.__name__: f for f in (stream_crawl_step, stored_content, charset_decode, metrics_rows, assignment_plan, robots_cache, live_instances, machine_costs, latest_image)}

_MACHINES = ", ".join(str(m) for m in MACHINES)
_LIVE = f"(SELECT * FROM (VALUES {_MACHINES}) AS v(instance, kind, state, price) WHERE state NOT IN ('terminated', 'shutting-down'))"
_CODES = "300, 301, 302, 303, 307, 308"
_HEADER = "(SELECT row_id, max(CASE WHEN lower(e.key) = '{0}' THEN e.value END) AS v FROM (SELECT row_id, unnest(map_entries(response_headers)) AS e FROM crawled_urls) AS h GROUP BY row_id)"
_BARE = "regexp_replace(u.url, $$^[a-zA-Z][a-zA-Z0-9+.-]*://$$, $$$$)"
_CLASS = scope_sql("u.url", _BARE, f"regexp_extract({_BARE}, $$^([^?/:]*)$$, 1)")

SQL = {
    "stream_crawl_step": f"""
WITH u AS (SELECT t->>'$.id' AS id, t->>'$.url' AS url, regexp_extract(t->>'$.id', '^([^?/:]*)', 1) AS domain, delivery_id FROM ({_MESSAGES}) AS x WHERE t IS NOT NULL AND t->>'$.id' IS NOT NULL),
a AS (SELECT id, max(http_status) AS s FROM (SELECT {ID} AS id, http_status FROM crawled_urls UNION ALL SELECT {ID} AS id, http_status FROM redirected_urls) AS r GROUP BY id),
b AS (SELECT s3_key, max(content_id) AS c FROM crawled_content GROUP BY s3_key),
t AS (SELECT id, max(n) AS most, sum(n) AS depth FROM (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(string_split(regexp_extract(id, '^[^/?#]*/([^?#]*)', 1), '/')) AS g FROM (SELECT DISTINCT id FROM u) AS d) AS q WHERE g <> '' GROUP BY id, g) AS h GROUP BY id),
r AS (
  SELECT u.id, u.delivery_id, a.s, b.c, CASE WHEN {_CLASS} < 1 THEN {_CLASS} WHEN t.most >= 3 OR t.depth > 20 THEN -8 ELSE 1 END AS reason
  FROM u LEFT JOIN a ON u.id = a.id LEFT JOIN b ON rtrim(u.id, '?/') = b.s3_key LEFT JOIN t ON u.id = t.id),
o AS (
  SELECT id, reason, c, row_number() OVER w AS rn,
    CASE WHEN reason < 0 THEN 'skipped' WHEN s IN ({_CODES}) THEN 'redirected' WHEN s = 410 THEN 'failed' WHEN s IS NULL OR s >= 400 THEN 'requeue' ELSE 'crawled' END AS outcome
  FROM r WINDOW w AS (PARTITION BY id ORDER BY delivery_id))
SELECT CASE WHEN o.rn = 2 AND o.outcome = 'requeue' THEN 'failed' ELSE o.outcome END AS outcome, CAST(o.reason AS BIGINT) AS reason, CAST(count(*) AS BIGINT) AS n, CAST(count(o.c) AS BIGINT) AS n_stored
FROM o LEFT JOIN o AS before ON o.id = before.id AND before.rn = 1 WHERE o.rn = 1 OR (o.rn = 2 AND before.outcome = 'requeue') GROUP BY 1, 2""",
    "stored_content": f"""
SELECT key, original, content_type FROM (
  SELECT rtrim({ID}, '?/') AS key, rtrim(coalesce(original, 'self'), '?/') AS original, h.v AS content_type,
    row_number() OVER (PARTITION BY rtrim({ID}, '?/') ORDER BY fetched DESC NULLS LAST, {ID}, c.row_id) AS rn
  FROM crawled_urls c LEFT JOIN {_HEADER.format('content-type')} AS h ON c.row_id = h.row_id) AS x WHERE rn = 1""",
    "charset_decode": r"""
SELECT content_id, coalesce(nullif(lower(regexp_extract(k, '(?i)charset\s*=\s*["'']?([\w.:-]+)', 1)), ''), 'utf-8') AS charset,
  CAST(CASE WHEN coalesce(regexp_matches(k, '(?i)iso-8859-1'), false) THEN octet_length(contents) ELSE length(decode(contents)) END AS BIGINT) AS n_chars
FROM (SELECT content_id, contents, meta['content-type'] AS k FROM crawled_content) AS x""",
    "metrics_rows": " UNION ALL ".join(f"SELECT '{n}' AS name, 'Count' AS unit, CAST(consumer AS VARCHAR) AS consumer, CAST({n} AS DOUBLE) AS value FROM ({CONSUMERS_SQL}) AS c" for n in ("active", "queues", "needed")),
    "assignment_plan": f"SELECT queue, (row_number() OVER (ORDER BY CASE WHEN active THEN 0 WHEN skips > 0 THEN 1 ELSE 2 END, queue) - 1) % 6 AS consumer_no FROM ({_ACTIVITY}) AS a",
    "robots_cache": f"""
WITH f AS (
  SELECT {DOMAIN} AS domain, fetched AS at_, coalesce(http_status >= 400, NULL) AS failed, epoch(try_strptime(CASE WHEN length(h.v) = 29 THEN h.v END, '%a, %d %b %Y %H:%M:%S GMT')) AS expires
  FROM crawled_urls c LEFT JOIN {_HEADER.format('expires')} AS h ON c.row_id = h.row_id WHERE fetched IS NOT NULL),
v AS (SELECT domain, at_, greatest(coalesce(CASE WHEN NOT failed THEN expires END, at_), at_ + 3600.0) AS until FROM f)
SELECT domain, until <= 1388700000.0 AS refetch FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY at_ DESC, until DESC) AS rn FROM v) AS x WHERE rn = 1""",
    "live_instances": f"SELECT instance, state, CAST(CASE kind WHEN 'm3.medium' THEN 1 WHEN 'm1.medium' THEN 2 END AS BIGINT) AS preference FROM {_LIVE} AS l",
    "machine_costs": f"SELECT CAST(count(*) AS BIGINT) AS n_machines, CAST(round(0.067 + 0.02 + sum(price), 6) AS DOUBLE) AS hourly FROM {_LIVE} AS l",
    "latest_image": "SELECT 'ami-3' AS image",
}
