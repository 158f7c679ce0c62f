"""Queries on outcomes, redirects, batch jobs, row formats and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import address_id
from skein.functions.urls import canonical_url
from skein.operators import jobs
from skein.operators import outcomes as O
from skein.operators.content import header
from skein.plans.links import SCOPE, scope_sql
from skein.plans.urls import DOMAIN, ID
from skein.plans.urls import SQL as URL_SQL
from skein.runtime import table
from skein.schemas import REDIRECT_STATUSES, URL_ROW
from skein.sources import versions as V

RECORD = "raw_url string, url string, id string, referrer_id string, discovered double, is_seed boolean"


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawled_urls").withColumn("id", address_id(F.col("url")))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, target): where the earliest redirect row of each id leads."""
    rows = table(spark, sf_dir, "redirected_urls").filter("redirects_to is not null")
    first = rows.groupBy(address_id(F.col("url")).alias("id")).agg(F.min(F.struct("row_id", "redirects_to")).alias("f"))
    return first.select("id", address_id(F.col("f.redirects_to")).alias("target"))


def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir).groupBy(O.status_class(F.col("http_status")).alias("status_class")).agg(F.count(F.lit(1)).alias("n"))


def outcome_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["row_id", "url", "http_status"]
    rows = _crawled(spark, sf_dir).select(columns).union(table(spark, sf_dir, "redirected_urls").select(columns))
    reason = F.when(F.col("url").contains("/tags/"), -1).otherwise(1)
    error = F.when(F.col("http_status").isNull(), "timeout").otherwise("")
    tried = rows.withColumn("reason", reason).withColumn("error", error).withColumn("attempts", F.when(F.col("url").startswith("https"), 1).otherwise(0))
    return O.route(tried).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


def retry_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("http_status").isNull(), "timeout").otherwise("")
    first, second = (O.retry(error, F.col("http_status"), F.lit(n)) for n in (0, 1))
    return _crawled(spark, sf_dir).select("row_id", first.alias("first_try"), second.alias("second_try"))


def redirect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.redirect_chains(_edges(spark, sf_dir)).select("id", "final_id", F.col("hops").cast("long").alias("hops"), "looped", "too_many")


def redirect_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "redirected_urls").withColumn("location", header(F.col("response_headers"), "location"))
    target = O.redirect_target(F.col("url"), F.col("location"))
    acted = rows.select("row_id", target.alias("target"), O.redirect_action(F.col("http_status"), F.col("url"), target, F.lit(0)).alias("action"), O.keeps_body(F.col("http_status")).alias("keeps_body"))
    return acted


def read_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as they were found, read as the lines of a seed file."""
    lines = table(spark, sf_dir, "crawled_urls").select(F.col("raw_url").alias("value"))
    return jobs.read_seeds(lines, F.lit(0.0)).select("id", "is_seed")


def export_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _crawled(spark, sf_dir).select("url", F.lit(None).cast("string").alias("redirects_to"))
    return jobs.export_seeds(rows.union(table(spark, sf_dir, "redirected_urls").select("url", "redirects_to")), SCOPE)


def purge_out_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.purge_split(_crawled(spark, sf_dir), SCOPE).select("row_id", "purged")


def purge_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = table(spark, sf_dir, "crawled_content").select("content_id", F.col("s3_key").alias("key"))
    return jobs.purge(_crawled(spark, sf_dir).select("id", "url"), content, SCOPE)[2].select("content_id")


def requeue_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an empty scope would have skipped and this one takes back."""
    skipped = _crawled(spark, sf_dir).select("row_id", "raw_url", "id", F.when(F.col("http_status") == 200, -2).otherwise(-7).alias("reason"))
    return jobs.requeue_skipped(skipped, SCOPE)[0].select("row_id")


def seed_from_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = table(spark, sf_dir, "redirected_urls").withColumn("id", address_id(F.col("url"))).select("url", "id")
    seen = table(spark, sf_dir, "seen_urls").select(address_id(F.col("url")).alias("id"))
    return jobs.seed_from_reference(reference, seen, SCOPE).select("id")


def union_with_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name: table(spark, sf_dir, name).select(F.col("url"), F.col("referrer_id").alias("referrer"))
    both = jobs.union_with_reason(ignored=of("redirected_urls"), external=of("crawled_urls"))
    return both.groupBy("reason", "referrer").agg(F.count(F.lit(1)).alias("n"))


def topic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirect targets that no row has: what is wanted less what is there."""
    wanted = table(spark, sf_dir, "redirected_urls").filter("redirects_to is not null").select(address_id(F.col("redirects_to")).alias("id"))
    there = _crawled(spark, sf_dir).select("id").union(table(spark, sf_dir, "redirected_urls").select(address_id(F.col("url"))))
    return wanted.subtract(there)


def pack_unpack_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows packed to JSON and read again, their texts cut to the greatest stored length."""
    rows = _crawled(spark, sf_dir).select(F.col("row_id").alias("id"), *[f.name for f in URL_ROW])
    back = V.unpack_rows(V.pack_rows(rows), URL_ROW)
    return back.select(F.col("id").alias("row_id"), "url", "referrer_id", F.col("http_status").cast("long").alias("http_status"), F.cardinality("robot_exclusion_reasons").cast("long").alias("n_reasons"), F.cardinality("response_headers").cast("long").alias("n_headers"))


def read_v1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "stored_rows").filter(F.try_parse_json("body").isNotNull()).select("raw_id", "body")
    read = V.read_rows(rows, 1).select("raw_id", "url", "referrer_id", F.round(F.col("fetched"), 3).alias("fetched"), F.col("http_status").cast("long").alias("http_status"), "redirects_to")
    return read.filter("url is not null").select("raw_id", "url", "fetched", "http_status")


def unpack_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = V.unpack_messages(table(spark, sf_dir, "frontier_messages").select("delivery_id", "frontier_message"), "frontier_message", RECORD)
    return read.select("delivery_id", F.when(~F.col("corrupt"), F.col("record.id")).alias("id"), F.when(~F.col("corrupt"), F.col("record.url")).alias("url"))


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = V.unpack_messages(table(spark, sf_dir, "frontier_messages").select("delivery_id", "frontier_message"), "frontier_message", RECORD)
    return read.filter("corrupt").select("delivery_id")


def old_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages near the end of the time a queue keeps them, counted from the last one."""
    rows = table(spark, sf_dir, "frontier_messages").select("delivery_id", "received_at")
    now = rows.agg(F.max("received_at")).scalar()
    return rows.filter(F.col("received_at") < now - F.expr("interval 1 hour")).select("delivery_id")


def log_rows_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"), F.col("text").alias("stacktrace"))
    return O.log_rows(rows).select("doc_id", F.md5(F.col("message").cast("binary")).alias("message"), F.md5(F.col("stacktrace").cast("binary")).alias("stacktrace"))


QUERIES = {
    f.__name__: f
    for f in (
        status_classes, outcome_routing, retry_split, redirect_chain, redirect_actions, read_seeds, export_seeds, purge_out_of_scope, purge_content, requeue_skipped, seed_from_reference,
        union_with_reason, topic_diff, pack_unpack_json, read_v1_rows, unpack_messages, dead_letters, old_messages, log_rows_trimmed,
    )
}

_CODES = ", ".join(map(str, REDIRECT_STATUSES))
_REDIRECTS = f"http_status IN ({_CODES})"
_TO = "regexp_replace(redirects_to, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '')"
_ERROR = "(http_status IS NULL OR http_status >= 400)"
_SCOPED = f"SELECT row_id, raw_url, url, http_status, {ID} AS id, {DOMAIN} AS domain FROM crawled_urls"
_BYTES = "try(from_base64(frontier_message))"
_TEXT = f"try(decode({_BYTES}))"
_MESSAGES = f"SELECT delivery_id, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN t END AS t FROM (SELECT delivery_id, {_TEXT} AS t FROM frontier_messages) AS m"
_TARGET_SITE = "regexp_extract(location, '^([a-zA-Z]+://[^/?#:]*)', 1)"

SQL = {
    "status_classes": """
SELECT CASE WHEN http_status BETWEEN 100 AND 599 THEN CAST(http_status // 100 AS VARCHAR) || 'xx' WHEN http_status IS NOT NULL THEN 'error' END AS status_class, CAST(count(*) AS BIGINT) AS n
FROM crawled_urls GROUP BY 1""",
    "outcome_routing": f"""
SELECT outcome, CAST(count(*) AS BIGINT) AS n, min(row_id) AS first_row FROM (
  SELECT row_id, CASE WHEN contains(url, '/tags/') THEN 'skipped' WHEN {_REDIRECTS} THEN 'redirected'
    WHEN {_ERROR} AND (http_status = 410 OR starts_with(url, 'https')) THEN 'failed' WHEN {_ERROR} THEN 'requeue' ELSE 'crawled' END AS outcome
  FROM (SELECT row_id, url, http_status FROM crawled_urls UNION ALL SELECT row_id, url, http_status FROM redirected_urls) AS u) AS o GROUP BY outcome""",
    "retry_split": f"""
SELECT row_id, CASE WHEN NOT {_ERROR} THEN 'done' WHEN http_status = 410 THEN 'failed' ELSE 'requeue' END AS first_try, CASE WHEN NOT {_ERROR} THEN 'done' ELSE 'failed' END AS second_try
FROM crawled_urls""",
    "redirect_chain": f"""
WITH RECURSIVE edges AS (
  SELECT id, target FROM (SELECT {ID} AS id, {_TO} AS target, row_number() OVER (PARTITION BY {ID} ORDER BY row_id) AS rn FROM redirected_urls WHERE redirects_to IS NOT NULL) AS e WHERE rn = 1),
chain AS (
  SELECT id, target AS final_id, 1 AS hops FROM edges
  UNION ALL SELECT c.id, e.target, c.hops + 1 FROM chain c JOIN edges e ON c.final_id = e.id WHERE c.hops < 20 AND c.id <> c.final_id)
SELECT id, final_id, CAST(hops AS BIGINT) AS hops, id = final_id AS looped, hops = 20 AND id <> final_id AND final_id IN (SELECT id FROM edges) AS too_many
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops DESC) AS rn FROM chain) AS x WHERE rn = 1""",
    "redirect_actions": f"""
WITH r AS (
  SELECT row_id, url, http_status, (SELECT max(e.value) FROM (SELECT unnest(map_entries(response_headers)) AS e) AS h WHERE lower(e.key) = 'location') AS location FROM redirected_urls),
t AS (
  SELECT row_id, url, http_status, CASE WHEN location IS NULL THEN NULL ELSE lower({_TARGET_SITE}) || lower(regexp_extract(location, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) || regexp_extract(location, '^[^?#]*(.*)$', 1) END AS target FROM r)
SELECT row_id, target, CASE WHEN NOT ({_REDIRECTS}) OR http_status IS NULL OR target IS NULL THEN 'none' WHEN target = url THEN 'self'
  WHEN regexp_replace(target, '^[a-z]+://', '') = {ID} THEN 'refetch' ELSE 'follow' END AS action, CASE WHEN http_status IS NOT NULL THEN NOT ({_REDIRECTS}) OR http_status = 300 END AS keeps_body FROM t""",
    "read_seeds": f"""
SELECT DISTINCT regexp_replace(regexp_replace(canonical, '^[a-z]+://', ''), '^([^/?#]+)(\\?|$)', '\\1/\\2') AS id, true AS is_seed
FROM ({URL_SQL['url_canonical']}) AS c""",
    "export_seeds": f"SELECT DISTINCT url FROM ({_SCOPED}) AS s WHERE {scope_sql('url', 'id', 'domain')} = 1",
    "purge_out_of_scope": f"SELECT row_id, {scope_sql('url', 'id', 'domain')} <> 1 AND NOT (ends_with(id, 'robots.txt') OR ends_with(id, 'sitemap.xml')) AS purged FROM ({_SCOPED}) AS s",
    "purge_content": f"""
SELECT content_id FROM crawled_content WHERE s3_key IS NULL OR s3_key NOT IN (
  SELECT rtrim(id, '?/') FROM ({_SCOPED}) AS s WHERE {scope_sql('url', 'id', 'domain')} <> 1 AND NOT (ends_with(id, 'robots.txt') OR ends_with(id, 'sitemap.xml')))""",
    "seed_from_reference": f"""
SELECT DISTINCT id FROM (SELECT url, {ID} AS id, {DOMAIN} AS domain FROM redirected_urls) AS r WHERE {scope_sql('url', 'id', 'domain')} = 1 AND id NOT IN (SELECT {ID} FROM seen_urls)""",
    "union_with_reason": """
SELECT reason, referrer, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'ignored' AS reason, referrer_id AS referrer FROM redirected_urls UNION ALL SELECT 'external', referrer_id FROM crawled_urls) AS u GROUP BY reason, referrer""",
    "topic_diff": f"SELECT {_TO} AS id FROM redirected_urls WHERE redirects_to IS NOT NULL EXCEPT (SELECT {ID} FROM crawled_urls UNION ALL SELECT {ID} FROM redirected_urls)",
    "requeue_skipped": f"""
SELECT row_id FROM (
  SELECT row_id, url, {ID} AS id, {DOMAIN} AS domain FROM (SELECT c.row_id, c.canonical AS url FROM ({URL_SQL['url_canonical']}) AS c JOIN crawled_urls r ON c.row_id = r.row_id WHERE r.http_status = 200) AS x) AS s
WHERE {scope_sql('url', 'id', 'domain')} = 1""",
    "pack_unpack_json": """
SELECT row_id, left(url, 1024) AS url, left(referrer_id, 1024) AS referrer_id, CAST(http_status AS BIGINT) AS http_status, CAST(len(robot_exclusion_reasons) AS BIGINT) AS n_reasons,
  CAST(cardinality(response_headers) AS BIGINT) AS n_headers FROM crawled_urls""",
    "read_v1_rows": r"""
SELECT raw_id, url, CASE WHEN regexp_matches(c, '^\d{4}-') THEN round(epoch_us(CAST(c AS TIMESTAMP)) / 1000000.0, 3) END AS fetched, try_cast(s AS BIGINT) AS http_status FROM (
  SELECT raw_id, body->>'$.url' AS url, body->>'$.lastCrawled' AS c, body->>'$.httpStatus' AS s FROM stored_rows WHERE json_valid(body)) AS r WHERE url IS NOT NULL""",
    "unpack_messages": f"SELECT delivery_id, t->>'$.id' AS id, t->>'$.url' AS url FROM ({_MESSAGES}) AS m",
    "dead_letters": f"SELECT delivery_id FROM ({_MESSAGES}) AS m WHERE t IS NULL",
    "old_messages": "SELECT delivery_id FROM frontier_messages WHERE received_at < (SELECT max(received_at) FROM frontier_messages) - INTERVAL 1 HOUR",
    "log_rows_trimmed": "SELECT doc_id, md5(left(text, 1024)) AS message, md5(right(text, 1024)) AS stacktrace FROM documents",
}
