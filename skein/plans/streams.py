"""Streaming queries. Each is run to the end of its input; its SQL is the batch definition of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.ids import address_id, message_key
from skein.operators import redundancy as R
from skein.operators.hierarchy import address_links, depths
from skein.plans.content import SQL as CONTENT_SQL
from skein.plans.urls import ID
from skein.runtime import fresh_dir, table
from skein.streaming import windows as S

SLICES = 6  # runs in which the deliveries of the late query come in


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.open_stream(spark, f"{sf_dir}/events.parquet", ["event_id", "ts", "user_id", "event_type"], "ts")


def stream_rate_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = S.run_to_end(S.rates(_events(spark, sf_dir), "ts", ["event_type"], "1 hour"), "tumbling")
    return held.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_rate_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = S.run_to_end(S.rates(_events(spark, sf_dir), "ts", ["event_type"], "1 hour", "20 minutes"), "sliding")
    return held.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_consumer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = S.run_to_end(S.sessions(_events(spark, sf_dir), "ts", "user_id", "2 hours"), "sessions")
    return held.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def stream_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.open_stream(spark, f"{sf_dir}/seen_urls.parquet", ["url"])
    return S.run_to_end(S.first_seen(rows.select(address_id(F.col("url")).alias("id")), ["id"]), "seen")


def stream_late_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries split by the watermark, an hour behind the newest time that came before; they come in SLICES runs of one stream, in the order of their batches."""
    rows = table(spark, sf_dir, "frontier_messages").select("delivery_id", F.col("received_at").cast("timestamp").alias("received_at"), "batch_no")
    last = rows.agg(F.max("batch_no")).first()[0] or 0
    root = fresh_dir(spark, "late")
    sliced = rows.withColumn("slice", F.floor(F.coalesce("batch_no", F.lit(0)) * SLICES / (last + 1)).cast("int"))
    for i in range(SLICES):
        sliced.filter(F.col("slice") == i).drop("batch_no", "slice").write.mode("append").parquet(f"{root}/in")
        stream = S.read_stream(spark, f"{root}/in", T.StructType.fromDDL("delivery_id long, received_at timestamp"), 1 << 60)
        S.continue_to_end(S.split_late(stream, "delivery_id", "received_at", "1 hour"), root)
    return spark.read.schema("delivery_id long, side string").parquet(f"{root}/out")


def stream_redundancy_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports kept as state per node; the last value of each node."""
    rows = S.open_stream(spark, f"{sf_dir}/crawled_urls.parquet", ["row_id", "url", "original"])
    log = rows.filter("original is not null").select(F.col("row_id").alias("seq"), address_id(F.col("url")).alias("id"), (F.col("original") != "self").alias("redundant"))

    def work(batch: DataFrame, number: int, folder: str) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    folder = S.run_batches(R.support(log), "redundancy", work, "update")
    held = spark.read.schema("domain string, node string, support long, batch long").parquet(f"{folder}/out")
    last = held.groupBy("domain", "node").agg(F.max(F.struct("batch", "support")).getField("support").alias("support"))
    return last.withColumn("node", F.replace("node", F.lit("\u0001"), F.lit("|")))


def _crawl(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links (node, parent) of the pages, one of each page that has a parent, and the seeds (node), which have none."""
    sent = table(spark, sf_dir, "redirected_urls")
    columns = ["row_id", "url", "referrer_id"]
    nodes, links = address_links(table(spark, sf_dir, "crawled_urls").select(columns).union(sent.select(columns)), sent.select("row_id", "url", "redirects_to"))
    return links, nodes.join(links.select("node"), "node", "left_anti").select("node")


def stream_crawl_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages reached from those without a parent by generation, down to the last one.

    A page has one parent, so its generation is its depth, which doubling finds in a number of rounds that grows with
    the logarithm of the deepest one. Pages on or below a cycle of links are reached from no seed.
    """
    links, seeds = _crawl(spark, sf_dir)
    reached = depths(links).select(F.col("depth").alias("generation")).union(seeds.select(F.lit(0).cast("long")))
    return reached.groupBy("generation").agg(F.count(F.lit(1)).alias("n"))


def stream_message_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct messages of each queue, counted from a stream of deliveries."""
    rows = S.open_stream(spark, f"{sf_dir}/frontier_messages.parquet", ["msg_id", "queue"]).filter("msg_id is not null")
    keys = S.run_to_end(S.first_seen(rows.select("queue", message_key(F.col("msg_id")).alias("k")), ["queue", "k"]), "keys")
    return keys.groupBy("queue").agg(F.count(F.lit(1)).alias("n_messages"))


QUERIES = {
    f.__name__: f
    for f in (
        stream_rate_tumbling, stream_rate_sliding, stream_consumer_sessions, stream_seen_dedup, stream_late_side_output, stream_redundancy_state, stream_crawl_generations,
        stream_message_keys,
    )
}

_WATERMARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTES FROM events)"

SQL = {
    "stream_rate_tumbling": f"""
SELECT start, event_type, n FROM (SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2) AS w WHERE start + INTERVAL 1 HOUR <= {_WATERMARK}""",
    "stream_rate_sliding": f"""
SELECT start, event_type, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT time_bucket(INTERVAL '20 minutes', ts) - INTERVAL 20 MINUTES * k AS start, event_type FROM (SELECT ts, event_type, unnest([0, 1, 2]) AS k FROM events) AS e) AS w
WHERE start + INTERVAL 1 HOUR <= {_WATERMARK} GROUP BY 1, 2""",
    "stream_consumer_sessions": f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 2 HOURS <= {_WATERMARK}""",
    "stream_seen_dedup": f"SELECT DISTINCT {ID} AS id FROM seen_urls",
    "stream_late_side_output": f"""
WITH r AS (SELECT delivery_id, received_at, CAST(floor(coalesce(batch_no, 0) * {SLICES} / ((SELECT coalesce(max(batch_no), 0) FROM frontier_messages) + 1)) AS INT) AS s FROM frontier_messages),
w AS (SELECT x.s, (SELECT max(date_trunc('millisecond', received_at)) FROM r WHERE r.s < x.s) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT s FROM r) AS x)
SELECT delivery_id, CASE WHEN coalesce(received_at < mark, false) THEN 'late' ELSE 'main' END AS side FROM r JOIN w ON r.s = w.s""",
    "stream_redundancy_state": CONTENT_SQL["redundancy_support"],
    "stream_message_keys": r"""
SELECT queue, CAST(count(*) AS BIGINT) AS n_messages FROM (
  SELECT DISTINCT queue, CASE WHEN length(regexp_replace(msg_id, '[\s{}]', '', 'g')) = 36 THEN lower(regexp_replace(msg_id, '[\s{}]', '', 'g')) ELSE msg_id END AS k
  FROM frontier_messages WHERE msg_id IS NOT NULL) AS k GROUP BY queue""",
    "stream_crawl_generations": rf"""
WITH RECURSIVE rows_ AS (SELECT row_id, {ID} AS id, referrer_id FROM crawled_urls UNION ALL SELECT row_id, {ID} AS id, referrer_id FROM redirected_urls),
node AS (SELECT id, min(row_id) AS node, arg_min(referrer_id, row_id) FILTER (WHERE referrer_id IS NOT NULL) AS ref FROM rows_ GROUP BY id),
sent AS (SELECT regexp_replace(redirects_to, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS id, arg_min({ID}, row_id) AS source FROM redirected_urls WHERE redirects_to IS NOT NULL GROUP BY 1),
parent AS (SELECT n.node, p.node AS parent FROM node n LEFT JOIN sent s ON n.id = s.id LEFT JOIN node p ON p.id = coalesce(s.source, n.ref)),
walk AS (SELECT node, 0 AS generation FROM parent WHERE parent IS NULL UNION ALL SELECT p.node, w.generation + 1 FROM walk w JOIN parent p ON p.parent = w.node)
SELECT CAST(generation AS BIGINT) AS generation, CAST(count(*) AS BIGINT) AS n FROM walk GROUP BY generation""",
}
