"""Queries on the frontier as files, on fetches that may come from a store, and on the gauges and loads of consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import address_id
from skein.operators import content as C
from skein.operators import frontier as Q
from skein.operators import reports as R
from skein.plans.content import SQL as CONTENT_SQL
from skein.plans.content import use_cached_decision
from skein.plans.frontier import SQL as FRONTIER_SQL
from skein.plans.frontier import _ACTIVITY, _DEQUEUES, _HELD, _consumers, _dequeues, _held, available_queues, fetchers_needed, queue_activity
from skein.plans.frontier import _CONSUMERS as CONSUMERS_SQL
from skein.plans.urls import ID
from skein.runtime import fresh_dir, table
from skein.sources import frontier_files as files

CORES, RUNNING = 8, 3
BUDGET, PRICE = 100.0, 0.067
GAUGES = {
    "queues": "Count", "active_queues": "Count", "per_queue_dequeue_rate": "Count/Second", "total_dequeue_rate": "Count/Second",
    "unassigned_queues": "Count", "available_queues": "Count", "ave_queues_per_consumer": "Count", "fetchers_needed": "Count", "consumers": "Count",
    "affordable_instances": "Count", "is_scaling": "Count", "frontier_dequeue_rate": "Count/Second", "frontier_request_rate": "Count/Second",
}


def frontier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier written to files in two parts, a queue deleted in between, and read back."""
    messages = table(spark, sf_dir, "frontier_messages").select("delivery_id", "msg_id", "queue", "frontier_message", "received_at")
    folder = fresh_dir(spark, "frontier")
    odd = F.col("delivery_id") % 2 == 1
    files.persist(messages.filter(odd), folder)
    files.delete_queues(messages.agg(F.min("queue").alias("queue")), folder)
    files.persist(messages.filter(~odd), folder)
    return files.restore(spark, folder).select("delivery_id", "queue")


def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each page is had: from the cache, not modified since, fetched again as its body is gone, or fetched; the status of its row stands for the answer."""
    rows = table(spark, sf_dir, "crawled_urls").select("row_id", address_id(F.col("url")).alias("id"), "fetched", "http_status", C.header(F.col("response_headers"), "etag").alias("etag"))
    store = table(spark, sf_dir, "crawled_content").groupBy(F.col("s3_key").alias("key")).agg(F.max("content_id").alias("body"))
    stored = C.cache_lookup(rows, store).withColumnRenamed("stored_body", "content_id")
    marked = stored.join(use_cached_decision(spark, sf_dir), "row_id")
    return C.fetch_plan(marked.withColumnRenamed("http_status", "answer")).select("row_id", "had", F.when(F.col("had").isin("cache", "not_modified"), F.col("content_id")).alias("content_id"))


def frontier_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gauges of each consumer and of the frontier as a whole."""
    log = _dequeues(spark, sf_dir)
    at = F.col("ts").cast("timestamp").cast("double")
    seconds = log.agg((F.max(at) - F.min(at)).alias("s")).scalar()
    taken = log.filter(~F.col("empty")).groupBy(F.pmod("consumer", F.lit(10)).alias("consumer")).agg(F.count(F.lit(1)).alias("n"))
    held = _consumers(spark, sf_dir).withColumnsRenamed({"active": "active_queues"}).join(taken, "consumer", "left")
    rate = F.coalesce("n", F.lit(0)) / seconds
    own = held.select("consumer", "queues", "active_queues", F.round(rate / F.col("queues"), 9).alias("per_queue_dequeue_rate"), F.round(rate, 9).alias("total_dequeue_rate"))
    each = R.metric_rows(own, {n: GAUGES[n] for n in own.columns[1:]}, "consumer").select("name", "unit", F.element_at("dimensions", "consumer").alias("consumer"), "value")
    needed, free = fetchers_needed(spark, sf_dir).select("needed").scalar(), available_queues(spark, sf_dir)
    rates = log.agg(F.count_if(~F.col("empty")).alias("n"), F.count(F.lit(1)).alias("asked"))
    total = _consumers(spark, sf_dir).agg(F.count(F.lit(1)).alias("consumers"), F.sum("active").alias("active_queues"), F.round(F.avg("queues"), 6).alias("ave_queues_per_consumer"))
    affordable = Q.affordable(F.lit(BUDGET), F.lit(PRICE))
    whole = total.select(
        "consumers", "active_queues", "ave_queues_per_consumer", free.select("unassigned").scalar().alias("unassigned_queues"), free.select("available").scalar().alias("available_queues"),
        needed.alias("fetchers_needed"), affordable.alias("affordable_instances"), (Q.scale_plan(affordable, needed, F.lit(0)) > 0).cast("int").alias("is_scaling"),
        F.round(rates.select("n").scalar() / seconds, 9).alias("frontier_dequeue_rate"), F.round(rates.select("asked").scalar() / seconds, 9).alias("frontier_request_rate"),
    )
    overall = R.metric_rows(whole, {n: GAUGES[n] for n in whole.columns}).select("name", "unit", F.lit(None).cast("string").alias("consumer"), "value")
    return each.union(overall)


def scale_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetchers to start on this machine."""
    return fetchers_needed(spark, sf_dir).select("needed", Q.scale_local(F.lit(CORES), F.lit(RUNNING), F.col("needed")).alias("to_start"))


def load_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each consumer that asks for work is given, by itself: the queues of consumer 0 are unassigned."""
    states = queue_activity(spark, sf_dir).select("queue", F.col("skips").alias("waiting"))
    held = _held(spark, sf_dir).join(states, "queue")
    unassigned = held.filter("consumer = 0 and queue % 2 = 0 and not active").select("queue", "active", "waiting")
    owned = held.filter("consumer <> 0").select("consumer", "queue", "active", "assigned")
    return Q.load(owned.select("consumer").distinct(), unassigned.filter("waiting > 3"), owned)


QUERIES = {f.__name__: f for f in (frontier_files, fetch_plan, frontier_gauges, scale_local, load_consumers)}

_SECONDS = "(SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 FROM events)"
_RATES = f"SELECT consumer % 10 AS consumer, count(*) AS n FROM ({_DEQUEUES}) AS d WHERE NOT empty GROUP BY 1"
_EACH = f"SELECT c.consumer, c.queues, c.active, coalesce(r.n, 0) / {_SECONDS} AS rate FROM ({CONSUMERS_SQL}) AS c LEFT JOIN ({_RATES}) AS r ON c.consumer = r.consumer"
_AFFORDABLE = f"CAST(floor({BUDGET} / 744.0 / {PRICE}) AS BIGINT)"
_FREE, _NEED = FRONTIER_SQL["available_queues"], FRONTIER_SQL["fetchers_needed"]
_WHOLE = {
    "consumers": f"(SELECT count(*) FROM ({CONSUMERS_SQL}) AS c)", "active_queues": f"(SELECT sum(active) FROM ({CONSUMERS_SQL}) AS c)",
    "ave_queues_per_consumer": f"(SELECT round(avg(queues), 6) FROM ({CONSUMERS_SQL}) AS c)",
    "unassigned_queues": f"(SELECT unassigned FROM ({_FREE}) AS f)", "available_queues": f"(SELECT available FROM ({_FREE}) AS f)", "fetchers_needed": f"(SELECT needed FROM ({_NEED}) AS f)",
    "affordable_instances": _AFFORDABLE, "is_scaling": f"(SELECT CASE WHEN least({_AFFORDABLE}, needed) > 0 THEN 1 ELSE 0 END FROM ({_NEED}) AS f)",
    "frontier_dequeue_rate": f"(SELECT round(count(*) FILTER (WHERE NOT empty) / {_SECONDS}, 9) FROM ({_DEQUEUES}) AS d)", "frontier_request_rate": f"(SELECT round(count(*) / {_SECONDS}, 9) FROM ({_DEQUEUES}) AS d)",
}
_GAUGE = "SELECT '{0}' AS name, '{1}' AS unit, CAST(consumer AS VARCHAR) AS consumer, CAST({2} AS DOUBLE) AS value FROM ({3}) AS e"
_PARTS = {"queues": "queues", "active_queues": "active", "per_queue_dequeue_rate": "round(rate / queues, 9)", "total_dequeue_rate": "round(rate, 9)"}

SQL = {
    "frontier_files": "SELECT delivery_id, queue FROM frontier_messages WHERE delivery_id % 2 = 0 OR queue IS NULL OR queue <> (SELECT min(queue) FROM frontier_messages)",
    "fetch_plan": f"""
SELECT row_id, had, CASE WHEN had IN ('cache', 'not_modified') THEN body END AS content_id FROM (
  SELECT c.row_id, s.body, CASE WHEN u.use_cached AND s.body IS NOT NULL THEN 'cache'
    WHEN c.http_status = 304 AND (c.fetched IS NOT NULL OR t.etag IS NOT NULL) THEN CASE WHEN s.body IS NOT NULL THEN 'not_modified' ELSE 'again' END ELSE 'fetched' END AS had
  FROM (SELECT row_id, fetched, http_status, {ID} AS id FROM crawled_urls) AS c JOIN ({CONTENT_SQL['use_cached_decision']}) AS u ON c.row_id = u.row_id
  LEFT JOIN (SELECT row_id, max(e.value) AS etag FROM (SELECT row_id, unnest(map_entries(response_headers)) AS e FROM crawled_urls) AS h WHERE lower(e.key) = 'etag' GROUP BY row_id) AS t ON c.row_id = t.row_id
  LEFT JOIN (SELECT s3_key, max(content_id) AS body FROM crawled_content GROUP BY s3_key) AS s ON rtrim(c.id, '?/') = s.s3_key) AS x""",
    "frontier_gauges": " UNION ALL ".join(
        [_GAUGE.format(n, GAUGES[n], v, _EACH) for n, v in _PARTS.items()] + [f"SELECT '{n}', '{GAUGES[n]}', NULL, CAST({v} AS DOUBLE)" for n, v in _WHOLE.items()]
    ),
    "scale_local": f"SELECT needed, CAST(greatest(0, {CORES} - {RUNNING} - needed) AS BIGINT) AS to_start FROM ({_NEED}) AS f",
    "load_consumers": f"""
WITH h AS (SELECT h.*, a.skips AS waiting FROM ({_HELD}) AS h JOIN ({_ACTIVITY}) AS a ON h.queue = a.queue),
u AS (SELECT min(queue) FILTER (WHERE active) AS best, min(queue) FILTER (WHERE waiting > 0) AS some FROM h WHERE consumer = 0 AND queue % 2 = 0 AND NOT active AND waiting > 3),
c AS (SELECT consumer, count(*) FILTER (WHERE active) - count(*) // 2 AS spare, arg_max(queue, epoch_us(assigned) * 1000 + queue) FILTER (WHERE active) AS youngest FROM h WHERE consumer <> 0 GROUP BY consumer),
d AS (SELECT *, row_number() OVER (ORDER BY spare DESC, consumer) AS place FROM c WHERE spare > 0),
p AS (SELECT c.consumer, coalesce((SELECT min(place) FROM d WHERE d.consumer <> c.consumer)) AS place FROM c)
SELECT p.consumer, CASE WHEN u.best IS NOT NULL THEN 'active' WHEN u.some IS NOT NULL THEN 'waiting' WHEN d.consumer IS NOT NULL THEN 'donated' ELSE 'stop' END AS step,
  coalesce(u.best, u.some, d.youngest) AS queue, CASE WHEN u.best IS NULL AND u.some IS NULL THEN d.consumer END AS donor
FROM p CROSS JOIN u LEFT JOIN d ON p.place = d.place""",
}
