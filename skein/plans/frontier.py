"""Queries on queues, their consumers and their schedule.

``events`` stands for a log of dequeues: user_id is the consumer, props.k the queue, error a probe that found nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import address_id, host_of
from skein.operators import frontier as Q
from skein.operators.ranking import place
from skein.plans.urls import DOMAIN
from skein.runtime import table

DNS = [("ochre-market.example", "192.0.2.10"), ("www.yarrowatlas.test", "192.0.2.11"), ("kestrel-depot.example", "192.0.2.10"), ("forum.larchguild.test", None)]
INSTANCES = [("i-0", "running"), ("i-1", "terminated"), ("i-2", "shutting-down"), ("i-4", "pending")]
PRICES = [("m1.small", 0.044, 0.01, 3, 1), ("m3.medium", 0.067, 0.02, 10, 2), ("c3.large", 0.105, 0.12, 0, 1)]
ORDER = ["received_at", "delivery_id"]


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "frontier_messages").select("delivery_id", "queue", "received_at", "receive_count")


def _dequeues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "ts", F.col("user_id").alias("consumer"), F.get_json_object("props", "$.k").cast("long").alias("queue"), (F.col("event_type") == "error").alias("empty"), "value")


def queue_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    dns = spark.createDataFrame(DNS, "domain string, ip string")
    rows = table(spark, sf_dir, "crawled_urls").select("row_id", host_of(address_id(F.col("url"))).alias("domain"))
    return Q.resolve(rows, dns).select("row_id", "queue_key", Q.queue_name(F.lit("harvest"), F.col("queue_key")).alias("queue"))


def queue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.batches(_messages(spark, sf_dir), "queue", ORDER).select("delivery_id", "rn", "batch")


def group_by_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writes of each queue: at most ten messages each, so no list grows with its queue."""
    own = Q.batches(_messages(spark, sf_dir), "queue", ORDER)
    lists = own.groupBy("queue", "batch").agg(F.array_sort(F.collect_list(F.struct("rn", "delivery_id"))).alias("m"))
    return lists.select("queue", "batch", F.array_join(F.transform("m", lambda x: x["delivery_id"].cast("string")), ",").alias("deliveries"))


def politeness_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = Q.polite_schedule(_messages(spark, sf_dir), "queue", ORDER)
    return slots.select("delivery_id", F.round("slot", 4).alias("slot"))


def round_robin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.round_robin(_messages(spark, sf_dir), "queue", ORDER).select("delivery_id", "turn")


def dequeue_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.dequeue_gaps(_dequeues(spark, sf_dir), "consumer", "ts", "event_id").select("event_id", F.round("gap", 3).alias("gap"))


def consumer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = Q.dequeue_gaps(_dequeues(spark, sf_dir), "consumer", "ts", "event_id")
    return Q.consumer_rates(gaps, "consumer").select("consumer", "n_dequeues", F.round("mean_interval", 3).alias("mean_interval"))


def consumer_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles between dequeues from the consumer's first queue, here queue 0."""
    held = Q.cycles(_dequeues(spark, sf_dir), "consumer", ["ts", "event_id"], F.col("queue") == 0)
    return held.select("consumer", "cycle", "length", F.round("seconds", 3).alias("seconds"))


def _seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.seniority(_dequeues(spark, sf_dir), "consumer", "queue")


def consumer_seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seniority(spark, sf_dir).select("consumer", F.round("seniority", 6).alias("seniority"))


def least_senior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first consumer is protected."""
    ranked = _seniority(spark, sf_dir)
    first = ranked.agg(F.min("consumer")).scalar()
    return Q.least_senior(ranked, "consumer", F.col("consumer") == first).select("consumer", F.round("seniority", 6).alias("seniority"))


def queue_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.queue_states(_dequeues(spark, sf_dir), "queue", "ts", F.col("empty"))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(queue, consumer, active, assigned): who has a queue (the one that was there last) and since when."""
    last = _dequeues(spark, sf_dir).groupBy("queue").agg(F.max(F.struct("ts", "event_id", "consumer")).alias("l"), F.min("ts").alias("assigned"))
    return last.join(queue_activity(spark, sf_dir), "queue").select("queue", F.pmod(F.col("l.consumer"), F.lit(10)).alias("consumer"), "active", "assigned")


def _consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _held(spark, sf_dir).groupBy("consumer").agg(F.count_if("active").alias("active"), F.count(F.lit(1)).alias("queues"))
    return counted.withColumn("needed", F.floor(F.col("queues") / 2).cast("long"))


def available_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active queues of consumer 0, which gives its up, and consumers that can donate."""
    own = _held(spark, sf_dir).agg(F.count_if(F.col("active") & (F.col("consumer") == 0)).alias("unassigned"))
    donors = _consumers(spark, sf_dir).filter("consumer <> 0").agg(F.count_if(F.greatest(F.col("active") - F.col("needed"), F.lit(0)) > 0).alias("donors"))
    return own.withColumn("donors", donors.scalar()).withColumn("available", F.col("unassigned") + F.col("donors"))


def fetchers_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available queues by the mean of active queues, a whole number; 0 if the mean is 0."""
    mean = _consumers(spark, sf_dir).agg(F.coalesce(F.expr("sum(active) div nullif(count(*), 0)"), F.lit(0)).alias("mean_active"))
    both = available_queues(spark, sf_dir).withColumn("mean_active", mean.scalar())
    return both.select("available", "mean_active", F.coalesce(F.expr("available div nullif(mean_active, 0)"), F.lit(0)).alias("needed"))


def donor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _consumers(spark, sf_dir).withColumn("consumer", F.col("consumer").cast("string"))
    return Q.donor(rows, "0").select("consumer", "spare")


def youngest_active_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max(F.when(F.col("active"), F.struct("assigned", "queue")))
    return _held(spark, sf_dir).groupBy("consumer").agg(best.getField("queue").alias("queue"))


def first_matching_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each consumer its first active queue, else its first."""
    best = F.min(F.struct((~F.col("active")).alias("a"), F.col("queue").alias("queue")))
    return _held(spark, sf_dir).groupBy("consumer").agg(best.getField("queue").alias("queue"))


def disperse_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _messages(spark, sf_dir).select("queue").distinct()
    return Q.disperse(names, 7, ["queue"])


def dead_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances whose consumers have all been silent for two hours at the end of the log and that are not live."""
    last = _dequeues(spark, sf_dir).groupBy("consumer").agg(F.max("ts").alias("last"))
    end = _dequeues(spark, sf_dir).agg(F.max("ts")).scalar()
    silent = last.withColumn("silent", F.col("last") < end - F.expr("interval 2 hours"))
    by = silent.groupBy(F.concat(F.lit("i-"), F.pmod("consumer", F.lit(50)).cast("string")).alias("instance")).agg(F.bool_and("silent").alias("all_silent"))
    states = spark.createDataFrame(INSTANCES, "instance string, state string")
    live = F.coalesce(F.col("state").isin("running", "pending"), F.lit(False))
    return by.join(states, "instance", "left").filter(F.col("all_silent") & ~live).select("instance")


def frontier_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _messages(spark, sf_dir).groupBy("queue").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("receive_count") > 1).alias("again"))
    return sizes.agg(F.sum("n").alias("n_messages"), F.count("queue").alias("n_queues"), F.count_if(F.col("again") > 0).alias("n_queues_again"))


def crawl_rate_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").withColumn("hour", F.window("ts", "1 hour")["start"].cast("timestamp_ntz"))
    return hours.groupBy("hour", "event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("per_second", F.round(F.col("n") / 3600.0, 6))


def consumer_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each message in its consumer's day, one queue after the other."""
    rows = _dequeues(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return place(rows, ["consumer", "day"], ["ts", "event_id"]).select("event_id", "rn")


def spot_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(PRICES, "machine string, on_demand double, average double, needed long, open long")
    return rows.select("machine", F.round(Q.spot_bid(F.col("average"), F.col("on_demand")), 6).alias("bid"))


def scale_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(PRICES, "machine string, on_demand double, average double, needed long, open long")
    able = Q.affordable(F.lit(100.0), F.col("on_demand"))
    return rows.select("machine", able.alias("affordable"), Q.scale_plan(able, F.col("needed"), F.col("open")).alias("start"), F.round(F.col("open") * F.col("on_demand"), 6).alias("hourly_cost"))


QUERIES = {
    f.__name__: f
    for f in (
        queue_key, queue_batches, group_by_queue, politeness_schedule, round_robin_order, dequeue_gaps, consumer_rates, consumer_cycles, consumer_seniority, least_senior,
        queue_activity, available_queues, fetchers_needed, donor_choice, youngest_active_queue, first_matching_queue, disperse_queues, dead_consumers, frontier_size,
        crawl_rate_per_hour, consumer_queues, spot_bid, scale_plan,
    )
}

_DNS = ", ".join(f"('{d}', {repr(ip) if ip else 'NULL'})" for d, ip in DNS)
_DEQUEUES = "SELECT event_id, ts, user_id AS consumer, CAST(props->>'$.k' AS BIGINT) AS queue, event_type = 'error' AS empty FROM events"
_NUMBERED = "SELECT delivery_id, queue, row_number() OVER (PARTITION BY queue ORDER BY received_at, delivery_id) AS rn FROM frontier_messages"
_GAPS = f"SELECT event_id, consumer, epoch_us(ts) / 1000000.0 - epoch_us(lag(ts) OVER (PARTITION BY consumer ORDER BY ts, event_id)) / 1000000.0 AS gap FROM ({_DEQUEUES}) AS d"
_SENIORITY = f"SELECT consumer, ln(count(queue)) * count(DISTINCT queue) AS seniority FROM ({_DEQUEUES}) AS d GROUP BY consumer"
_ACTIVITY = f"""
SELECT queue, k AS empties, CAST(failed - k * (k + 1) // 2 AS BIGINT) AS skips, failed = 0 AS active, failed - k * (k + 1) // 2 >= k AS presumed_active FROM (
  SELECT queue, failed, CAST(floor((sqrt(8 * failed + 1) - 1) / 2) AS BIGINT) AS k FROM (
    SELECT d.queue, count(*) FILTER (WHERE empty AND (l.last IS NULL OR d.ts > l.last)) AS failed
    FROM ({_DEQUEUES}) AS d LEFT JOIN (SELECT queue, max(ts) AS last FROM ({_DEQUEUES}) AS e WHERE NOT empty GROUP BY queue) AS l ON d.queue = l.queue GROUP BY d.queue) AS f) AS g
"""
_HELD = f"""
SELECT a.queue, a.active, h.consumer, h.assigned FROM ({_ACTIVITY}) AS a JOIN (
  SELECT queue, consumer % 10 AS consumer, assigned FROM (
    SELECT queue, consumer, min(ts) OVER (PARTITION BY queue) AS assigned, row_number() OVER (PARTITION BY queue ORDER BY ts DESC, event_id DESC) AS rn FROM ({_DEQUEUES}) AS d) AS x WHERE rn = 1) AS h
ON a.queue = h.queue
"""
_CONSUMERS = f"SELECT consumer, count(*) FILTER (WHERE active) AS active, count(*) AS queues, count(*) // 2 AS needed FROM ({_HELD}) AS h GROUP BY consumer"
_AVAILABLE = f"""
SELECT (SELECT count(*) FROM ({_HELD}) AS h WHERE active AND consumer = 0) AS unassigned, (SELECT count(*) FROM ({_CONSUMERS}) AS c WHERE consumer <> 0 AND active - needed > 0) AS donors
"""
_PRICES = ", ".join(str(p) for p in PRICES)

SQL = {
    "queue_key": f"""
SELECT row_id, k AS queue_key, regexp_replace('harvest-' || k, '[^a-zA-Z0-9_-]', '_', 'g') AS queue FROM (
  SELECT row_id, coalesce(d.ip, r.domain) AS k FROM (SELECT row_id, {DOMAIN} AS domain FROM crawled_urls) AS r LEFT JOIN (VALUES {_DNS}) AS d(domain, ip) ON r.domain = d.domain) AS x""",
    "queue_batches": f"SELECT delivery_id, rn, (rn - 1) // 10 AS batch FROM ({_NUMBERED}) AS n",
    "group_by_queue": f"SELECT queue, (rn - 1) // 10 AS batch, string_agg(CAST(delivery_id AS VARCHAR), ',' ORDER BY rn) AS deliveries FROM ({_NUMBERED}) AS n GROUP BY 1, 2",
    "politeness_schedule": f"SELECT delivery_id, round((rn - 1) * 0.55::DOUBLE, 4) AS slot FROM ({_NUMBERED}) AS n",
    "round_robin_order": f"SELECT delivery_id, row_number() OVER (ORDER BY rn, queue) AS turn FROM ({_NUMBERED}) AS n",
    "dequeue_gaps": f"SELECT event_id, round(gap, 3) AS gap FROM ({_GAPS}) AS g",
    "consumer_rates": f"SELECT consumer, CAST(count(*) AS BIGINT) AS n_dequeues, round(avg(gap), 3) AS mean_interval FROM ({_GAPS}) AS g GROUP BY consumer",
    "consumer_cycles": f"""
SELECT consumer, cycle, CAST(count(*) AS BIGINT) AS length, round(epoch_us(max(ts)) / 1000000.0 - epoch_us(min(ts)) / 1000000.0, 3) AS seconds FROM (
  SELECT consumer, ts, CAST(sum(CASE WHEN queue = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY consumer ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cycle FROM ({_DEQUEUES}) AS d) AS c
GROUP BY consumer, cycle""",
    "consumer_seniority": f"SELECT consumer, round(seniority, 6) AS seniority FROM ({_SENIORITY}) AS s",
    "least_senior": f"SELECT consumer, round(seniority, 6) AS seniority FROM ({_SENIORITY}) AS s WHERE consumer > (SELECT min(user_id) FROM events) ORDER BY s.seniority, consumer LIMIT 1",
    "queue_activity": _ACTIVITY,
    "available_queues": f"SELECT CAST(unassigned AS BIGINT) AS unassigned, CAST(donors AS BIGINT) AS donors, CAST(unassigned + donors AS BIGINT) AS available FROM ({_AVAILABLE}) AS a",
    "fetchers_needed": f"""
SELECT CAST(available AS BIGINT) AS available, CAST(m AS BIGINT) AS mean_active, CAST(CASE WHEN m = 0 THEN 0 ELSE available // m END AS BIGINT) AS needed
FROM (SELECT (SELECT unassigned + donors FROM ({_AVAILABLE}) AS a) AS available, (SELECT sum(active) // count(*) FROM ({_CONSUMERS}) AS c) AS m) AS x""",
    "donor_choice": f"SELECT CAST(consumer AS VARCHAR) AS consumer, CAST(active - needed AS BIGINT) AS spare FROM ({_CONSUMERS}) AS c WHERE consumer <> 0 AND active - needed > 0 ORDER BY active - needed DESC, CAST(consumer AS VARCHAR) LIMIT 1",
    "youngest_active_queue": f"SELECT consumer, arg_max(queue, (epoch_us(assigned) * 1000 + queue)) FILTER (WHERE active) AS queue FROM ({_HELD}) AS h GROUP BY consumer",
    "first_matching_queue": f"SELECT consumer, arg_min(queue, CASE WHEN active THEN queue ELSE queue + 1000000 END) AS queue FROM ({_HELD}) AS h GROUP BY consumer",
    "disperse_queues": "SELECT queue, (row_number() OVER (ORDER BY queue) - 1) % 7 AS consumer_no FROM (SELECT DISTINCT queue FROM frontier_messages) AS q",
    "dead_consumers": f"""
WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id),
i AS (SELECT 'i-' || CAST(user_id % 50 AS VARCHAR) AS instance, bool_and(last < (SELECT max(ts) FROM events) - INTERVAL 2 HOURS) AS silent FROM l GROUP BY 1)
SELECT i.instance FROM i LEFT JOIN (VALUES {', '.join(str(x) for x in INSTANCES)}) AS s(instance, state) ON i.instance = s.instance
WHERE silent AND coalesce(state NOT IN ('running', 'pending'), true)""",
    "frontier_size": """
SELECT CAST(sum(n) AS BIGINT) AS n_messages, CAST(count(queue) AS BIGINT) AS n_queues, CAST(count(*) FILTER (WHERE again > 0) AS BIGINT) AS n_queues_again
FROM (SELECT queue, count(*) AS n, count(*) FILTER (WHERE receive_count > 1) AS again FROM frontier_messages GROUP BY queue) AS q""",
    "crawl_rate_per_hour": "SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n, round(count(*) / 3600.0, 6) AS per_second FROM events GROUP BY 1, 2",
    "consumer_queues": "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events",
    "spot_bid": f"SELECT machine, round(least(1.1 * average, on_demand), 6)::DOUBLE AS bid FROM (VALUES {_PRICES}) AS p(machine, on_demand, average, needed, open)",
    "scale_plan": f"""
SELECT machine, CAST(floor(100.0 / 744.0 / on_demand) AS BIGINT) AS affordable, CAST(least(floor(100.0 / 744.0 / on_demand), needed) - open AS BIGINT) AS start, round(open * on_demand, 6)::DOUBLE AS hourly_cost
FROM (VALUES {_PRICES}) AS p(machine, on_demand, average, needed, open)""",
}
