"""Queues, their schedule, their consumers and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.ranking import place, previous, running_sums

BATCH = 10
MARGIN = 1.1
BACK_OFF_MINUTES = 10


def queue_name(job: Column, key: Column) -> Column:
    return F.regexp_replace(F.concat(job, F.lit("-"), key), "[^a-zA-Z0-9_-]", "_")


def resolve(urls: DataFrame, dns: DataFrame) -> DataFrame:
    """Adds queue_key: the address of the host (domain, ip), or the domain where it is not known."""
    return urls.join(dns.select("domain", "ip"), "domain", "left").withColumn("queue_key", F.coalesce("ip", "domain")).drop("ip")


def batches(rows: DataFrame, key: str, order: list[str], size: int = BATCH) -> DataFrame:
    """Adds rn, the place in the queue, and batch, the number from 0 of the write of ``size`` messages."""
    return place(rows, [key], order).withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("long"))


def min_interval(rate_per_second: float) -> float:
    return MARGIN / rate_per_second


def polite_schedule(rows: DataFrame, key: str, order: list[str], rate_per_second: float = 2.0) -> DataFrame:
    """Adds rn and slot: seconds after the start at which the message may be fetched, one queue never above the rate."""
    return place(rows, [key], order).withColumn("slot", (F.col("rn") - 1) * F.lit(min_interval(rate_per_second)))


def round_robin(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds rn and turn: the order in which queues take turns, one message each (by rn, then key)."""
    return place(place(rows, [key], order), [], ["rn", key], "turn")


def dequeue_gaps(dequeues: DataFrame, consumer: str, at: str, tie: str) -> DataFrame:
    """Adds gap: seconds since the consumer's dequeue before."""
    held = previous(dequeues, [consumer], [at, tie], at, "_at")
    return held.withColumn("gap", F.col(at).cast("timestamp").cast("double") - F.col("_at").cast("timestamp").cast("double")).drop("_at")


def consumer_rates(gaps: DataFrame, consumer: str) -> DataFrame:
    return gaps.groupBy(consumer).agg(F.count(F.lit(1)).alias("n_dequeues"), F.avg("gap").alias("mean_interval"))


def seniority(dequeues: DataFrame, consumer: str, queue: str) -> DataFrame:
    """(consumer, seniority): ln of the dequeues times the queues ever held; null without dequeues."""
    return dequeues.groupBy(consumer).agg((F.ln(F.nullif(F.count(queue), F.lit(0))) * F.count_distinct(queue)).alias("seniority"))


def least_senior(ranked: DataFrame, consumer: str, protected: Column) -> DataFrame:
    """The consumer of least seniority (none counts least, the smaller name on ties), the protected ones left out."""
    return ranked.filter(~protected).orderBy(F.col("seniority").asc_nulls_first(), consumer).limit(1)


def cycles(dequeues: DataFrame, consumer: str, order: list[str], marker: Column) -> DataFrame:
    """(consumer, cycle, length, seconds): dequeues between two visits of the marker and the time (first of ``order``) they took."""
    marked = running_sums(dequeues, [consumer], order, {"cycle": marker.cast("int")})
    at = F.col(order[0]).cast("timestamp").cast("double")
    return marked.groupBy(consumer, "cycle").agg(F.count(F.lit(1)).alias("length"), (F.max(at) - F.min(at)).alias("seconds"))


def queue_states(attempts: DataFrame, queue: str, at: str, empty: Column) -> DataFrame:
    """(queue, empties, skips, active, presumed_active): probes that found nothing since the last message, and what follows.

    After its k-th failure a queue is presumed empty for k probes, so the k-th failure is probe 1 + 2 + ... of those
    since the last message; any message resets both counts. Only maxima and counts are needed.
    """
    last = attempts.filter(~empty).groupBy(queue).agg(F.max(at).alias("_last"))
    failed = F.count_if(empty & (F.col("_last").isNull() | (F.col(at) > F.col("_last"))))
    fails = attempts.join(last, queue, "left").groupBy(queue).agg(failed.alias("failed"))
    k = F.floor((F.sqrt(8 * F.col("failed") + 1) - 1) / 2).cast("long")
    held = fails.select(queue, k.alias("empties"), (F.col("failed") - k * (k + 1) / 2).cast("long").alias("skips"))
    return held.withColumns({"active": (F.col("empties") == 0) & (F.col("skips") == 0), "presumed_active": F.col("skips") >= F.col("empties")})


def donor(consumers: DataFrame, recipient: str) -> DataFrame:
    """The consumer (consumer, active, needed) that can give away most active queues, other than the recipient."""
    spare = F.greatest(F.col("active") - F.col("needed"), F.lit(0))
    return consumers.filter(F.col("consumer") != recipient).withColumn("spare", spare).filter("spare > 0").orderBy(F.desc("spare"), "consumer").limit(1)


def disperse(queues: DataFrame, consumers: int, order: list[str]) -> DataFrame:
    """Adds consumer_no: unassigned queues dealt out in turn."""
    return place(queues, [], order).withColumn("consumer_no", F.pmod(F.col("rn") - 1, F.lit(consumers))).drop("rn")


def affordable(monthly_budget: Column, price: Column) -> Column:
    """Machines that the hourly share of the budget pays for."""
    return F.floor(monthly_budget / 744.0 / price).cast("long")


def scale_plan(affordable_: Column, needed: Column, open_: Column) -> Column:
    return (F.least(affordable_, needed) - open_).cast("long")


def spot_bid(average: Column, on_demand: Column) -> Column:
    return F.least(F.lit(1.1) * average, on_demand)


def scale_local(cores: Column, running: Column, needed: Column) -> Column:
    """Fetchers to start on a machine with so many cores, of which none is left idle but those that are needed."""
    return F.greatest(F.lit(0), cores - running - needed).cast("long")


def load(consumers: DataFrame, unassigned: DataFrame, owned: DataFrame) -> DataFrame:
    """(consumer, step, queue, donor): what a consumer that asks for work is given, each of ``consumers`` taken by itself.

    The first active queue of ``unassigned`` (queue, active, waiting), else the first with messages waiting; else the youngest
    active queue of the consumer, another one, that has most to spare by ``owned`` (consumer, queue, active, assigned),
    more than half of its queues being active; else the step is stop, which asks the least senior consumer to end.
    """
    free = unassigned.agg(F.min(F.when(F.col("active"), F.col("queue"))).alias("best"), F.min(F.when(F.col("waiting") > 0, F.col("queue"))).alias("some"))
    spare = (F.count_if("active") - F.floor(F.count(F.lit(1)) / 2)).cast("long").alias("spare")
    youngest = F.max(F.when(F.col("active"), F.struct("assigned", "queue"))).getField("queue").alias("youngest")
    # two donors are enough: nobody but the first itself is given from the second
    donors = owned.groupBy("consumer").agg(spare, youngest).filter("spare > 0").orderBy(F.desc("spare"), "consumer").limit(2)
    best = donors.agg(F.array_sort(F.collect_list(F.struct((-F.col("spare")).alias("rank"), "consumer", "youngest"))).alias("donors"))
    own = F.get(F.filter("donors", lambda d: d["consumer"] != F.col("consumer")), 0)
    given = consumers.select("consumer", free.select("best").scalar().alias("best"), free.select("some").scalar().alias("some"), best.scalar().alias("donors")).withColumn("d", own)
    step = F.when(F.col("best").isNotNull(), "active").when(F.col("some").isNotNull(), "waiting").when(F.col("d").isNotNull(), "donated").otherwise("stop")
    return given.select("consumer", step.alias("step"), F.coalesce("best", "some", "d.youngest").alias("queue"), F.when(step == "donated", F.col("d.consumer")).alias("donor"))
