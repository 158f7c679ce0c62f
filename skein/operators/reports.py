"""Metrics as rows, and the look-ups that management makes on tables of machines and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.ranking import place

# Types of machines for fetchers, the preferred one first.
MACHINE_TYPES = ("m3.medium", "m1.medium")
NOT_LIVE = ("terminated", "shutting-down")


def metric_rows(gauges: DataFrame, units: dict[str, str], dimension: str | None = None) -> DataFrame:
    """(name, unit, dimensions, value): one row per gauge column, with the dimension's value where there is one."""
    dims = F.create_map(F.lit(dimension), F.col(dimension).cast("string")) if dimension else F.create_map().cast("map<string,string>")
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(u).alias("unit"), F.col(n).cast("double").alias("value")) for n, u in units.items()])
    return gauges.select(dims.alias("dimensions"), F.explode(cells).alias("m")).select("m.name", "m.unit", "dimensions", "m.value")


def latest(images: DataFrame, at: str, value: str) -> DataFrame:
    """The value of the newest row; no row if there are none, which a caller treats as an error."""
    return images.agg(F.max_by(value, at).alias(value)).filter(F.col(value).isNotNull())


def live(instances: DataFrame) -> DataFrame:
    return instances.filter(~F.col("state").isin(*NOT_LIVE))


def preference(kind: Column) -> Column:
    """Place of a machine type in the order of preference, null for types that are not used."""
    at = F.array_position(F.array(*[F.lit(t) for t in MACHINE_TYPES]), kind)
    return F.when(at > 0, at)


def hourly_cost(frontier: Column, store: Column, bids: Column, fetchers: Column) -> Column:
    """What the machines may cost: frontier, its store if it has one of its own, open bids and running fetchers."""
    return frontier + F.coalesce(store, F.lit(0.0)) + F.coalesce(bids, F.lit(0.0)) + F.coalesce(fetchers, F.lit(0.0))


def assignment_plan(queues: DataFrame, consumers: int) -> DataFrame:
    """Adds consumer_no: queues (queue, active, waiting) dealt out, the active ones first, then those with messages, then the rest."""
    ranked = queues.withColumn("_rank", F.when(F.col("active"), 0).when(F.col("waiting") > 0, 1).otherwise(2))
    return place(ranked, [], ["_rank", "queue"]).withColumn("consumer_no", F.pmod(F.col("rn") - 1, F.lit(consumers))).drop("_rank", "rn")


def robots_cache(fetched: DataFrame, now: Column, least_seconds: int = 3600) -> DataFrame:
    """(domain, valid_until, refetch) of robots files (domain, at, expires, failed): a failed one allows everything for the least time to live."""
    until = F.greatest(F.coalesce(F.when(~F.col("failed"), F.col("expires")), F.col("at")), F.col("at") + F.lit(float(least_seconds)))
    held = fetched.withColumn("valid_until", until)
    last = held.groupBy("domain").agg(F.max(F.struct("at", "valid_until")).alias("l"))
    return last.select("domain", F.col("l.valid_until").alias("valid_until"), (F.col("l.valid_until") <= now).alias("refetch"))
