"""Event-time windows, sessions and de-duplication over file streams, each run to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from skein.runtime import fresh_dir, ship_package, stage
from skein.streaming.dedup import read_stream

BYTES_PER_TRIGGER = 64 << 20
COMPACT = 16  # rounds of a crawl after which its generations are put into one table


def open_stream(spark: SparkSession, path: str, columns: list[str], at: str | None = None) -> DataFrame:
    """A stream over the columns of a table; the event-time column becomes a timestamp, as watermarks take no other type."""
    ship_package(spark)
    schema = T.StructType([f for f in spark.read.parquet(path).schema if f.name in columns])
    rows = read_stream(spark, path, schema, BYTES_PER_TRIGGER)
    return rows.withColumn(at, F.col(at).cast("timestamp")) if at else rows


def continue_to_end(stream: DataFrame, root: str, mode: str = "append") -> None:
    """Run a stream over all that is there and has not been read, appending to root/out."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_to_end(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, appending to a folder, and read what it wrote."""
    spark = stream.sparkSession
    root = fresh_dir(spark, purpose)
    continue_to_end(stream, root, mode)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_batches(stream: DataFrame, purpose: str, work: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Run a stream with ``work(batch, number, folder)`` for each micro-batch; the folder. Work must overwrite what a batch of the number wrote."""
    root = fresh_dir(stream.sparkSession, purpose)
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: work(batch, n, root)).option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return root


def rates(stream: DataFrame, at: str, keys: list[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, *keys, n): rows per window of event time, written once the watermark has passed its end."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    counted = stream.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of rows of a key without a gap; those that ended before the watermark."""
    counted = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the first that comes."""
    return stream.dropDuplicates(keys)


def split_late(stream: DataFrame, key: str, at: str, allowed: str, pages: int = 64) -> DataFrame:
    """(key, side): main, or late for rows whose event time is before the watermark of their micro-batch.

    The watermark is the newest event time of the batches before, less ``allowed``; the first batch has none. Rows
    without an event time are on time. No state is kept but for the watermark; pages only spread the rows.
    """

    def side(page, batches, state):
        watermark = state.getCurrentWatermarkMs()
        for batch in batches:
            late = (batch["at_us"] < watermark * 1000) if watermark > 0 else batch["at_us"] != batch["at_us"]
            yield pd.DataFrame({key: batch[key], "side": np.where(late, "late", "main")})

    micros = F.coalesce(F.unix_micros(at), F.lit(np.iinfo(np.int64).max)).alias("at_us")
    rows = stream.withWatermark(at, allowed).select(F.pmod(F.xxhash64(key), F.lit(pages)).alias("page"), key, at, micros)
    kind = dict(stream.dtypes)[key]
    return rows.groupBy("page").applyInPandasWithState(side, f"{key} {kind}, side string", "none int", "append", GroupStateTimeout.NoTimeout)


def crawl_generations(spark: SparkSession, links: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(id, generation): what a crawl from the seeds reaches over (referrer_id, id), generation by generation.

    Each round is one batch: the links of the newest pages, less what is seen. It ends when the frontier is empty, or
    after ``most`` rounds where a caller wants the first generations only. Every generation is written, so a lost
    executor costs one round at most; what is found is put together every COMPACT rounds, so that plans stay short.
    """
    edges = stage(links.select("referrer_id", "id").distinct(), "edges")
    found = stage(seeds.select("id").distinct().withColumn("generation", F.lit(0)), "found")
    newest, generation = found, 0
    while most is None or generation < most:
        generation += 1
        next_ids = edges.join(newest.select(F.col("id").alias("referrer_id")), "referrer_id").select("id").distinct()
        newest = stage(next_ids.join(found.select("id"), "id", "left_anti").withColumn("generation", F.lit(generation)), "newest")
        if newest.isEmpty():
            break
        found = found.union(newest)
        if generation % COMPACT == 0:
            found = stage(found.coalesce(spark.sparkContext.defaultParallelism), "found")
    return found


def seed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of seed files as they come into a folder; files that were read are not read again."""
    return spark.readStream.text(folder)

