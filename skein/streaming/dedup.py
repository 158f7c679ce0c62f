"""Exactly one copy of every message that was delivered at least once.

The stream keeps a keyed state store of the message keys seen lately. Keys are laid out in pages (a page is the
state of all keys of one hash range) so that one Python call serves hundreds of keys. Every entry holds the best
delivery known for its key: the earliest ``received_at``, the smallest ``delivery_id`` on ties. A delivery that
loses against the entry, or is displaced from it, is written out as a copy; it can lose only once, so the output
is append-only and needs no corrections. Entries older than the event-time watermark leave the state and go to an
archive on shared storage. A key that is new to the state is looked up in the archive of its batch and all earlier
ones, so a redelivery that comes after its key has expired, or a row older than the watermark, is still found. A look-up
reads the whole archive, so new keys wait until they are LOOKUP_SHARE of it, or for the end of the run: the rows that
all look-ups read grow in proportion to the keys, not to batches times archive.

State and output move together: the state is checkpointed per micro-batch by Spark, and each micro-batch writes
its own folder named by the batch number, overwritten when the batch is run again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from skein.functions.ids import message_key
from skein.runtime import fresh_dir, input_bytes, ship_package

LOOKUP_SHARE = 0.5
MOST_BATCHES = 256  # micro-batches of a run at most, where the caller names no size
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = np.iinfo(np.int64).max  # stands for a received_at that is null: such a delivery is kept only if no other copy has a time
EVENT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("h1", T.LongType()),
        T.StructField("h2", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("delivery_id", T.LongType()),
    ]
)
LOG = T.StructType([*EVENT.fields, T.StructField("batch", T.LongType())])
STATE = T.StructType([T.StructField("entries", T.BinaryType())])


def fold_page(entries: np.ndarray, rows: np.ndarray, expire_before: int | None):
    """One page and one batch of rows. Both have the columns h1, h2, at, delivery_id; entries also the time last seen.

    Returns the new entries and the rows to write: copies, claims (deliveries that are now the best of their key,
    for the look-up in the archive) and expired entries.
    """
    expired = entries[:0]
    if expire_before is not None and len(entries):
        old = entries[:, 4] < expire_before
        expired, entries = entries[old], entries[~old]
    seen = np.where(rows[:, 2] == LAST, np.iinfo(np.int64).min, rows[:, 2])
    both = np.concatenate([entries, np.column_stack([rows, seen])])
    fresh = np.concatenate([np.zeros(len(entries), bool), np.ones(len(rows), bool)])
    order = np.lexsort((both[:, 3], both[:, 2], both[:, 1], both[:, 0]))
    both, fresh = both[order], fresh[order]
    first = np.ones(len(both), bool)
    first[1:] = (both[1:, 0] != both[:-1, 0]) | (both[1:, 1] != both[:-1, 1])
    copies = both[~first]
    best = both[first]
    if len(both):
        best[:, 4] = np.maximum.reduceat(both[:, 4], np.flatnonzero(first))
    return best, copies, both[first & fresh], expired


def _update(key, batches, state):
    entries = np.frombuffer(state.get[0], np.int64).reshape(-1, 5) if state.exists else np.empty((0, 5), np.int64)
    rows = np.concatenate([b[["h1", "h2", "at", "delivery_id"]].to_numpy(np.int64) for b in batches])
    watermark = state.getCurrentWatermarkMs() * 1000
    best, copies, claims, expired = fold_page(entries, rows, watermark if watermark > 0 else None)
    state.update((best.tobytes(),))
    out = np.concatenate([copies[:, :4], claims[:, :4], expired[:, :4]])
    kinds = np.repeat(np.array(["copy", "claim", "expired"], object), [len(copies), len(claims), len(expired)])
    yield pd.DataFrame({"kind": kinds, "h1": out[:, 0], "h2": out[:, 1], "at": out[:, 2], "delivery_id": out[:, 3]})


def keyed(messages: DataFrame, pages: int) -> DataFrame:
    """(page, h1, h2, at, delivery_id, event_time): two 64-bit hashes stand for queue and message key."""
    key = message_key(F.col("msg_id"))
    queue = F.coalesce(F.col("queue"), F.lit("\0"))
    return (
        messages.filter(F.col("msg_id").isNotNull())
        .select(queue.alias("q"), key.alias("k"), F.col("received_at").cast("timestamp").alias("event_time"), "delivery_id")
        .select(
            F.xxhash64("q", "k").alias("h1"),
            F.xxhash64("k", "q", F.lit(7)).alias("h2"),
            F.coalesce(F.unix_micros("event_time"), F.lit(int(LAST))).alias("at"),
            F.col("delivery_id").cast("long").alias("delivery_id"),
            "event_time",
        )
        .withColumn("page", F.pmod(F.col("h1"), F.lit(pages)).cast("int"))
    )


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_bytes_per_trigger: int) -> DataFrame:
    """A file stream over a folder, or over one file (the source itself takes folders only)."""
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hpath).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", hpath.getName()).parquet(str(hpath.getParent()))


class Lookups:
    """The late look-ups of one run. ``late/upto=n`` has what the look-up after batch n found; claims of later batches wait."""

    def __init__(self, spark: SparkSession, root: str):
        self.events, self.late, self.spark = f"{root}/events", f"{root}/late", spark
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        held = self._numbers(self.events, "batch=")
        self.done = max(self._numbers(self.late, "upto=", "/_SUCCESS"), default=-1)
        self.last = max(held, default=-1)
        # bytes stand for rows, since all have one layout
        self.archive = sum(self._bytes(n, "expired") for n in held)
        self.waiting = sum(self._bytes(n, "claim") for n in held if n > self.done)

    def _numbers(self, folder: str, prefix: str, holds: str = "") -> list[int]:
        """Numbers of the subfolders that hold a file."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in self.fs.listStatus(path(folder))] if self.fs.exists(path(folder)) else []
        return [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and self.fs.exists(path(f"{folder}/{n}{holds}"))]

    def _bytes(self, batch: int, kind: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.events}/batch={batch}/kind={kind}")
        return self.fs.getContentSummary(path).getLength() if self.fs.exists(path) else 0

    def add(self, batch: int) -> None:
        """Take note of a batch that was written, and look up what waits if it is enough. A batch that is run again counts twice, which makes a look-up come early."""
        self.last = batch
        self.archive += self._bytes(batch, "expired")
        self.waiting += self._bytes(batch, "claim")
        if not self.archive:
            self.done, self.waiting = batch, 0  # nothing has expired before these claims
        elif self.waiting >= LOOKUP_SHARE * self.archive:
            self.run()

    def run(self) -> None:
        if self.archive and self.last > self.done:
            log = self.spark.read.schema(LOG).parquet(self.events).filter(F.col("batch") <= self.last)
            archive = log.filter(F.col("kind") == "expired")
            claims = log.filter((F.col("kind") == "claim") & (F.col("batch") > self.done))
            _lost(archive, claims).write.mode("overwrite").parquet(f"{self.late}/upto={self.last}")
        self.done, self.waiting = self.last, 0


def repeated_deliveries(
    spark: SparkSession,
    path: str,
    horizon: str = "6 hours",
    max_bytes_per_trigger: int | None = None,
    pages: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """(delivery_id) of every delivery that is not the one to keep.

    Deliveries are copies if queue and msg_id are equal, in any spelling of a UUID. Rows without msg_id are never
    copies and a null queue is a queue of its own. The stream over ``path`` is run to its end; ``horizon`` is how long a key stays in the state
    after the newest event time, ``pages`` the number of state pages (by default one per 64 KB of input, so that a
    page holds some hundred keys at any size), ``max_bytes_per_trigger`` the size of a micro-batch (by default 64 MB, or
    what makes MOST_BATCHES of the input). With a ``folder`` the state and the output are kept there, and the next
    run with it reads only the files that have come since; the pages must then be given and stay the same. Extra
    columns are not read. An empty table gives no rows. The state is kept in RocksDB unless the session names a provider.
    """
    ship_package(spark)
    if folder and not pages:
        raise ValueError("a kept state needs a fixed number of pages")
    size = input_bytes(spark, path)
    pages = pages or max(256, size // 65536)
    root = folder or fresh_dir(spark, "dedup")
    schema = T.StructType([f for f in spark.read.parquet(path).schema if f.name in ("delivery_id", "msg_id", "queue", "received_at")])
    source = read_stream(spark, path, schema, max_bytes_per_trigger or max(64 << 20, size // MOST_BATCHES))
    marked = keyed(source, pages).withWatermark("event_time", horizon)
    folded = marked.groupBy("page").applyInPandasWithState(_update, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)
    lookups = Lookups(spark, root)

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{root}/events/batch={number}")
        lookups.add(number)

    provider = "spark.sql.streaming.stateStore.providerClass"
    named = spark.conf.get(provider, "")
    if "RocksDB" not in named:
        spark.conf.set(provider, ROCKSDB)
    try:
        query = (
            folded.writeStream.outputMode("append").foreachBatch(commit)
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(provider, named) if named else spark.conf.unset(provider)
    lookups.run()
    if lookups.last < 0:  # no batch was run: the table has no rows
        return spark.createDataFrame([], "delivery_id long")
    hot = spark.read.schema(LOG).parquet(f"{root}/events").filter(F.col("kind") == "copy").select("delivery_id")
    found = lookups._numbers(lookups.late, "upto=")
    cold = spark.read.schema("delivery_id long, upto long").parquet(lookups.late).select("delivery_id") if found else hot.limit(0)
    return hot.union(cold).distinct()


def _lost(archive: DataFrame, claims: DataFrame) -> DataFrame:
    """Of each key with claims and entries that were archived no later: all deliveries but the best."""
    a, c = archive.select("h1", "h2", "at", "delivery_id", F.col("batch").alias("archived")), claims.select("h1", "h2", "at", "delivery_id", F.col("batch").alias("claimed"))
    newest = c.groupBy("h1", "h2").agg(F.max("claimed").alias("claimed"))
    oldest = a.groupBy("h1", "h2").agg(F.min("archived").alias("archived"))
    found = a.join(newest, ["h1", "h2"]).filter("archived <= claimed").select("h1", "h2", "at", "delivery_id")
    again = c.join(oldest, ["h1", "h2"]).filter("archived <= claimed").select("h1", "h2", "at", "delivery_id")
    both = found.union(again)
    best = both.groupBy("h1", "h2").agg(F.min(F.struct("at", "delivery_id")).alias("best"))
    return both.join(best, ["h1", "h2"]).filter(F.col("delivery_id") != F.col("best.delivery_id")).select("delivery_id")
