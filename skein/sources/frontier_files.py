"""A frontier kept in files: its queues written, read back and deleted.

Messages lie in folders of a number of buckets, sorted by queue, so that many small queues make no more files than a few
and a queue of most messages is spread over the tasks that hold it. A deleted queue is a row beside them; it goes from the
files when they are written anew. Writes append, each as a whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def persist(messages: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Append messages, which have a column queue (null is a queue of its own), to the frontier in a folder."""
    held = messages.withColumns({"bucket": F.pmod(F.xxhash64("queue"), F.lit(buckets)).cast("int"), "written": F.current_timestamp()})
    held.sortWithinPartitions("bucket", "queue").write.mode("append").partitionBy("bucket").parquet(f"{folder}/messages")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of the frontier in a folder, less those that were there when their queue was deleted."""
    held = spark.read.parquet(f"{folder}/messages").drop("bucket")
    if not _exists(spark, f"{folder}/deleted"):
        return held.drop("written")
    gone = spark.read.parquet(f"{folder}/deleted").groupBy(F.col("queue").alias("_queue")).agg(F.max("at").alias("_at"))
    return held.join(gone, F.col("queue").eqNullSafe(F.col("_queue")) & (F.col("written") <= F.col("_at")), "left_anti").drop("written")


def delete_queues(queues: DataFrame, folder: str) -> None:
    """Delete the queues (queue) with all messages they have now."""
    queues.select("queue", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{folder}/deleted")


def compact(spark: SparkSession, folder: str, into: str, buckets: int = BUCKETS) -> None:
    """Write what is left of a frontier to another folder, without what was deleted."""
    persist(restore(spark, folder), into, buckets)


def delete_persisted(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
