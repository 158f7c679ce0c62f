"""Running sums, places and predecessors within groups of any size.

Rows are range-partitioned by group and order, so a group that holds a third of all rows is spread over a third of
the tasks. Each part has its own window; what a group has in earlier parts is carried in one row per part and group.
Group columns may be null (nulls are one group); the order must tell the rows of a group apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.runtime import stage


def _parts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return stage(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "parts")


def _join_carried(parts: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    named = carried.withColumnsRenamed({c: f"_c_{c}" for c in ["_part", *keys]})
    on = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_c_{k}")), keys, F.col("_part") == F.col("_c__part"))
    return parts.join(named, on, "left").drop(*[f"_c_{c}" for c in ["_part", *keys]])


def running_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Adds a column for each of ``sums``: its total over the rows of the group up to (or, exclusive, before) the row."""
    inputs = {f"_v_{n}": F.coalesce(c.cast("double" if n.endswith("_double") else "long"), F.lit(0)) for n, c in sums.items()}
    parts = _parts(rows.withColumns(inputs), keys, order)
    window = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = parts.groupBy("_part", *keys).agg(*[F.sum(v).alias(v) for v in inputs])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", *keys, *[F.sum(v).over(before).alias(f"_b_{n}") for n, v in zip(sums, inputs)])
    joined = _join_carried(parts.withColumns({n: F.coalesce(F.sum(v).over(window), F.lit(0)) for n, v in zip(sums, inputs)}), carried, keys)
    return joined.select(*rows.columns, *[(F.col(n) + F.coalesce(f"_b_{n}", F.lit(0))).alias(n) for n in sums])


def place(rows: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Adds the place of the row in its group, from 1."""
    return running_sums(rows, keys, order, {name: F.lit(1)})


def previous(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the value of the row before in the group, null for its first."""
    parts = _parts(rows, keys, order)
    window = Window.partitionBy("_part", *keys).orderBy(*order)
    last = parts.groupBy("_part", *keys).agg(F.max(F.struct(*order, F.col(value).alias("_last"))).getField("_last").alias("_last"))
    carried = last.select("_part", *keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_before"))
    own = parts.withColumn("_rn", F.row_number().over(window)).withColumn("_lag", F.lag(value).over(window))
    joined = _join_carried(own, carried, keys)
    return joined.select(*rows.columns, F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_lag")).alias(name))


def latest(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null among the rows of the group up to the row."""
    parts = _parts(rows.withColumn("_value", value), keys, order)
    window = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    newest = F.max(F.when(F.col("_value").isNotNull(), F.struct(*order, F.col("_value").alias("_last")))).getField("_last")
    held = parts.groupBy("_part", *keys).agg(newest.alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select("_part", *keys, F.last("_last", ignorenulls=True).over(before).alias("_before"))  # one row for each part and group
    joined = _join_carried(parts.withColumn("_own", F.last("_value", ignorenulls=True).over(window)), carried, keys)
    return joined.select(*rows.columns, F.coalesce("_own", "_before").alias(name))
