"""Exact figures per key when a few keys hold most of the rows.

Keys with more than one row in HOT_KEYS are hot; there are fewer than HOT_KEYS of them, whatever the data. Their figures
come from value histograms: a round cuts the interval that still holds the wanted rank into ``bins`` equal bins, counts the
rows of each bin with partial sums, and keeps the bin the rank falls into, until that bin holds one value. The first round
covers all values, so its counts added up are the key's count. A key is heavy if a rank as great as the wanted share of all
rows resolves among its values. A hot key sends only bin counts over the network, never
its rows. The other keys have few rows each; their values are counted, put in order over range partitions, and ranked by
running sums, so that none of them is one task's either.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.ranking import running_sums
from skein.runtime import stage

HOT_KEYS = 1000  # the rows of hot keys and of their targets are sent to every task: fewer than this for each probability


def key_counts(rows: DataFrame, key: Column, value: Column, hot_keys: int = HOT_KEYS) -> tuple[DataFrame, DataFrame]:
    """(key, value) of the rows with a key, and (key, n_rows, n_values, first, last, hot) of each key."""
    pairs = rows.select(key.alias("key"), value.cast("long").alias("value")).filter(F.col("key").isNotNull())
    counted = stage(
        pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.min("value").alias("first"), F.max("value").alias("last")),
        "counts",
    )
    total = counted.agg(F.sum("n_rows")).first()[0] or 0
    return pairs, counted.withColumn("hot", F.col("n_rows") * hot_keys > total)


def _ranks(probabilities: Sequence[float]) -> Column:
    """The rank of each probability among n_values values: q and rank."""
    at = [F.struct(F.lit(i).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n_values"))).cast("long").alias("rank")) for i, p in enumerate(probabilities)]
    return F.explode(F.array(*at)).alias("w")


def _histogram(pairs: DataFrame, hot: DataFrame, bins: int) -> DataFrame:
    """(key, bin, n, lo, hi) of the values of each hot key, over all of its range."""
    whole = hot.filter("n_values > 0").select("key", "first", "last")
    return stage(
        pairs.filter("value is not null").join(F.broadcast(whole), "key").select("key", "value", _bin("first", "last", bins))
        .groupBy("key", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")),
        "histogram",
    )


def _bin(lo: str, hi: str, bins: int) -> Column:
    width = F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo) + 1) / F.lit(bins))).cast("long")
    return F.floor((F.col("value") - F.col(lo)) / width).cast("long").alias("bin")


def _resolved(pairs: DataFrame, histogram: DataFrame, wanted: DataFrame, bins: int) -> DataFrame:
    """(key, q, value) of the wanted (key, q, rank): the bin of each rank is refined until it holds one value. Ranks that a key doesn't reach are left out."""

    def narrowed(counts: DataFrame) -> DataFrame:
        """Of the bins (key, q, rank, bin, n, lo, hi) those that hold the rank, which then counts within the bin."""
        upto = F.sum("n").over(Window.partitionBy("key", "q").orderBy("bin"))
        kept = counts.withColumn("upto", upto).filter("upto >= rank and upto - n < rank")
        return stage(kept.select("key", "q", "lo", "hi", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "targets")

    targets, done = narrowed(histogram.join(F.broadcast(wanted), "key")), []
    while True:
        done.append(targets.filter("lo = hi").select("key", "q", F.col("lo").alias("value")))
        open_ = targets.filter("lo < hi")
        if open_.isEmpty():
            break
        inside = pairs.join(F.broadcast(open_), "key").filter("value between lo and hi").select("key", "q", "rank", "value", _bin("lo", "hi", bins))
        targets = narrowed(inside.groupBy("key", "q", "rank", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    found = done[0]
    for part in done[1:]:
        found = found.union(part)
    return found


def hot_figures(pairs: DataFrame, counted: DataFrame, probabilities: Sequence[float] = (0.5,), bins: int = 4096) -> DataFrame:
    """(key, n_rows, n_values, first, last, q0, q1, ...) of the hot keys, from their histograms."""
    hot = counted.filter("hot")
    histogram = _histogram(pairs, hot, bins)
    # counts, first and last are those of the histogram; values that are null are in none of its bins
    nulls = hot.select("key", (F.col("n_rows") - F.col("n_values")).alias("n_null"))
    summed = histogram.groupBy("key").agg(F.sum("n").alias("n_values"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    figures = nulls.join(summed, "key", "left").select(
        "key", (F.col("n_null") + F.coalesce("n_values", F.lit(0))).alias("n_rows"), F.coalesce("n_values", F.lit(0)).alias("n_values"), "first", "last"
    )
    if not probabilities:
        return figures
    wanted = summed.select("key", _ranks(probabilities)).select("key", "w.q", "w.rank")
    return figures.join(_wide(_resolved(pairs, histogram, wanted, bins), len(probabilities)), "key", "left")


def _wide(found: DataFrame, n: int) -> DataFrame:
    return found.groupBy("key").agg(*[F.max(F.when(F.col("q") == i, F.col("value"))).alias(f"q{i}") for i in range(n)])


def cold_figures(pairs: DataFrame, counted: DataFrame, probabilities: Sequence[float] = (0.5,)) -> DataFrame:
    """The same of the other keys, from their values in order."""
    figures = counted.filter("not hot").drop("hot")
    if not probabilities:
        return figures
    hot = counted.filter("hot").select("key")
    values = pairs.filter("value is not null").join(F.broadcast(hot), "key", "left_anti").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(values.join(figures.select("key", "n_values"), "key"), ["key"], ["value"], {"upto": F.col("n")})
    found = ranked.select("key", "value", "n", "upto", _ranks(probabilities)).filter("upto >= w.rank and upto - n < w.rank").select("key", "w.q", "value")
    return figures.join(_wide(found, len(probabilities)), "key", "left")


def key_figures(rows: DataFrame, key: Column, value: Column, probabilities: Sequence[float] = (0.5,), bins: int = 4096, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(key, n_rows, n_values, first, last, q0, q1, ...) of every key.

    ``value`` must be a long. The quantile of p is the value of rank ceil(p * n_values), at least 1. Rows with a null
    key are left out; null values count in n_rows only and a key without values has null figures. Equal values and
    repeated rows count each. An empty table gives no rows.
    """
    pairs, counted = key_counts(rows, key, value, hot_keys)
    return hot_figures(pairs, counted, probabilities, bins).unionByName(cold_figures(pairs, counted, probabilities))


def _least_rows(total: int, share: float) -> int:
    return math.ceil(Fraction(str(share)) * total)  # exact, where a product of doubles could be a hair above a whole number


def heavy_keys(figures: DataFrame, total: int, share: float = 0.02) -> DataFrame:
    """The keys that hold at least ``share`` of ``total`` rows."""
    return figures.filter((F.lit(total) > 0) & (F.col("n_rows") >= _least_rows(total, share)))


def heavy_ranks(rows: DataFrame, key: Column, value: Column, total: int, share: float = 0.02, bins: int = 4096) -> DataFrame:
    """(key, value): the keys that have a row of the rank ``share`` of ``total`` in the order of their own values, and the value there.

    These are the keys that hold at least that share, and no others. Null values come first in a key's order, so the value
    may be null. The rank is looked for in the histograms of hot keys, refined until it resolves; a key that reaches it is
    one of these, whatever the share. Rows with a null key count in ``total`` only.
    """
    pairs, counted = key_counts(rows, key, value, max(HOT_KEYS, math.floor(1 / Fraction(str(share))) + 1))
    hot = counted.filter("hot")
    rank = F.lit(max(1, _least_rows(total, share))) - F.col("n_rows") + F.col("n_values")  # beyond the nulls
    wanted = hot.select("key", F.lit(0).alias("q"), rank.alias("rank"))
    found = _resolved(pairs, _histogram(pairs, hot, bins), wanted.filter("rank > 0"), bins)
    return found.select("key", "value").union(wanted.filter("rank <= 0").select("key", F.lit(None).cast("long")))
