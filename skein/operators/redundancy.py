"""Redundant URL patterns: support of the nodes of a prefix tree, as aggregates instead of a tree.

A URL is exploded to the prefixes of its tokens; a query key is a child of the last one. A node's support is the
number of redundant URLs through it, or -1 once a URL that is not redundant has come to a node that was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import host_of
from skein.functions.urls import query_keys, url_tokens
from skein.operators.ranking import place, running_sums

PATH_SUPPORT = 100
FILE_SUPPORT = 20
PARAMETER_SUPPORT = 10


def nodes(urls: DataFrame) -> DataFrame:
    """One row per node of each row's id, with ``domain``, ``node`` and ``role`` (path, leaf or key); other columns stay.

    Path and key nodes at one place with one text are one node; one URL has each of its nodes once.
    """
    tokens = url_tokens(F.col("id"))
    n = F.size("tokens")
    prefix = lambda k: F.array_join(F.slice("tokens", 1, k), "\u0001")
    paths = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(prefix(k).alias("node"), F.when(k == n, "leaf").otherwise("path").alias("role")))
    keys = F.transform(query_keys(F.col("id")), lambda q: F.struct(F.concat(prefix(n), F.lit("\u0001"), q).alias("node"), F.lit("key").alias("role")))
    spread = urls.withColumn("domain", host_of(F.col("id"))).withColumn("tokens", tokens).withColumn("n", F.explode(F.concat(paths, keys)))
    return spread.select(*urls.columns, "domain", "n.node", "n.role")


def _support(pinned: Column, redundant: Column) -> Column:
    return F.when(pinned, F.lit(-1)).otherwise(redundant).cast("long")


def support(log: DataFrame) -> DataFrame:
    """(domain, node, support) after all inserts of the log (seq, id, redundant), seq being unique.

    A node is pinned if some insert that is not redundant is not its first: either more than one such insert, or
    the first of all inserts is another. Both follow from minima and counts, which partial sums and a stream's state
    hold as well: over a stream this gives, in update mode, the support of every node that a batch touched.
    """
    found = nodes(log).groupBy("domain", "node").agg(
        F.count_if("redundant").alias("n_redundant"), F.count_if(~F.col("redundant")).alias("n_other"), F.min("seq").alias("first"),
        F.min(F.when(~F.col("redundant"), F.col("seq"))).alias("first_other"),
    )
    pinned = (F.col("n_other") > 1) | ((F.col("n_other") == 1) & (F.col("first_other") > F.col("first")))
    return found.select("domain", "node", _support(pinned, F.col("n_redundant")).alias("support"))


def created(log: DataFrame) -> DataFrame:
    """(domain, n_urls): inserts that made at least one new node."""
    first = nodes(log).groupBy("domain", "node").agg(F.min("seq").alias("seq"))
    return first.groupBy("domain").agg(F.count_distinct("seq").alias("n_urls"))


def _redundant(path: int, file: int, parameter: int) -> Column:
    return F.coalesce(
        F.max(
            F.when(F.col("role") == "key", F.col("support") >= parameter)
            .when(F.col("role") == "leaf", (F.col("support") >= file) | (F.col("support") >= path))
            .otherwise(F.col("support") >= path)
        ),
        F.lit(False),
    )


def probe(urls: DataFrame, supports: DataFrame, path: int = PATH_SUPPORT, file: int = FILE_SUPPORT, parameter: int = PARAMETER_SUPPORT) -> DataFrame:
    """(id, redundant) of each distinct id: a prefix, the whole path or a query key has the support it takes."""
    probes = nodes(urls.select("id").distinct())
    return probes.join(supports, ["domain", "node"], "left").groupBy("id").agg(_redundant(path, file, parameter).alias("redundant"))


def probe_as_of(log: DataFrame, path: int = PATH_SUPPORT, file: int = FILE_SUPPORT, parameter: int = PARAMETER_SUPPORT) -> DataFrame:
    """(seq, redundant) of each insert, held against the inserts before it only."""
    spread = nodes(log).select("domain", "node", "seq", "redundant", "role")
    order = (["domain", "node"], ["seq"])
    numbered = place(spread, *order)
    pins = F.when(~F.col("redundant") & (F.col("rn") > 1), 1).otherwise(0)
    counts = F.when(F.col("redundant"), 1).otherwise(0)
    earlier = running_sums(numbered, *order, {"pins": pins, "counts": counts}, inclusive=False)
    held = earlier.withColumn("support", F.when(F.col("rn") > 1, _support(F.col("pins") > 0, F.col("counts"))))
    return held.groupBy("seq").agg(_redundant(path, file, parameter).alias("redundant"))


def confident(address: Column, confidence: float) -> Column:
    """True for a share of all ids, always the same ones."""
    return F.pmod(F.xxhash64(address), F.lit(10_000)) < F.lit(round(confidence * 10_000))
