"""Batch jobs around a crawl: seeding, export, purging, taking back skipped rows, rebuilding the seen set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.config import Scope
from skein.functions.ids import address_id
from skein.functions.urls import canonical_url, rooted
from skein.operators.admission import scope_class
from skein.schemas import URL_CLASSES

IN_SCOPE = URL_CLASSES["InScope"]


def read_seeds(lines: DataFrame, now: Column) -> DataFrame:
    """(url, id, is_seed, discovered) of the lines of a seed file (value): trimmed, blank ones left out, one row per id."""
    url = rooted(canonical_url(F.trim(F.col("value"))))
    return lines.filter(F.trim("value") != "").select(url.alias("url"), address_id(url).alias("id"), F.lit(True).alias("is_seed"), now.alias("discovered")).dropDuplicates(["id"])


def export_seeds(rows: DataFrame, scope: Scope) -> DataFrame:
    """(url) of the rows that are no redirects and in scope."""
    return rows.filter("url is not null and redirects_to is null").filter(scope_class(F.col("url"), scope) == IN_SCOPE).select("url").distinct()


def purge_split(rows: DataFrame, scope: Scope) -> DataFrame:
    """Adds purged: out of scope and neither a robots.txt nor a sitemap.xml."""
    exempt = F.col("id").endswith("robots.txt") | F.col("id").endswith("sitemap.xml")
    return rows.withColumn("purged", (scope_class(F.col("url"), scope) != IN_SCOPE) & ~exempt)


def purge(rows: DataFrame, content: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept rows, purged rows (to be appended to the skipped ones) and the content without that of purged rows."""
    split = purge_split(rows, scope)
    out = split.filter("purged").drop("purged")
    return split.filter("not purged").drop("purged"), out, content.join(out.select(F.regexp_replace("id", "[?/]+$", "").alias("key")), "key", "left_anti")


def requeue_skipped(skipped: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """Skipped rows (raw_url, id, reason) that a new scope takes in, and those that stay skipped."""
    took = scope_class(canonical_url(F.col("raw_url")), scope) == IN_SCOPE
    by_scope = F.col("reason").isin(URL_CLASSES["OutOfScope"], URL_CLASSES["ExcludedDomain"], URL_CLASSES["ExcludeUrl"])
    marked = skipped.withColumn("back", by_scope & took)
    return marked.filter("back").drop("back"), marked.filter("not back").drop("back")


def rebuild_seen(*tables: DataFrame) -> DataFrame:
    """(id) of all addresses of the outcome tables, each once."""
    parts = [t.select("id") for t in tables]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united.filter("id is not null").distinct()


def seed_from_reference(reference: DataFrame, seen: DataFrame, scope: Scope) -> DataFrame:
    """(url, id) of the rows of another job that are not seen and in scope."""
    rows = reference.select("url", "id").dropDuplicates(["id"]).join(seen.select("id"), "id", "left_anti")
    return rows.filter(scope_class(F.col("url"), scope) == IN_SCOPE).select("url", "id")


def union_with_reason(**tables: DataFrame) -> DataFrame:
    """(url, referrer, reason) of several tables, the reason naming each."""
    parts = [t.select("url", "referrer", F.lit(name).alias("reason")) for name, t in tables.items()]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united
