"""Queries on small formats and on which downloader a page gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import formats as M
from skein.functions.ids import address_id
from skein.operators.redundancy import confident
from skein.runtime import table


def fetcher_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    instance, local = M.fetcher_parts(F.col("fetcher"))
    rows = table(spark, sf_dir, "crawled_urls").groupBy("fetcher").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("fetcher", "n", instance.alias("instance"), local.alias("local_id"), M.fetcher_id(instance, local).alias("joined"), M.user_agent("Skein", F.col("fetcher")).alias("agent"))


def job_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "documents").groupBy("crawl_job").agg(F.count(F.lit(1)).alias("n"))
    return jobs.select("crawl_job", "n", M.is_job_name(F.col("crawl_job")).alias("valid"), M.is_multiple_of_power(F.col("n"), 2).alias("persists"))


def downloader_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with reasons against robots go to the agent that does not comply."""
    reasons = F.coalesce(F.size("robot_exclusion_reasons"), F.lit(0)) > 0
    return table(spark, sf_dir, "crawled_urls").select("row_id", F.when(reasons, "NonCompliant").otherwise("Standard").alias("agent"))


def blocked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each site answered with a status that means the fetcher is blocked."""
    host = F.regexp_extract(address_id(F.col("url")), "^([^?/:]*)", 1)
    rows = table(spark, sf_dir, "crawled_urls").withColumn("host", host).groupBy("host")
    return rows.agg(F.count_if(F.col("http_status").isin(402, 403, 420, 429)).alias("n_blocked"), F.count("http_status").alias("n_answers"))


def proxy_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit("http://proxy.test/get?key=1&url="), F.url_encode("url"))
    return table(spark, sf_dir, "crawled_urls").select("row_id", M.strip_proxy(wrapped).alias("url"))


def confidence_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of ids that a confidence of 0.95 keeps; a sampling operator, the same ids at every run."""
    ids = table(spark, sf_dir, "seen_urls").select(address_id(F.col("url")).alias("id")).distinct()
    return ids.agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(confident(F.col("id"), 0.95)).alias("n_kept"))


QUERIES = {f.__name__: f for f in (fetcher_ids, job_names, downloader_choice, blocked_sites, proxy_urls, confidence_sample)}

SQL = {
    "fetcher_ids": """
SELECT fetcher, CAST(count(*) AS BIGINT) AS n, string_split(fetcher, ':')[1] AS instance, string_split(fetcher, ':')[2] AS local_id, fetcher AS joined,
  'Mozilla/5.0 (compatible; Skein/1.0; ID ' || fetcher || ')' AS agent FROM crawled_urls GROUP BY fetcher""",
    "job_names": "SELECT crawl_job, CAST(count(*) AS BIGINT) AS n, regexp_matches(lower(crawl_job), '^[a-z0-9][a-z0-9.-]{2,62}$') AS valid, count(*) % 4 = 0 AS persists FROM documents GROUP BY crawl_job",
    "downloader_choice": "SELECT row_id, CASE WHEN coalesce(len(robot_exclusion_reasons), 0) > 0 THEN 'NonCompliant' ELSE 'Standard' END AS agent FROM crawled_urls",
    "blocked_sites": r"""
SELECT regexp_extract(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^([^?/:]*)', 1) AS host, CAST(count(*) FILTER (WHERE http_status IN (402, 403, 420, 429)) AS BIGINT) AS n_blocked,
  CAST(count(http_status) AS BIGINT) AS n_answers FROM crawled_urls GROUP BY 1""",
    "proxy_urls": "SELECT row_id, url FROM crawled_urls",
}
