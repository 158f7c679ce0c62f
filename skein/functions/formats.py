"""Small text formats: ids of fetchers, names of jobs, user agents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.config import JOB_NAME

# Fixed value: the format of user agents.
USER_AGENT = "Mozilla/5.0 (compatible; %s/1.0; ID %s)"


def fetcher_id(instance: Column, local: Column) -> Column:
    return F.concat_ws(":", instance, local)


def fetcher_parts(fetcher: Column) -> tuple[Column, Column]:
    parts = F.split(fetcher, ":")
    return F.get(parts, 0), F.get(parts, 1)


def is_job_name(name: Column) -> Column:
    return F.lower(name).rlike(JOB_NAME)


def user_agent(name: str, ident: Column) -> Column:
    return F.format_string(USER_AGENT, F.lit(name), ident)


def is_multiple_of_power(count: Column, k: int) -> Column:
    """Whether a count is a multiple of 2^k."""
    return count.bitwiseAND(F.lit((1 << k) - 1)) == 0


def strip_proxy(url: Column) -> Column:
    """The URL that a proxy's address carries in its parameter url, decoded; other URLs as they are."""
    inner = F.regexp_extract(url, r"[?&]url=([^&]*)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(url)
