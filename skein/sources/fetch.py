"""The seam where pages come in: any fetcher with one method, or a table of pages.

A fetcher runs inside the executors, one instance per partition, so that connections are shared by the URLs of a
partition; partition the frontier by queue before, and each queue is fetched by one task at its pace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.urls import storage_key

ANSWER = "id string, http_status int, error string, headers map<string,string>, body binary"


@dataclass
class Answer:
    """What came of one request; error is timeout, request or empty."""

    status: int | None = None
    error: str = ""
    headers: dict[str, str] | None = None
    body: bytes | None = None


class Fetcher(Protocol):
    def fetch(self, url: str, headers: dict[str, str]) -> Answer: ...


def fetch_rows(frontier: DataFrame, make: Callable[[], Fetcher], queue: str | None = None) -> DataFrame:
    """(id, http_status, error, headers, body) of each row (id, url, request_headers). An exception of the fetcher is an error of the request."""
    rows = frontier.select("id", "url", "request_headers", *([queue] if queue else []))
    rows = rows.repartition(queue) if queue else rows

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = make()
        for batch in batches:
            found = []
            for ident, url, headers in zip(batch["id"], batch["url"], batch["request_headers"]):
                try:
                    answer = fetcher.fetch(url, dict(headers or {}))
                except TimeoutError:
                    answer = Answer(error="timeout")
                except Exception:  # noqa: BLE001 - one page must not end the task
                    answer = Answer(error="request")
                found.append((ident, answer.status, answer.error, answer.headers or {}, answer.body))
            frame = pd.DataFrame(found, columns=["id", "http_status", "error", "headers", "body"])
            frame["http_status"] = frame["http_status"].astype("Int32")
            yield frame

    return rows.mapInPandas(work, ANSWER)


def fetch_from_table(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """The same answers from a table of pages (key, http_status, headers, body), a page that is not there being a timeout."""
    keyed = frontier.select("id", storage_key(F.col("id")).alias("key")).join(pages.select("key", "http_status", "headers", "body"), "key", "left")
    return keyed.select("id", "http_status", F.when(F.col("http_status").isNull(), "timeout").otherwise("").alias("error"), "headers", "body")
