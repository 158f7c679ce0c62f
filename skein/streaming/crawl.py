"""The crawl step as a stream: from frontier messages to outcomes.

Messages are unpacked, met with what the fetches answered and the bodies that were stored, and judged. The deliveries of
one id are handled in their order: the first is a fetch; after a failure that may pass the next one is another try, up
to the greatest number of attempts; once an id is done, later deliveries are dropped. How often an id was tried, or that
it is done, is the keyed state of the stream (pages of hashes, as in ``dedup``), so that no batch reads what earlier ones
wrote. Corrupt messages go to the dead letters. State and output of a micro-batch are committed together: its folder bears
its number and is overwritten when it runs again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from skein.config import Scope
from skein.functions.urls import storage_key
from skein.operators.admission import is_spider_trap, scope_class
from skein.operators.outcomes import route
from skein.runtime import stage
from skein.schemas import MAX_ATTEMPTS
from skein.sources.versions import unpack_messages

RECORD = "raw_url string, url string, id string, referrer_id string, discovered double, is_seed boolean"
ROUTED = "delivery_id long, id string, url string, outcome string, reason long, content_id long"
DONE = -1


def answered(crawled: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The answer of each id (of several the greatest status) and the body of each key (the last), worked out once for all batches."""
    answers = crawled.groupBy("id").agg(F.max("http_status").alias("http_status"))
    return stage(answers, "answers"), stage(bodies.groupBy("key").agg(F.max("content_id").alias("content_id")), "bodies")


def judged(messages: DataFrame, answers: DataFrame, stored: DataFrame, scope: Scope, attempts: Column | None = None) -> DataFrame:
    """ROUTED of each message (delivery_id, frontier_message), as its first try or after ``attempts``; the outcome of a corrupt one is dead."""
    read = unpack_messages(messages, "frontier_message", RECORD)
    bad = F.col("corrupt") | F.col("record.id").isNull()
    rows = read.select("delivery_id", F.when(~bad, F.col("record.id")).alias("id"), F.when(~bad, F.col("record.url")).alias("url"), bad.alias("dead"))
    fetched = rows.join(answers, "id", "left").withColumn("key", storage_key(F.col("id"))).join(stored, "key", "left")
    reason = F.when(scope_class(F.col("url"), scope) < 1, scope_class(F.col("url"), scope)).when(is_spider_trap(F.col("id")), -8).otherwise(1)
    routed = route(
        fetched.withColumns({"reason": reason, "error": F.when(F.col("http_status").isNull(), "timeout").otherwise(""), "attempts": F.lit(0) if attempts is None else attempts})
    )
    outcome = F.when(F.col("dead"), "dead").otherwise(F.col("outcome"))
    return routed.select("delivery_id", "id", "url", outcome.alias("outcome"), F.col("reason").cast("long").alias("reason"), F.col("content_id").cast("long").alias("content_id"))


def crawl_step(messages: DataFrame, crawled: DataFrame, bodies: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """Routed rows (id, url, outcome, reason, content_id) and the dead letters (delivery_id) of one batch of messages: of one id the first delivery."""
    rows = judged(messages, *answered(crawled, bodies), scope)
    alive = rows.filter("outcome <> 'dead'")
    first = alive.groupBy("id").agg(F.min("delivery_id").alias("delivery_id"))
    return alive.join(first, ["id", "delivery_id"], "left_semi").drop("delivery_id"), rows.filter("outcome = 'dead'").select("delivery_id")


def tries(held: np.ndarray, keys: np.ndarray, order: np.ndarray, again: np.ndarray, most: int):
    """Which deliveries are handled, which of them fail for good, and the new state.

    ``held`` has the columns h1, h2, n (tries so far, or DONE); of the deliveries, ``keys`` has h1 and h2, ``order`` their
    place in time, and ``again`` whether they would be tried again.
    """
    sort = np.lexsort((order, keys[:, 1], keys[:, 0]))
    keys, again = keys[sort], again[sort]
    both = np.concatenate([held, np.column_stack([keys, np.zeros(len(keys), np.int64)])])
    _, first, code = np.unique(both[:, :2], axis=0, return_index=True, return_inverse=True)
    code = code.reshape(-1)
    before = np.zeros(len(first), np.int64)
    before[code[: len(held)]] = held[:, 2]
    own = code[len(held) :]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(own))))
    place = np.arange(len(own)) - start[group]
    settled = np.cumsum(~again) - ~again  # deliveries before, of any key, that settle theirs
    open_ = (before[own] != DONE) & (settled == settled[start][group]) & (before[own] + place < most)
    last = open_ & again & (before[own] + place + 1 >= most)
    done = np.zeros(len(first), bool)
    np.logical_or.at(done, own, open_ & (~again | last))
    count = before + np.bincount(own[open_], minlength=len(first))
    state = np.column_stack([both[first][:, :2], np.where(done | (before == DONE), DONE, count)])
    back = np.empty(len(sort), np.int64)
    back[sort] = np.arange(len(sort))
    return open_[back], last[back], state


def run_crawl(messages: DataFrame, crawled: DataFrame, bodies: DataFrame, scope: Scope, run_batches, pages: int = 256) -> str:
    """Run the step over a stream of messages (delivery_id, frontier_message); the folder, with ROUTED per batch under ``routed``. Batches come in the order of deliveries."""
    rows = judged(messages, *answered(crawled, bodies), scope)
    keyed = rows.withColumns({"h1": F.xxhash64("id"), "h2": F.xxhash64("id", F.lit(7))})
    alive = keyed.filter("outcome <> 'dead'").withColumn("page", F.pmod("h1", F.lit(pages)).cast("int"))

    def handle(page, batches, state):
        held = np.frombuffer(state.get[0], np.int64).reshape(-1, 3) if state.exists else np.empty((0, 3), np.int64)
        rows = pd.concat(list(batches), ignore_index=True)
        open_, last, held = tries(held, rows[["h1", "h2"]].to_numpy(np.int64), rows["delivery_id"].to_numpy(np.int64), (rows["outcome"] == "requeue").to_numpy(bool), MAX_ATTEMPTS)
        state.update((held.tobytes(),))
        rows.loc[last, "outcome"] = "failed"
        yield rows.loc[open_, [c.split()[0] for c in ROUTED.split(", ")]]

    handled = alive.groupBy("page").applyInPandasWithState(handle, ROUTED, "entries binary", "append", GroupStateTimeout.NoTimeout)
    dead = keyed.filter("outcome = 'dead'").select(*handled.columns)

    def work(batch: DataFrame, number: int, folder: str) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/routed/batch={number}")

    return run_batches(handled.unionByName(dead), "crawl", work)
