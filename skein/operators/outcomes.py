"""What becomes of a fetch: redirect, retry, failure, and the four outcome tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import address_id
from skein.functions.urls import canonical_url, join_url
from skein.runtime import stage
from skein.schemas import MAX_ATTEMPTS, MAX_REDIRECTS, MAX_TEXT, REDIRECT_STATUSES, URL_CLASSES


def status_class(status: Column) -> Column:
    """1xx to 5xx; other numbers are errors, null stays null."""
    return F.when(status.between(100, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).when(status.isNotNull(), "error")


def redirect_target(raw_url: Column, location: Column) -> Column:
    return canonical_url(join_url(raw_url, location))


def redirect_action(status: Column, address: Column, target: Column, hops: Column) -> Column:
    """none, self (same URL), refetch (same id under another scheme), too_many or follow."""
    return (
        F.when(~status.isin(*REDIRECT_STATUSES) | target.isNull(), "none")
        .when(hops >= MAX_REDIRECTS, "too_many")
        .when(target == address, "self")
        .when(address_id(target) == address_id(address), "refetch")
        .otherwise("follow")
    )


def keeps_body(status: Column) -> Column:
    """Of the redirects only 300 keeps its body."""
    return ~status.isin(*REDIRECT_STATUSES) | (status == 300)


def retry(error: Column, status: Column, attempts: Column, most: int = MAX_ATTEMPTS) -> Column:
    """done, requeue or failed. Gone pages and errors of the request itself fail, other errors are tried ``most`` times."""
    bad = (error != "") | (status >= 400)
    hopeless = (status == 410) | (error == "request")
    return F.when(~F.coalesce(bad, F.lit(False)), "done").when(F.coalesce(hopeless, F.lit(False)) | (attempts + 1 >= most), "failed").otherwise("requeue")


def route(rows: DataFrame) -> DataFrame:
    """Adds outcome: skipped, redirected, failed, requeue or crawled, of rows with reason, http_status, error and attempts."""
    again = retry(F.coalesce("error", F.lit("")), F.col("http_status"), F.coalesce("attempts", F.lit(0)))
    outcome = (
        F.when(F.col("reason") < URL_CLASSES["Crawled"], "skipped")
        .when(F.col("http_status").isin(*REDIRECT_STATUSES), "redirected")
        .when(again == "failed", "failed")
        .when(again == "requeue", "requeue")
        .otherwise("crawled")
    )
    return rows.withColumn("outcome", outcome)


def save_outcomes(routed: DataFrame, layout, batch: int | None = None) -> None:
    """Append each outcome to its table. With a batch number the folder of that batch is overwritten, so a batch that runs again leaves no copies."""
    names = {"crawled": "crawled_urls", "failed": "failed_urls", "skipped": "skipped_urls", "redirected": "redirected_urls", "requeue": "frontier"}
    for outcome, table in names.items():
        part = routed.filter(F.col("outcome") == outcome).drop("outcome")
        if batch is None:
            part.write.mode("append").parquet(layout.path(table))
        else:
            part.write.mode("overwrite").parquet(f"{layout.path(table)}/batch={batch}")


def log_rows(events: DataFrame) -> DataFrame:
    """Log rows with texts cut to MAX_TEXT: messages at the end, stack traces at the beginning."""
    return events.withColumns({"message": F.left("message", F.lit(MAX_TEXT)), "stacktrace": F.right("stacktrace", F.lit(MAX_TEXT))})


def redirect_chains(redirects: DataFrame, most: int = MAX_REDIRECTS) -> DataFrame:
    """(id, final_id, hops, looped, too_many): where the redirects of each id lead, at most ``most`` hops.

    ``redirects`` is (id, target), one row per id. Chains end at an id that does not redirect, at the limit (too_many, if
    the chain goes on there) or where they come back to their own start. Each round doubles the steps that a row holds,
    up to the limit; rows that have come to an end are not joined again.
    """
    state = redirects.select("id", F.array("target").alias("steps"), F.lit(True).alias("open"))
    reach = 1
    while reach <= most:
        ahead = state.select(F.col("id").alias("last"), F.col("steps").alias("more"))
        joined = state.filter("open").withColumn("last", F.element_at("steps", -1)).join(ahead, "last", "left")
        going = joined.select("id", F.concat("steps", F.coalesce("more", F.array().cast("array<string>"))).alias("steps"), F.col("more").isNotNull().alias("open"))
        state = stage(state.filter("not open").unionByName(going), "chains")
        reach *= 2
    back = F.array_position(F.slice("steps", 1, most), F.col("id"))
    hops = F.when(back > 0, back).otherwise(F.least(F.size("steps"), F.lit(most)))
    ended = state.select("id", "steps", hops.cast("int").alias("hops"), (back > 0).alias("looped"))
    return ended.select("id", F.element_at("steps", F.col("hops")).alias("final_id"), "hops", "looped", (~F.col("looped") & (F.size("steps") > most)).alias("too_many"))
