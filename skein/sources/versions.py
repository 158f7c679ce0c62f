"""Readers of stored rows by version, and the codecs of rows and messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.schemas import MAX_TEXT, STRINGS, URL_ROW

VERSION_1 = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "lastCrawled", "referrer", "robotExclusionReasons", "googleBotExclusionReasons", "httpStatus", "redirectsTo")])
READERS: dict[int, Callable[[DataFrame], DataFrame]] = {}


def reader(version: int):
    def register(read: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        READERS[version] = read
        return read

    return register


def read_rows(rows: DataFrame, version: int) -> DataFrame:
    """Stored rows (body: one JSON object) of a version as current rows. Lines that are no object give a row of nulls in ``body``'s place."""
    if version not in READERS:
        raise ValueError(f"no reader for version {version}")
    return READERS[version](rows)


def epoch(value: Column) -> Column:
    """Epoch seconds of an ISO date."""
    return F.expr("null").cast("double") if value is None else value.try_cast("timestamp").cast("double")


@reader(1)
def _version_1(rows: DataFrame) -> DataFrame:
    """lastCrawled stands for discovered, requested and fetched; unknown fields become response headers."""
    fields = F.from_json("body", VERSION_1)
    every = F.from_json("body", "map<string,string>")
    known = [f.name for f in VERSION_1]
    crawled = epoch(F.col("f.lastCrawled"))
    return rows.withColumn("f", fields).withColumn("m", every).select(
        *[c for c in rows.columns if c != "body"],
        F.col("f.url").alias("url"), F.col("f.referrer").alias("referrer_id"), crawled.alias("discovered"), crawled.alias("requested"), crawled.alias("fetched"),
        F.col("f.httpStatus").try_cast("int").alias("http_status"), F.col("f.redirectsTo").alias("redirects_to"),
        F.from_json("f.robotExclusionReasons", STRINGS).alias("robot_exclusion_reasons"),
        F.from_json("f.googleBotExclusionReasons", STRINGS).alias("googlebot_exclusion_reasons"),
        F.transform_keys(F.map_filter("m", lambda k, v: ~k.isin(*known)), lambda k, v: F.lower(k)).alias("response_headers"),
    )


@reader(2)
def _version_2(rows: DataFrame) -> DataFrame:
    read = F.from_json("body", URL_ROW, {"mode": "PERMISSIVE"})
    return rows.withColumn("f", read).select(*[c for c in rows.columns if c != "body"], "f.*")


def pack_rows(rows: DataFrame) -> DataFrame:
    """(id, body): rows as JSON objects, strings cut to MAX_TEXT, null fields left out."""
    cut = [F.left(f, F.lit(MAX_TEXT)).alias(f) if t == "string" else F.col(f) for f, t in rows.dtypes if f != "id"]
    return rows.select("id", F.to_json(F.struct(*cut)).alias("body"))


def unpack_rows(packed: DataFrame, schema: T.StructType) -> DataFrame:
    return packed.select("id", F.from_json("body", schema).alias("f")).select("id", "f.*")


def pack_message(row: Column) -> Column:
    """Base64 of the JSON of a URL record."""
    return F.base64(F.to_json(row).cast("binary"))


def unpack_messages(messages: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds the record as ``record`` and ``corrupt`` where the message is null, no base64 or no JSON object."""
    text = F.try_validate_utf8(F.try_to_binary(F.col(column), F.lit("base64")).cast("string"))
    rows = messages.withColumn("_text", text).withColumn("record", F.from_json("_text", schema))
    whole = F.try_parse_json("_text")
    ok = whole.isNotNull() & F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    return rows.withColumn("corrupt", ~F.coalesce(ok, F.lit(False))).drop("_text")
