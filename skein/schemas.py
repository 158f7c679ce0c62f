"""Schemas of the stored tables and the fixed values of the data model."""

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
HEADERS = T.MapType(T.StringType(), T.StringType())

URL_ROW = T.StructType(
    [
        T.StructField("raw_url", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("fetcher", T.StringType()),
        T.StructField("discovered", T.DoubleType()),
        T.StructField("requested", T.DoubleType()),
        T.StructField("fetched", T.DoubleType()),
        T.StructField("referrer_id", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("original", T.StringType()),
        T.StructField("robot_exclusion_reasons", STRINGS),
        T.StructField("googlebot_exclusion_reasons", STRINGS),
        T.StructField("response_headers", HEADERS),
    ]
)

# Classes of a URL, as stored in skipped rows.
URL_CLASSES = {
    "Redundant": -7,
    "DUST": -6,
    "RobotExclusionStandard": -5,
    "ExcludedDomain": -4,
    "Redirect404": -3,
    "OutOfScope": -2,
    "ExcludeUrl": -1,
    "Crawled": 0,
    "InScope": 1,
}
# Statuses that redirect.
REDIRECT_STATUSES = (300, 301, 302, 303, 307, 308)
MAX_REDIRECTS = 20
MAX_ATTEMPTS = 2
MAX_TEXT = 1024
