"""Queries of the general corpus problems (p1, p5, p6, p7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import address_id, host_of
from skein.operators import drift, hierarchy, hotkeys
from skein.runtime import stage, table
from skein.streaming.dedup import repeated_deliveries


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_deliveries(spark, f"{sf_dir}/frontier_messages.parquet")


def p1_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = stage(p1_found(spark, sf_dir).withColumn("copy", F.lit(1)), "copies")
    messages = table(spark, sf_dir, "frontier_messages").select("delivery_id", "queue")
    return (
        messages.join(copies, "delivery_id", "left")
        .groupBy("queue")
        .agg(F.count(F.lit(1)).alias("n_deliveries"), F.count("copy").alias("n_copies"))
        .withColumn("n_kept", F.col("n_deliveries") - F.col("n_copies"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "stored_rows")).select("feed", "file_no", "change_kind", "field_name")


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "stored_rows")
    fields = stage(drift.line_fields(rows), "fields")
    names = stage(drift.unified_names(drift.schema_changes(rows, fields)), "names")
    return drift.consistent_table(rows, fields, names, drift.unified_types(fields, names))


def _keyed(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, Column, Column]]:
    """Rows, key and value in microseconds of each kind of key."""
    messages, pages = table(spark, sf_dir, "frontier_messages"), table(spark, sf_dir, "crawled_urls")
    return {
        "queue": (messages, F.col("queue"), F.unix_micros(F.col("received_at").cast("timestamp"))),
        "host": (pages, host_of(address_id(F.col("url"))), F.floor(F.col("fetched") * 1_000_000)),
    }


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heavy keys: those where the rank of 2% of all rows resolves in the key's own histogram."""
    parts = []
    for kind, (rows, key, value) in _keyed(spark, sf_dir).items():
        heavy = hotkeys.heavy_ranks(rows, key, value, rows.count())
        parts.append(heavy.select(F.lit(kind).alias("key_kind"), F.col("key").alias("key_value")))
    return parts[0].union(parts[1])


def p6_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for kind, (rows, key, value) in _keyed(spark, sf_dir).items():
        held = hotkeys.key_figures(rows, key, value, (0.5, 0.9))
        parts.append(
            held.select(
                F.lit(kind).alias("key_kind"), F.col("key").alias("key_value"), "n_rows",
                F.col("first").alias("first_us"), F.col("last").alias("last_us"), F.col("q0").alias("median_us"), F.col("q1").alias("p90_us"),
            )
        )
    return parts[0].union(parts[1])


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "redirected_urls")
    columns = ["row_id", "url", "referrer_id"]
    rows = table(spark, sf_dir, "crawled_urls").select(columns).union(sent.select(columns))
    return hierarchy.address_links(rows, sent.select("row_id", "url", "redirects_to"))[1]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.nested_sets(_links(spark, sf_dir)).filter("parent is not null").select(F.col("node").alias("row_id"), F.col("root").alias("root_id"))


def p7_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of trees of more than one node; pre is the place in the node's own tree."""
    sets = stage(hierarchy.nested_sets(_links(spark, sf_dir), with_path=True), "sets")
    tops = sets.filter("node = root").select("root", F.col("pre").alias("first"))
    return sets.join(tops, "root").select(
        F.col("node").alias("row_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", (F.col("pre") - F.col("first")).alias("pre"), "below", "path", "on_cycle"
    )


def p7_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestors of every node whose name is divisible by 20, by the ranges of all nodes."""
    sets = stage(hierarchy.nested_sets(_links(spark, sf_dir)).select("node", "pre", "below"), "sets")
    found = hierarchy.ancestors(sets, sets.filter(F.col("node") % 20 == 0).select("node", "pre"))
    return found.select(F.col("node").alias("row_id"), F.col("ancestor").alias("ancestor_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_queues, p5_found, p5_table, p6_found, p6_figures, p7_found, p7_hierarchy, p7_ranges)}

_KEYED = r"""
SELECT delivery_id, queue, received_at,
       CASE WHEN regexp_matches(regexp_replace(msg_id, '[\s{}]', '', 'g'), '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
            THEN lower(regexp_replace(msg_id, '[\s{}]', '', 'g')) ELSE msg_id END AS k
FROM frontier_messages WHERE msg_id IS NOT NULL
"""
_COPIES = f"""
SELECT delivery_id FROM (
  SELECT delivery_id, row_number() OVER (PARTITION BY queue, k ORDER BY received_at NULLS LAST, delivery_id) AS rn FROM ({_KEYED}) AS keyed
) AS ranked WHERE rn > 1
"""
_ID = r"regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '')"
_HOST = r"regexp_extract(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^([^?/:]*)', 1)"

_LINKS = rf"""rows_ AS (SELECT row_id, {_ID} AS id, referrer_id FROM crawled_urls WHERE url IS NOT NULL UNION ALL SELECT row_id, {_ID} AS id, referrer_id FROM redirected_urls WHERE url IS NOT NULL),
node AS (SELECT id, min(row_id) AS node, arg_min(referrer_id, row_id) FILTER (WHERE referrer_id IS NOT NULL) AS ref FROM rows_ GROUP BY id),
sent AS (SELECT regexp_replace(redirects_to, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS id, arg_min({_ID}, row_id) AS source FROM redirected_urls WHERE redirects_to IS NOT NULL AND url IS NOT NULL GROUP BY 1),
link AS (SELECT n.node, p.node AS parent FROM node n LEFT JOIN sent s ON n.id = s.id JOIN node p ON p.id = coalesce(s.source, n.ref))"""
# every node that reaches a node of a cycle has that among its ancestors; a cycle is cut at its least node
_WALK = """above AS (SELECT node, parent AS anc FROM link UNION SELECT a.node, l.parent FROM above a JOIN link l ON a.anc = l.node),
cyclic AS (SELECT node FROM above WHERE node = anc),
head AS (SELECT DISTINCT head AS node FROM (SELECT a.node, min(a.anc) AS head FROM above a WHERE a.node IN (SELECT node FROM cyclic) GROUP BY a.node) AS h),
top AS (SELECT node FROM head UNION SELECT parent FROM link WHERE parent NOT IN (SELECT node FROM link)),
walk AS (SELECT node, [node] AS path FROM top UNION ALL
  SELECT l.node, list_append(w.path, l.node) FROM walk w JOIN link l ON l.parent = w.node WHERE l.node NOT IN (SELECT node FROM head))"""

SQL = {
    "p1_found": _COPIES,
    "p1_queues": f"""
SELECT m.queue, CAST(count(*) AS BIGINT) AS n_deliveries, CAST(count(c.delivery_id) AS BIGINT) AS n_copies,
       CAST(count(*) - count(c.delivery_id) AS BIGINT) AS n_kept
FROM frontier_messages m LEFT JOIN ({_COPIES}) c ON m.delivery_id = c.delivery_id GROUP BY m.queue
""",
    "p6_found": f"""
SELECT 'queue' AS key_kind, queue AS key_value FROM frontier_messages WHERE queue IS NOT NULL
GROUP BY queue HAVING count(*) >= 0.02 * (SELECT count(*) FROM frontier_messages)
UNION ALL
SELECT 'host' AS key_kind, host AS key_value FROM (SELECT {_HOST} AS host FROM crawled_urls WHERE url IS NOT NULL) AS h
GROUP BY host HAVING count(*) >= 0.02 * (SELECT count(*) FROM crawled_urls)
""",
    "p7_found": rf"""
WITH RECURSIVE {_LINKS},
above AS (SELECT node, parent AS anc FROM link UNION SELECT a.node, l.parent FROM above a JOIN link l ON a.anc = l.node),
cyclic AS (SELECT node FROM above WHERE node = anc)
SELECT a.node AS row_id, min(a.anc) AS root_id FROM above a LEFT JOIN link l ON a.anc = l.node LEFT JOIN cyclic c ON a.anc = c.node
WHERE l.node IS NULL OR c.node IS NOT NULL GROUP BY a.node
""",
    "p7_hierarchy": rf"""
WITH RECURSIVE {_LINKS}, {_WALK},
placed AS (SELECT node, path, row_number() OVER (PARTITION BY path[1] ORDER BY path) - 1 AS pre FROM walk),
sizes AS (SELECT anc, count(*) - 1 AS below FROM (SELECT unnest(path) AS anc FROM walk) AS x GROUP BY anc)
SELECT p.node AS row_id, l.parent AS parent_id, p.path[1] AS root_id, CAST(len(p.path) - 1 AS BIGINT) AS depth, CAST(p.pre AS BIGINT) AS pre, CAST(s.below AS BIGINT) AS below, p.path,
       p.node IN (SELECT node FROM cyclic) AS on_cycle
FROM placed p JOIN sizes s ON p.node = s.anc LEFT JOIN link l ON p.node = l.node
""",
    "p7_ranges": rf"""
WITH RECURSIVE {_LINKS}, {_WALK}
SELECT node AS row_id, unnest(path[:-2]) AS ancestor_id FROM walk WHERE node % 20 = 0
""",
    "p6_figures": f"""
SELECT 'queue' AS key_kind, queue AS key_value, CAST(count(*) AS BIGINT) AS n_rows, min(us) AS first_us, max(us) AS last_us,
       quantile_disc(us, 0.5) AS median_us, quantile_disc(us, 0.9) AS p90_us
FROM (SELECT queue, epoch_us(received_at) AS us FROM frontier_messages WHERE queue IS NOT NULL) AS q GROUP BY queue
UNION ALL
SELECT 'host' AS key_kind, host AS key_value, CAST(count(*) AS BIGINT) AS n_rows, min(us) AS first_us, max(us) AS last_us,
       quantile_disc(us, 0.5) AS median_us, quantile_disc(us, 0.9) AS p90_us
FROM (SELECT {_HOST} AS host, CAST(floor(fetched * 1000000) AS BIGINT) AS us FROM crawled_urls WHERE url IS NOT NULL) AS h GROUP BY host
""",
}
