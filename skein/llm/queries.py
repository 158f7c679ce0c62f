"""Queries of the problems on training text, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import boilerplate, encode, leak, pieces, seen, truncation
from skein.llm.tokens import Vocabulary
from skein.runtime import stage, table


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "redirected_urls")
    more = sent.select(F.explode(F.array("url", "redirects_to", "referrer_id")).alias("value"))
    return truncation.cut_fields(table(spark, sf_dir, "crawled_urls"), more)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir)


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each fetcher cuts each field."""
    rows = table(spark, sf_dir, "crawled_urls").select("row_id", "fetcher")
    cut = stage(_cut(spark, sf_dir), "cut")
    fields = F.explode(F.array(*[F.lit(f) for f in (*truncation.ADDRESSES, "response_headers")])).alias("field_name")
    every = rows.select("row_id", "fetcher", fields).join(cut.withColumn("cut", F.lit(1)), ["row_id", "field_name"], "left")
    counted = every.groupBy("fetcher", "field_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count("cut").alias("n_cut"))
    return counted.withColumn("share", F.col("n_cut") / F.col("n_rows"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_body(table(spark, sf_dir, "crawled_content"))


def p3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.body_text(table(spark, sf_dir, "crawled_content"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.seen_before(table(spark, sf_dir, "crawled_urls"), table(spark, sf_dir, "seen_urls"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).filter("not wrong").select("row_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_rows, n_seen = table(spark, sf_dir, "crawled_urls").count(), table(spark, sf_dir, "seen_urls").count()
    return seen.error_rates(_checked(spark, sf_dir), n_rows, n_rows + n_seen)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents"), Vocabulary(spark))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: the texts of all ids."""
    vocabulary = Vocabulary(spark)
    return encode.decode_corpus(encode.encode_corpus(table(spark, sf_dir, "documents"), vocabulary), vocabulary)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of equal templates, checked slot by slot, in which all words are equal."""
    passages = leak.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return passages.filter("n_equal > 0").select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item that leaked, as it is or with other values, and in how many documents."""
    passages = leak.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return passages.groupBy("item_id").agg(
        F.count(F.when(F.col("n_equal") > 0, 1)).alias("n_documents"),
        F.count(F.when(F.col("n_equal") == 0, 1)).alias("n_changed_documents"),
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized(table(spark, sf_dir, "documents"), Vocabulary(spark))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_pieces(table(spark, sf_dir, "documents"), Vocabulary(spark))


QUERIES = {f.__name__: f for f in (p2_found, p2_shares, p3_found, p3_bodies, p4_found, p4_rates, p8_ids, p8_decoded, p9_found, p9_items, p10_found, p10_pieces)}

_ID = r"regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '')"
_KEY = f"lower(regexp_extract({_ID}, '^([^?/:]*)', 1)) || substr({_ID}, length(regexp_extract({_ID}, '^([^?/:]*)', 1)) + 1)"

_WINDOWS = r"""
SELECT DISTINCT {0}, array_to_string(list_slice(w, i, i + 11), ' ') AS passage FROM (
  SELECT {0}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {0}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {1}) AS t WHERE len(w) >= 12) AS x
"""

SQL = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_WINDOWS.format('doc_id', 'documents')}) AS d JOIN ({_WINDOWS.format('item_id', 'eval_items')}) AS e ON d.passage = e.passage",
    "p4_found": f"""
SELECT row_id FROM (
  SELECT row_id, k, row_number() OVER (PARTITION BY k ORDER BY row_id) AS rn FROM (SELECT row_id, {_KEY} AS k FROM crawled_urls WHERE url IS NOT NULL) AS c
) AS ranked WHERE rn > 1 OR k IN (SELECT {_KEY} FROM seen_urls WHERE url IS NOT NULL)
""",
}
