"""Fingerprints, exact copies, near copies along referrers, caching and the content store."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.ids import host_of
from skein.functions.urls import storage_key
from skein.operators.hierarchy import depths
from skein.runtime import stage
from skein.schemas import URL_CLASSES

STAGNATION = 10  # a page that has not changed for ten times as long as it is old in the cache is taken from the cache
# Response headers that are kept with a stored body.
STORED_HEADERS = ("content-type", "content-disposition", "content-language", "expires")
NEAR, NEAR_SIZE, HISTORY = 0.9, 0.1, 5  # equal bits and difference in size of near copies; a longer run of them is dust
CODECS = ("none", "gzip", "deflate")


def strip_markup(kind: Column, text: Column, with_xhtml: bool = False) -> Column:
    """HTML without scripts, styles and tags and without any character but ASCII letters, digits and ``_``; other types as they are.

    A text that would be empty stays as it is.
    """
    bare = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</(script|style)\s*>", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\W+", "")
    kinds = ["text/html", *(["application/xhtml+xml"] if with_xhtml else [])]
    return F.when(kind.isin(*kinds) & (bare != ""), bare).otherwise(text)


def fingerprint(given: Column, stripped: Column) -> Column:
    return F.coalesce(given, F.sha1(stripped))


def originals(rows: DataFrame) -> DataFrame:
    """Rows with ``original``: self for the first of each fingerprint by (fetched, id), else the id of that one; null without fingerprint.

    The first is found with partial minima, so that a fingerprint of very many pages is not gathered.
    """
    first = rows.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min(F.struct(F.coalesce("fetched", F.lit(float("inf"))).alias("at"), F.col("id"))).alias("first"))
    joined = rows.drop("original").join(first, "fingerprint", "left")
    return joined.withColumn("original", F.when(F.col("fingerprint").isNull(), F.lit(None).cast("string")).when(F.col("id") == F.col("first.id"), "self").otherwise(F.col("first.id"))).drop("first")


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(fingerprint, n, first_id) of the fingerprints that more than one row has."""
    return rows.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")


ENDLESS = (1 << 31) - 1  # the count of a run without a beginning


def percent_diff(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.abs(a - b) / F.greatest(a, b))


def nilsimsa(texts: DataFrame) -> DataFrame:
    """(key, digest): the 256-bit locality digest of a body after the published algorithm (trigrams of a five-byte window, 53 as multiplier).

    ``texts`` is (key, body) with binary bodies; a null body has the digest of the empty one.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        table = _permutation()

        def tran(a, b, c, n):
            return (((table[(a + n) & 255] ^ table[b] * (n + n + 1)) + table[(c) ^ table[n]]) & 255).astype(np.int64)

        for batch in batches:
            found = []
            for body in batch["body"]:
                data = np.frombuffer(body or b"", np.uint8).astype(np.int64)
                counts = np.zeros(256, np.int64)
                total = 0
                # for each byte: the pairs of the four before it, in eight patterns
                for (i, j), seeds in {(1, 2): (0,), (1, 3): (1,), (2, 3): (2,), (1, 4): (3, 6), (2, 4): (4,), (3, 4): (5, 7)}.items():
                    n = len(data) - max(i, j)
                    if n <= 0:
                        continue
                    c, a, b = data[max(i, j) :], data[max(i, j) - i : len(data) - i], data[max(i, j) - j : len(data) - j]
                    for seed in seeds:
                        value = tran(c, a, b, seed) if seed < 6 else tran(b, a, c, seed)
                        counts += np.bincount(value, minlength=256)
                        total += n
                bits = counts > (total / 256 if total else 0)
                found.append(np.packbits(bits[::-1]).tobytes().hex())
            yield pd.DataFrame({"key": batch["key"], "digest": found})

    return texts.select("key", "body").mapInPandas(digest, f"key {dict(texts.dtypes)['key']}, digest string")


def _permutation():
    """The published table of 256 distinct bytes, from its rule."""
    import numpy as np

    table, j, seen = np.zeros(256, np.int64), 0, set()
    for i in range(256):
        j = (j * 53 + 1) & 255
        j += j
        j = j - 255 if j > 255 else j
        while j in seen:
            j = (j + 1) & 255
        seen.add(j)
        table[i] = j
    return table


def hex_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two 256-bit digests in hex."""
    part = lambda c, i: F.conv(F.substr(c, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("long")
    unequal = sum((F.bit_count(part(a, i).bitwiseXOR(part(b, i))) for i in range(8)), F.lit(0))
    return 1 - unequal / 256.0


def similar_runs(nodes: DataFrame, size: float = 0.1) -> DataFrame:
    """(id, count): how many ancestors in a row, from the node up, each link similar in size and content.

    ``nodes`` is (id, parent, size, similar), both ids long: ``similar`` tells whether the digest is near enough to that of the
    parent (null: no parent, or one without digest), sizes decide the rest. A size that is off leaves 0, as a digest that is
    off does. The links that are near make trees, in which the count is the depth; nodes of a cycle that is similar all
    round have no beginning and count ENDLESS.
    """
    parents = nodes.select(F.col("id").alias("parent"), F.col("size").alias("parent_size"))
    near = (percent_diff(F.col("size"), F.col("parent_size")) < size) & F.col("similar")
    links = stage(nodes.filter("parent is not null").join(parents, "parent").filter(near).select(F.col("id").alias("node"), "parent"), "near")
    runs = links.join(depths(links), "node", "left").select(F.col("node").alias("id"), F.coalesce("depth", F.lit(ENDLESS)).alias("count"))
    return nodes.select("id").join(runs, "id", "left").select("id", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def dust_skips(links: DataFrame, runs: DataFrame) -> DataFrame:
    """(page_id, id, reason, carries): the admitted links (page_id, referrer_id, id) of pages, less those of dust.

    ``runs`` is (page_id, dust, has_digest). Links of a page that is dust are skipped, with the class DUST; the others have a null
    reason. A link carries the page's state to the page it names if that is on the same host and the page has a digest.
    """
    joined = links.join(runs, "page_id", "left")
    own = host_of(F.lower("referrer_id")) == host_of(F.lower("id"))
    dust = F.coalesce("dust", F.lit(False))
    return joined.select("page_id", "id", F.when(dust, F.lit(URL_CLASSES["DUST"])).cast("long").alias("reason"), (~dust & own & F.coalesce("has_digest", F.lit(False))).alias("carries"))


def near_copies(pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """(id, count, dust, has_digest): how many ancestors in a row each page is a near copy of, and whether that is more than HISTORY.

    ``pages`` is (id, parent, key), ``bodies`` (key, body) with one stripped body of each key. Bodies are near if NEAR of the
    bits of their digests are equal and their sizes differ by less than NEAR_SIZE. A page without a body, or with an empty
    one, has no digest (has_digest is false): its count is 0, and the count of the pages below it begins again.
    """
    held = nilsimsa(bodies.filter(F.length("body") > 0)).withColumnRenamed("key", "digest_key")
    sizes = bodies.select("key", F.length("body").alias("size"))
    digests = stage(sizes.join(held, F.col("key") == F.col("digest_key")).drop("digest_key"), "digests")
    known = stage(pages.select("id", "parent", "key").join(digests, "key", "left").drop("key"), "pages")
    parents = known.select(F.col("id").alias("parent"), F.col("digest").alias("parent_digest"))
    similar = hex_similarity(F.col("digest"), F.col("parent_digest")) >= NEAR
    nodes = known.join(parents, "parent", "left").select("id", "parent", "size", similar.alias("similar"))
    runs = similar_runs(nodes, NEAR_SIZE)
    return runs.join(known.select("id", F.col("digest").isNotNull().alias("has_digest")), "id").select("id", "count", (F.col("count") > HISTORY).alias("dust"), "has_digest")


def http_date(value: Column) -> Column:
    """Timestamp of an HTTP date, null if it is none."""
    found = F.regexp_extract(value, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    return F.try_to_timestamp(F.concat(found, F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss Z"))


def format_http_date(at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def header(headers: Column, name: str) -> Column:
    """Value of a header, its name in any letter case."""
    held = F.map_filter(headers, lambda k, v: F.lower(k) == name)
    return F.get(F.map_values(held), 0)


def content_type(value: Column) -> Column:
    return F.lower(F.trim(F.split(value, ";")[0]))


def charset(value: Column) -> Column:
    """The charset a content-type names, null if none."""
    found = F.regexp_extract(value, r"""(?i)charset\s*=\s*["']?([\w.:-]+)""", 1)
    return F.when(found != "", F.lower(found))


def use_cached(fetched: Column, expires: Column, modified: Column, now: Column) -> Column:
    """Never fetched: no. Not expired: yes. Else whether it has been unchanged for STAGNATION times its age in the cache."""
    age = lambda a, b: a.cast("double") - b.cast("double")
    return (
        F.when(fetched.isNull(), False)
        .when(F.coalesce(expires > now, F.lit(False)), True)
        .when(modified.isNotNull(), age(now, modified) > STAGNATION * age(now, fetched))
        .otherwise(False)
    )


def fetch_plan(rows: DataFrame) -> DataFrame:
    """Adds had: how a page (use_cached, fetched, etag, answer, content_id of the stored body) is had.

    ``cache``: the stored body may be used unasked. A page that was fetched before or has an etag is asked for changes; on
    the answer 304 its stored body counts (``not_modified``), and if there is none it is fetched ``again`` without asking. Else it is ``fetched``.
    """
    stored, asked = F.col("content_id").isNotNull(), F.col("fetched").isNotNull() | F.col("etag").isNotNull()
    unchanged = F.coalesce(asked & (F.col("answer") == 304), F.lit(False))
    return rows.withColumn("had", F.when(F.col("use_cached") & stored, "cache").when(unchanged & stored, "not_modified").when(unchanged, "again").otherwise("fetched"))


def request_headers(referrer: Column, modified: Column, etag: Column) -> Column:
    """Referer, If-Modified-Since and If-None-Match, those that have a value."""
    pairs = F.create_map(F.lit("Referer"), referrer, F.lit("If-Modified-Since"), modified, F.lit("If-None-Match"), etag)
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def decode_text(body: Column, charset_name: Column) -> Column:
    """Text of a body in the charset it names (UTF-8 if none); one that is not known, or that the bytes do not fit, is read as Latin-1.

    UTF-8 and Latin-1 are read in the JVM, any other charset in Arrow batches.
    """
    name = F.lower(F.coalesce(charset_name, F.lit("utf-8")))
    utf8, latin = name.isin("utf-8", "utf8", "us-ascii", "ascii"), name.isin("iso-8859-1", "latin-1", "latin1")
    other = _decoded(F.when(~utf8 & ~latin, body), name)
    return F.when(utf8 & F.is_valid_utf8(body.cast("string")), F.decode(body, "utf-8")).otherwise(F.coalesce(other, F.decode(body, "iso-8859-1")))


@F.pandas_udf(T.StringType())
def _decoded(body: pd.Series, name: pd.Series) -> pd.Series:
    def read(data, charset):
        try:
            return None if data is None else bytes(data).decode(charset)
        except (LookupError, UnicodeError, ValueError):
            return None

    return pd.Series([read(b, n) for b, n in zip(body, name)], dtype=object)


def pack_bodies(rows: DataFrame, codec: str = "gzip") -> DataFrame:
    """(key, body, meta) for the content store; bodies packed by none, gzip or deflate."""
    if codec not in CODECS:
        raise ValueError(f"no such codec: {codec}")
    work = {"none": lambda b: b, "gzip": lambda b: gzip.compress(b, mtime=0), "deflate": zlib.compress}[codec]
    return _recode(rows, work)


def unpack_bodies(rows: DataFrame, codec: str = "gzip") -> DataFrame:
    if codec not in CODECS:
        raise ValueError(f"no such codec: {codec}")
    work = {"none": lambda b: b, "gzip": gzip.decompress, "deflate": zlib.decompress}[codec]
    return _recode(rows, work)


def _recode(rows: DataFrame, work) -> DataFrame:
    @F.pandas_udf("binary")
    def recode(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else work(bytes(b)))

    return rows.withColumn("body", recode("body"))


def store_rows(pages: DataFrame) -> DataFrame:
    """(key, body, meta) of crawled pages (id, url, original, body, response_headers); of one key the last row by fetched counts."""
    kept = F.map_filter("response_headers", lambda k, v: F.lower(k).isin(*STORED_HEADERS) & v.isNotNull())
    own = F.create_map(F.lit("original_url"), F.col("url"), F.lit("original"), storage_key(F.coalesce("original", F.lit("self"))))
    order = F.struct(-F.coalesce("fetched", F.lit(float("-inf"))), F.col("id"))
    row = F.struct("body", F.map_concat(own, F.transform_keys(kept, lambda k, v: F.lower(k))).alias("meta"))
    best = pages.groupBy(storage_key(F.col("id")).alias("key")).agg(F.min_by(row, order).alias("best"))
    return best.select("key", "best.body", "best.meta")


def cache_lookup(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Wanted ids with the stored body, null where there is none; a miss means the page is fetched again."""
    return wanted.withColumn("key", storage_key(F.col("id"))).join(store.select("key", F.col("body").alias("stored_body")), "key", "left")
