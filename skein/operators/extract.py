"""Links of pages: one row per link, from mark-up, style sheets and site maps."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.ids import address_id
from skein.functions.urls import canonical_url, join_url, let, rooted

# Mark-up that is no element: comments, and what scripts and styles hold. Their own tags stay, as scripts have links.
SILENT = r"""(?is)<!--.*?-->|(<(script|style)\b[^>]*>).*?(?=</\2\s*>)"""
TAG = r"""<[a-zA-Z](?:[^<>"']|"[^"]*"|'[^']*')*+>"""
ATTRIBUTE = r"""[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""
OBJECT_DATA = r"""(?i)<object\b[^>]*?\bdata\s*=\s*(?:"[^"]*"|'[^']*')"""
BASE = r"""(?i)<base\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""
CSS_URL = r"""(?i)url\(\s*["']?[^"')]*["']?\s*\)"""


def _bare(found: Column) -> Column:
    """The value of ``name = "value"``."""
    return F.trim(F.regexp_replace(F.regexp_replace(found, r"(?s)^[^=]*=\s*", ""), r"""^["']|["']$""", ""))


def wanted(value: Column) -> Column:
    """Neither empty nor a script or mail link."""
    return (value != "") & ~F.lower(value).contains("javascript:") & ~F.lower(value).contains("mailto:")


@F.pandas_udf(T.StringType())
def _unescaped(value: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else html.unescape(v) for v in value], dtype=object)


def unescape(value: Column) -> Column:
    """The value with its character references resolved; only values that have any go to Python."""
    return F.coalesce(_unescaped(F.when(value.contains("&"), value)), value)


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, page_url, value, link) of each href and src of each page; the first base, if any, takes the place of the page's URL.

    ``pages`` is (page_id, url, body) with text bodies. Script and mail links and empty ones are left out; null bodies have no links.
    """
    # all that needs the body comes before the links are made rows
    tags = F.regexp_extract_all(F.regexp_replace("body", SILENT, "$1"), F.lit(TAG), 0)
    split = pages.select("page_id", F.col("url").alias("page_url"), tags.alias("tags"))
    base = F.get(F.filter(F.transform("tags", lambda t: F.regexp_extract(t, BASE, 1)), lambda b: b != ""), 0)
    own = F.filter("tags", lambda t: t.rlike(r"(?i)\b(?:href|src)\s*="))
    attributes = F.flatten(F.transform(own, lambda t: F.filter(F.regexp_extract_all(t, F.lit(ATTRIBUTE), 0), lambda a: a.rlike(r"(?i)^(?:href|src)\s*="))))
    found = split.select("page_id", "page_url", base.alias("base"), F.transform(attributes, _bare).alias("found"))
    around = F.when(F.col("base").isNotNull(), join_url(F.col("page_url"), F.col("base"))).otherwise(F.col("page_url"))
    rows = found.select("page_id", "page_url", around.alias("base"), F.explode("found").alias("value"))
    values = rows.withColumn("value", F.trim(unescape(F.col("value")))).filter(wanted(F.col("value")))
    return values.select("page_id", "page_url", "value", join_url(F.col("base"), F.col("value")).alias("link"))


def object_links(pages: DataFrame) -> DataFrame:
    """(page_id, page_url, value, link) of ``<object data>`` that begin with http."""
    found = pages.select("page_id", F.col("url").alias("page_url"), F.explode(F.regexp_extract_all(F.regexp_replace("body", SILENT, "$1"), F.lit(OBJECT_DATA), 0)).alias("found"))
    value = unescape(F.regexp_extract("found", r"""(?i)\bdata\s*=\s*["']([^"']*)["']$""", 1))
    return found.select("page_id", "page_url", value.alias("value"), value.alias("link")).filter(F.col("value").startswith("http"))


def css_links(sheets: DataFrame) -> DataFrame:
    """(page_id, page_url, value, link) of ``url(...)`` in plain rules; comments and at-rules are left out."""
    plain = F.regexp_replace("body", r"(?s)/\*.*?\*/", "")
    plain = F.regexp_replace(plain, r"(?s)@[\w-]+[^{};]*\{(?:[^{}]|\{[^{}]*\})*\}", "")
    plain = F.regexp_replace(plain, r"@[^;{}]*;", "")
    found = sheets.select("page_id", F.col("url").alias("page_url"), F.explode(F.regexp_extract_all(plain, F.lit(CSS_URL), 0)).alias("found"))
    value = F.regexp_replace("found", r"""(?i)^url\(\s*["']?|["']?\s*\)$""", "")
    rows = found.select("page_id", "page_url", value.alias("value")).filter("value <> ''")
    return rows.withColumn("link", join_url(F.col("page_url"), F.col("value")))


def sitemap_links(sitemaps: DataFrame) -> DataFrame:
    """(page_id, page_url, value, link): each line of a .txt map, each element of an .xml map whose name ends in loc (is loc, in an index).

    Values are trimmed and must begin with http. Malformed XML and other endings have none.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        for batch in batches:
            rows = []
            for page_id, url, body in zip(batch["page_id"], batch["url"], batch["body"]):
                found = []
                path = (url or "").split("?")[0].lower()
                if body and path.endswith(".txt"):
                    found = body.splitlines()
                elif body and path.endswith(".xml"):
                    try:
                        root = ET.fromstring(body.strip())
                    except ET.ParseError:
                        root = None
                    if root is not None:
                        index = root.tag.rpartition("}")[2] == "sitemapindex"
                        names = ((e.tag.rpartition("}")[2], e.text) for e in root.iter())
                        found = [t for n, t in names if t and (n == "loc" if index else n.endswith("loc"))]
                rows += [(page_id, url, v) for v in dict.fromkeys(t.strip() for t in found) if v.startswith("http")]
            yield pd.DataFrame(rows, columns=["page_id", "page_url", "value"])

    kinds = dict(sitemaps.dtypes)
    rows = sitemaps.select("page_id", "url", "body").mapInPandas(parse, f"page_id {kinds['page_id']}, page_url string, value string")
    return rows.withColumn("link", F.col("value"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(page_id, page_url, value, link): the site maps that robots texts name, and /sitemap.xml of each host."""
    named = robots.select("page_id", F.col("url").alias("page_url"), F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), 1)).alias("value"))
    default = robots.select("page_id", F.col("url").alias("page_url"), F.concat(F.regexp_extract("url", "^([a-zA-Z]+://[^/]*)", 1), F.lit("/sitemap.xml")).alias("value"))
    return named.union(default).distinct().withColumn("link", F.col("value"))


def extract_links(pages: DataFrame) -> DataFrame:
    """Links of pages of any type, chosen by content_type: HTML, style sheet or site map; other types have none. A site map is told by its content_type sitemap."""
    kind = F.lower(F.trim(F.split(F.col("content_type"), ";")[0]))
    markup = pages.filter(kind.isin("text/html", "application/xhtml+xml"))
    return html_links(markup).union(object_links(markup)).union(css_links(pages.filter(kind == "text/css"))).union(sitemap_links(pages.filter(kind == "sitemap")))


def link_edges(links: DataFrame) -> DataFrame:
    """(page_id, referrer_id, id, link): canonical, one row per page and id, without links of a page to itself."""
    whole = lambda c: rooted(canonical_url(F.col(c), drop_fragment=True))
    # the page's own id is worked out once for each page, not for each link
    pages = links.select("page_id", "page_url").distinct().select("page_id", address_id(whole("page_url")).alias("referrer_id"))
    ids = links.select("page_id", let(whole("link"), lambda u: F.struct(u.alias("link"), address_id(u).alias("id"))).alias("l"))
    once = ids.groupBy("page_id", "l.id").agg(F.min("l.link").alias("link"))
    return once.join(pages, "page_id").filter("id <> referrer_id").select("page_id", "referrer_id", "id", "link")
