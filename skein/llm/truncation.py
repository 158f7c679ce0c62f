"""Values cut off by field limits or in transfer, found by the longer copies they are prefixes of.

Addresses: all ids of all fields are sorted as one set; a value is a strict prefix of another exactly if it is one
of its successor. The raw address and the canonical one of a row are compared in canonical form; the one that is a
prefix of the other was cut. A field limit of a fetcher shows as a length that no value exceeds and many have.
Header values are sorted by name the same way, and one that is a prefix of the next was cut if it ends where no value
of its own would. Most have no longer copy. There the common values of a header, their shapes (words made one letter)
and their last words give their prefixes, by which the rare ones are joined; quotes, brackets and dates that are
opened but not closed say it as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import address_id
from skein.functions.urls import canonical_url
from skein.runtime import stage

ADDRESSES = ("url", "raw_url", "referrer_id")
KEYS = {"url": "id", "raw_url": "raw_id", "referrer_id": "referrer_id"}  # the id that stands for each field
LEAST_AT_LIMIT = 3
LEAST_LIMIT = 64  # a limit shorter than this must be shown by other cut values
SHOWN = 0.2
RARE = 20  # a value is rare beside another that is at least this many times as frequent
DATE = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d\d (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4} \d\d:\d\d:\d\d GMT$"
DATE_START = r"^(M|T|W|F|S)([a-z]([a-z](,.*)?)?)?$"
DATED = ("date", "expires", "last-modified")
QUOTED = ("etag", "link", "warning", "content-disposition")


def strict_prefixes(values: DataFrame) -> DataFrame:
    """(value, longer) of the distinct values that are strict prefixes of others, with the next value in order.

    ``values`` has a column value. One sort by ranges; where a range ends, its last value meets the first of the
    next range that has any, in one row per range.
    """
    ordered = values.filter("value is not null and value <> ''").distinct().repartitionByRange("value").sortWithinPartitions("value")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            found = []
            for value in batch.column(0).to_pylist():
                if last is None:
                    first = value
                elif value.startswith(last):
                    found.append((last, value))
                last = value
            yield _edge_batch([(a, b, None, None, None) for a, b in found])
        if last is not None:
            yield _edge_batch([(None, None, part, first, last)])

    scanned = stage(ordered.select("value").mapInArrow(scan, "value string, longer string, part int, first string, last string"), "prefixes")
    edges = scanned.filter("part is not null")
    rows = sorted(edges.select("part", "first", "last").collect())  # one row per range: as many as shuffle partitions
    over = [(a[2], b[1]) for a, b in zip(rows, rows[1:]) if b[1].startswith(a[2])]
    inner = scanned.filter("part is null").select("value", "longer")
    return inner.union(values.sparkSession.createDataFrame(over, "value string, longer string")) if over else inner


def _edge_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["value", "longer", "part", "first", "last"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    columns = list(zip(*rows)) or [[]] * 5
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def field_limits(lengths: DataFrame) -> DataFrame:
    """(fetcher, field, at): lengths at which a fetcher's field is cut, since many values have them and hardly any is longer.

    ``lengths`` is (fetcher, field, n_chars, h, shown) with a hash of the value and whether something else shows it as cut.
    A length counts if at least LEAST_AT_LIMIT different values have it, five times as many rows as an average length
    of the 50 below it, and ten times as many as all that are longer. Shorter than LEAST_LIMIT, where lengths
    are alike by nature, at least RARE rows must have it and one in five of them be shown as cut.
    """
    key = ["fetcher", "field"]
    counted = lengths.groupBy(*key, "n_chars").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("shown").cast("int")).alias("share"))
    order = Window.partitionBy(*key).orderBy("n_chars")  # one row for each length
    near = F.coalesce(F.sum("n").over(order.rangeBetween(-50, -1)), F.lit(0))
    longer = F.coalesce(F.sum("n").over(order.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    plain = (F.col("n_chars") >= LEAST_LIMIT) | ((F.col("n") >= RARE) & (F.col("share") >= SHOWN))
    steep = (
        counted.withColumns({"near": near, "longer": longer})
        .filter((F.col("n") >= LEAST_AT_LIMIT) & (F.col("n") * 10 >= F.col("near")) & (F.col("n") >= F.col("longer") * 10) & plain)
        .select(*key, "n_chars")
    )
    different = lengths.join(steep, [*key, "n_chars"], "left_semi").groupBy(*key, "n_chars", "h").agg(F.lit(1).alias("one"))
    return different.groupBy(*key, F.col("n_chars").alias("at")).agg(F.count("one").alias("n")).filter(F.col("n") >= LEAST_AT_LIMIT).drop("n")


def _words_end(value: Column, longer: Column) -> Column:
    """Whether the value ends within a word or right after or before a sign inside a query, not where a page of its own could end."""
    after = F.substr(longer, F.length(value) + 1, F.lit(1))
    return after.rlike(r"[\p{L}\p{N}&=+%_-]") & value.rlike(r"[\p{L}\p{N}&=+%_.?-]$")


LAST_WORD = r"(?:^|[^A-Za-z0-9])([A-Za-z]+)$"
WORDS = r"(?<![A-Za-z0-9])[A-Za-z]+(?![A-Za-z0-9])"


def cut_words(ids: DataFrame) -> DataFrame:
    """(last_word) of the words of addresses that are strict prefixes of words RARE times as frequent, so that an address can't end in them.

    ``ids`` has a column value; the words after the host count, those of letters only.
    """
    path = F.regexp_extract("value", "^[^/]*/(.*)$", 1)
    counts = stage(ids.select(F.explode(F.regexp_extract_all(path, F.lit(WORDS), 0)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    stems = (
        counts.filter((F.col("n") >= RARE) & (F.length("word") > 1))
        .select("n", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
        .groupBy(F.substr("word", F.lit(1), F.col("k")).alias("word")).agg(F.max("n").alias("common"))
    )
    return counts.join(stems, "word").filter(F.col("common") >= RARE * F.col("n")).select(F.col("word").alias("last_word"))


def cut_addresses(rows: DataFrame, elsewhere: DataFrame | None = None) -> DataFrame:
    """(row_id, field_name) of the url, raw_url and referrer_id values that end too early.

    ``rows`` is (row_id, fetcher, url, raw_url, referrer_id); ``elsewhere`` has more addresses in a column value,
    among which longer copies are looked for. Null and empty values are whole.
    """
    raw_id = address_id(canonical_url(F.col("raw_url"), drop_fragment=True))
    sides = rows.select(
        "row_id", F.coalesce("fetcher", F.lit("")).alias("fetcher"), "referrer_id", address_id(F.col("url")).alias("id"), raw_id.alias("raw_id"),
        *[F.length(f).alias(f"{f}_chars") for f in ADDRESSES], *[F.xxhash64(f).alias(f"{f}_hash") for f in ADDRESSES],
    )
    no = F.lit(False)
    tail = F.when(F.col("referrer_id").contains("/"), F.regexp_extract("referrer_id", LAST_WORD, 1))
    told = sides.withColumns(
        {
            "same": F.coalesce(F.col("id") == F.col("raw_id"), no),
            "url_less": F.coalesce((F.col("id") != F.col("raw_id")) & F.col("raw_id").startswith(F.col("id")), no),
            "raw_less": F.coalesce((F.col("id") != F.col("raw_id")) & F.col("id").startswith(F.col("raw_id")), no),
            "last_word": tail,
            "broken": F.coalesce(F.col("referrer_id").rlike("%[0-9A-Fa-f]?$"), no),
            **{f"{f}_key": F.xxhash64(c) for f, c in KEYS.items()},
            **{f"{f}_key_chars": F.length(c) for f, c in KEYS.items()},
        }
    )
    # the canonical raw address is kept only where it differs from the url
    own = stage(told.withColumn("raw_id", F.when(~F.col("same"), F.col("raw_id"))), "addresses")
    ids = own.select(F.explode(F.array("id", "raw_id", "referrer_id")).alias("value"))
    ids = ids.union(elsewhere.select(address_id(F.col("value")))) if elsewhere is not None else ids
    cut = strict_prefixes(ids).filter(_words_end(F.col("value"), F.col("longer")))
    shorter = stage(cut.select(F.xxhash64("value").alias("key"), F.length("value").alias("key_chars")).distinct(), "shorter")
    partial = cut_words(ids).withColumn("last_cut", F.lit(True))

    # from here on rows carry no address: 64-bit hashes and lengths stand for the values
    marked = own.drop("id", "raw_id", "referrer_id").join(partial, "last_word", "left")
    for f in ADDRESSES:
        hit = shorter.select(F.col("key").alias(f"{f}_key"), F.col("key_chars").alias(f"{f}_key_chars"), F.lit(True).alias(f"{f}_short"))
        marked = marked.join(hit, [f"{f}_key", f"{f}_key_chars"], "left")
    marked = stage(marked.drop(*[f"{f}_{c}" for f in ADDRESSES for c in ("key", "key_chars")], "last_word"), "marked")
    less = {"url": F.col("url_less"), "raw_url": F.col("raw_less"), "referrer_id": F.col("broken") | F.coalesce("last_cut", no)}
    shown = {f: F.coalesce(f"{f}_short", no) | less[f] for f in ADDRESSES}
    of = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"{f}_chars").alias("n_chars"), F.col(f"{f}_hash").alias("h"), shown[f].alias("shown"))
    lengths = marked.select("fetcher", F.explode(F.array(*map(of, ADDRESSES))).alias("x")).select("fetcher", "x.*").filter("n_chars > 0")
    limits = stage(field_limits(lengths), "limits")
    for f in ADDRESSES:
        own_limits = limits.filter(F.col("field") == f).select("fetcher", F.col("at").alias(f"{f}_chars"), F.lit(True).alias(f"{f}_at"))
        marked = marked.join(own_limits, ["fetcher", f"{f}_chars"], "left")
    at = {f: F.coalesce(f"{f}_at", no) for f in ADDRESSES}
    short = {f: F.coalesce(f"{f}_short", no) for f in ADDRESSES}
    same, url_less, raw_less = F.col("same"), F.col("url_less"), F.col("raw_less")
    # a whole raw address that gives this url shows that the url is whole, and the other way round
    url_cut = url_less | (at["url"] & ~(same & ~at["raw_url"])) | (short["url"] & ~raw_less)
    raw_cut = raw_less | (at["raw_url"] & ~(same & ~at["url"])) | (short["raw_url"] & ~url_less)
    referrer_cut = (at["referrer_id"] | short["referrer_id"] | F.col("broken") | F.coalesce("last_cut", no)) & (F.col("referrer_id_chars") > 0)
    found = F.array_compact(F.array(F.when(url_cut, "url"), F.when(raw_cut, "raw_url"), F.when(referrer_cut, "referrer_id")))
    return marked.select("row_id", F.explode(found).alias("field_name"))


def _shape(value: Column) -> Column:
    return F.regexp_replace(value, r"[\p{L}\p{N}]+( +[\p{L}\p{N}]+)*", "w")


def _unclosed(name: Column, value: Column) -> Column:
    """Quotes, brackets, lists and dates that are opened and not closed, by the grammar of the common headers."""
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"')))
    odd = name.isin(*QUOTED) & (quotes % 2 == 1)
    tag = (name == "etag") & ~value.rlike(r'^(W/)?"[^"]*"$') & value.rlike(r'^(W|W/|"|W/".*|".*)$')
    link = (name == "link") & (value.rlike(r"<[^>]*$") | value.rlike(r"[;,=]\s*$") | value.rlike(r";\s*[a-z]+$") | value.rlike(r">\s*;.*<[^>]*>$"))
    parameter = name.isin("content-type", "content-disposition", "set-cookie") & value.rlike(r"[;=]\s*$")
    date = name.isin(*DATED) & ~value.rlike(DATE) & value.rlike(DATE_START)
    return odd | tag | link | parameter | date


def _token_ends(name: Column, value: Column, longer: Column) -> Column:
    """Whether a header value ends within a word, an id or a parameter of the longer one, not where it could end by itself.

    A number goes on in a longer number, a word before a digit (a product and its version) and a list in a longer list: those are whole.
    """
    after = F.substr(longer, F.length(value) + 1, F.lit(1))
    word = value.rlike(r"\p{L}$") & after.rlike(r"\p{L}")
    mixed = value.rlike(r"(?=[\p{L}\p{N}]{4,}$)(\p{L}+\p{N}|\p{N}+\p{L})[\p{L}\p{N}]*$") & after.rlike(r"[\p{L}\p{N}]")
    sign = value.rlike(r"[-_=%]$") & after.rlike(r"[\p{L}\p{N}]")
    parameter = (name != "cache-control") & value.rlike(r"\p{L}$") & (after == "=")
    return word | mixed | sign | parameter


def cut_values(headers: DataFrame) -> DataFrame:
    """(name, value) of the header values (name, value) that a longer value of the same name shows as cut, whatever the frequency of either."""
    found = strict_prefixes(headers.select(F.concat_ws(_END, "name", "value").alias("value")))
    name, at = F.split("value", _END, 2)[0], F.split("value", _END, 2)[1]
    pairs = found.select(name.alias("name"), at.alias("value"), F.split("longer", _END, 2)[1].alias("longer"))
    return pairs.filter(_token_ends(F.col("name"), F.col("value"), F.col("longer"))).select("name", "value")


_END = "\u0001"  # stands between the name and the value of a header
LOOKS = ("value", "shape", "last")


def cut_headers(rows: DataFrame) -> DataFrame:
    """(row_id, name, n_chars) of the header values that end too early. Names count in any letter case; null and empty values are whole."""
    texts = {"value": F.col("value"), "shape": _shape(F.col("value")), "last": F.regexp_extract("value", r"([\p{L}\p{N}]+)$", 1)}
    headers = stage(
        rows.select("row_id", F.coalesce("fetcher", F.lit("")).alias("fetcher"), F.explode("response_headers").alias("header", "value"))
        .filter("value is not null and value <> ''")
        .withColumn("name", F.lower("header"))
        .select(
            "row_id", "fetcher", "name", *[c.alias(look) for look, c in texts.items()], F.length("value").alias("n_chars"), F.xxhash64("value").alias("h"),
            _unclosed(F.col("name"), F.col("value")).alias("unclosed"), F.col("value").rlike(r"^-?\d+$").alias("number"),
        ),
        "headers",
    )
    look = F.explode(F.array(*[F.struct(F.lit(x).alias("look"), F.col(x).alias("text")) for x in LOOKS])).alias("x")
    seen = headers.select("name", look).select("name", "x.look", "x.text").filter("text <> ''")
    counts = stage(seen.groupBy("name", "look", "text").agg(F.count(F.lit(1)).alias("n")), "looks")
    # the prefixes of common looks; a number is no prefix of a longer number
    common = counts.filter((F.col("n") >= RARE) & ~F.col("text").rlike(r"^\d+$"))
    stems = (
        common.filter(F.length("text") > 1)
        .select("name", "look", "n", "text", F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("k"))
        .select("name", "look", F.substr("text", F.lit(1), F.col("k")).alias("text"), F.col("n").alias("common"))
        .groupBy("name", "look", "text").agg(F.max("common").alias("common"))
    )
    rare = counts.join(stems, ["name", "look", "text"]).filter(F.col("common") >= RARE * F.col("n")).select("look", F.xxhash64("name", "text").alias("key"))
    shorter = cut_values(headers.select("name", "value")).select(F.lit("value").alias("look"), F.xxhash64("name", "value").alias("key"))
    rare = stage(rare.union(shorter).distinct(), "rare")
    keyed = headers.select("row_id", "fetcher", "name", "n_chars", "h", "unclosed", "number", *[F.xxhash64("name", x).alias(f"{x}_key") for x in LOOKS])
    for x in LOOKS:
        keyed = keyed.join(rare.filter(F.col("look") == x).select(F.col("key").alias(f"{x}_key"), F.lit(True).alias(f"{x}_rare")), f"{x}_key", "left")
    is_rare = F.coalesce(*[F.col(f"{x}_rare") for x in LOOKS], F.lit(False)) & ~F.col("number")  # a number is no part of anything
    judged = stage(keyed.select("row_id", "fetcher", "name", "n_chars", "h", (is_rare | F.col("unclosed")).alias("cut")), "judged")
    limits = field_limits(judged.select("fetcher", F.col("name").alias("field"), "n_chars", "h", F.col("cut").alias("shown"))).withColumnsRenamed({"field": "name", "at": "n_chars"})
    # a limit of a header counts if most of the values that have its length are visibly cut; the greatest length that RARE rows
    # have is a limit then, however short it is and however few different values have it
    counted = judged.groupBy("fetcher", "name", "n_chars").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("cut").cast("int")).alias("share"))
    top = counted.groupBy("fetcher", "name").agg(F.max(F.struct("n_chars", "n")).alias("top")).filter(F.col("top.n") >= RARE).select("fetcher", "name", "top.n_chars")
    proven = counted.filter("share >= 0.5").join(limits.union(top).distinct(), ["fetcher", "name", "n_chars"], "left_semi").drop("n")
    return judged.join(proven, ["fetcher", "name", "n_chars"], "left").filter("cut or share is not null").select("row_id", "name", "n_chars")


def cut_fields(rows: DataFrame, elsewhere: DataFrame | None = None) -> DataFrame:
    """(row_id, field_name) of each value that is cut short; response_headers once per row. Every row counts by itself, an empty table gives no rows."""
    headers = cut_headers(rows).select("row_id", F.lit("response_headers").alias("field_name")).distinct()
    return cut_addresses(rows, elsewhere).union(headers)
