"""URL functions as column expressions, after RFC 3986."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.ids import SCHEME, address_id

# Suffixes of two labels under which names are registered. A full table is read by ``read_suffixes``.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 section 5.2.4: ``.`` goes, ``..`` takes the segment before with it, a trailing one leaves its slash."""
    segments = F.split(path, "/")
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        segments,
        empty,
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
        .otherwise(F.concat(done, F.array(s))),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.when(path.contains("/."), F.array_join(tail, "/")).otherwise(path)


def canonical_url(raw: Column, lower_path: bool = True, drop_fragment: bool = False) -> Column:
    """Canonical form: trimmed, http:// if there is no scheme, scheme and host in lower case, no default port, no dot segments.

    The path is in lower case and, where it is empty, ``/`` only if ``drop_fragment`` is off; the query keeps its case.
    A null stays null.
    """

    def whole(raw: Column) -> Column:
        scheme = F.lower(F.when(raw.rlike(SCHEME), F.regexp_extract(raw, r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://", 1)).otherwise("http"))
        return let(scheme, lambda s: let(F.regexp_replace(raw, SCHEME, ""), lambda rest: parts(s, rest)))

    def parts(scheme: Column, rest: Column) -> Column:
        host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), ":$", "")
        port = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
        path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
        path = let(F.lower(path) if lower_path else path, remove_dot_segments)
        tail = F.regexp_extract(rest, r"^[^?#]*((?s).*)$", 1)
        tail = F.regexp_replace(tail, "(?s)#.*", "") if drop_fragment else tail
        return F.concat(scheme, F.lit("://"), port, path, tail)

    return let(F.trim(raw), whole)


def rooted(url: Column) -> Column:
    """The URL with ``/`` for an empty path, so that ``host`` and ``host/`` are one address."""
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)(?=$|[?#])", "$1/")


def read_suffixes(path: str) -> tuple[str, ...]:
    """The rules of a suffix table: a line each, blank lines and those that begin with // left out."""
    with open(path, encoding="utf-8") as lines:
        rules = (line.split()[0].lower() for line in lines if line.strip() and not line.startswith("//"))
        return tuple(dict.fromkeys(rules))


def registered_domain(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix and the label before it; a host that is a suffix stays whole.

    ``suffixes`` are rules of any number of labels. ``*.x`` stands for each label before x, ``!a.x`` makes an exception
    to that; the longest rule counts, the last label where there is none.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    plain = [s for s in suffixes if s[0] not in "*!"]
    wild, kept = [s[2:] for s in suffixes if s.startswith("*.")], [s[1:] for s in suffixes if s.startswith("!")]
    none = F.array().cast("array<int>")
    where = lambda test: F.filter(F.sequence(F.lit(1), n), test)
    found = where(lambda k: last(k).isin(*plain)) if plain else none
    found = F.concat(found, where(lambda k: (k > 1) & last(F.greatest(F.lit(1), k - 1)).isin(*wild))) if wild else found
    longest = F.coalesce(F.array_max(found), F.lit(1))
    longest = F.coalesce(F.array_max(where(lambda k: last(k).isin(*kept))) - 1, longest) if kept else longest
    return last(F.least(n, longest + 1))


def storage_key(address: Column) -> Column:
    """The id without trailing ``?`` and ``/``."""
    return F.regexp_replace(address, r"[?/]+$", "")


def change_scheme(url: Column, scheme: Column) -> Column:
    return F.concat(scheme, F.lit("://"), address_id(url))


def join_url(base: Column, reference: Column) -> Column:
    """RFC 3986 section 5.2: the URL that ``reference`` names on the page ``base``."""
    return let(base, lambda b: let(F.trim(reference), lambda r: _join(b, r)))


def _join(base: Column, reference: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    authority = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    before_fragment = F.regexp_replace(base, "(?s)#.*", "")
    before_query = F.regexp_replace(base, r"(?s)[?#].*", "")
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    path = F.regexp_extract(reference, "^([^?#]*)", 1)
    tail = F.regexp_extract(reference, r"^[^?#]*((?s).*)$", 1)
    return (
        F.when(reference.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), reference)
        .when(reference.startswith("//"), F.concat(scheme, reference))
        .when(reference == "", before_fragment)
        .when(reference.startswith("#"), F.concat(before_fragment, reference))
        .when(reference.startswith("?"), F.concat(before_query, reference))
        .when(reference.startswith("/"), F.concat(authority, let(path, remove_dot_segments), tail))
        .otherwise(F.concat(authority, let(F.concat(folder, path), remove_dot_segments), tail))
    )


def url_tokens(address: Column) -> Column:
    """The host followed by the segments of the path without the slashes at its ends; a bare host has one empty segment."""
    host = F.regexp_extract(address, "^([^/?#]*)", 1)
    path = F.regexp_extract(address, "^[^/?#]*([^?#]*)", 1)
    return F.concat(F.array(host), F.split(F.btrim(path, F.lit("/")), "/"))


def query_keys(address: Column) -> Column:
    """Distinct decoded keys of the query, those with a blank value left out. A percent sign without two hex digits stands for itself."""
    query = F.regexp_extract(address, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "[&;]"), lambda p: p.rlike("^[^=]*=.+"))
    key = lambda p: F.url_decode(F.regexp_replace(F.regexp_extract(p, "^([^=]*)", 1), "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.array_distinct(F.transform(pairs, key))


def transform_url(url: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) rules in order, in any letter case; each sees the result of the one before."""
    for pattern, replacement in rules:
        url = F.regexp_replace(url, f"(?i){pattern}", replacement)
    return url


def remove_parameters(url: Column, rules: list[tuple[str, str]]) -> Column:
    """Rules that take query parameters out; afterwards ``?`` and ``&`` are stripped at both ends."""
    return F.btrim(transform_url(url, rules), F.lit("?&"))
