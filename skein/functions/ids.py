"""Column expressions for addresses and message ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def address_id(url: Column) -> Column:
    """The address without its scheme."""
    return F.regexp_replace(url, SCHEME, "")


def host_of(address: Column) -> Column:
    """Everything of an id before the first ``?``, ``/`` or ``:``."""
    return F.regexp_extract(address, r"^([^?/:]*)", 1)


def host_folded_id(url: Column) -> Column:
    """The id with its host in lower case, the rest as stored."""
    address = address_id(url)
    host = host_of(address)
    return F.concat(F.lower(host), F.substr(address, F.length(host) + 1))


def message_key(msg_id: Column) -> Column:
    """A UUID in one spelling (no white space, no braces, lower case); any other id as it is."""
    bare = F.regexp_replace(msg_id, r"(?U)[\s{}]", "")
    return F.when(bare.rlike(UUID), F.lower(bare)).otherwise(msg_id)
