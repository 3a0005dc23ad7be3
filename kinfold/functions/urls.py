"""URL identity: two URLs with one identity are one notice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

#: Query parameters that say where a visitor came from.
TRACKING = ["fbclid", "gclid", "mc_eid"]
SPLIT = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def percent_normal(c: Column) -> Column:
    """Escapes of unreserved characters decoded, others in upper case; malformed ones stay."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(%[0-9A-Fa-f]{2}|.)"), F.lit(1))

    def one(p: Column) -> Column:
        char = F.char(F.conv(F.substr(p, F.lit(2)), 16, 10).cast("int"))
        return F.when((F.length(p) == 3) & p.startswith("%"), F.when(char.rlike(r"^[A-Za-z0-9._~-]\z"), char).otherwise(F.upper(p))).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def residual_query(query: Column) -> Column:
    """Parameters in byte order, without tracking ones."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), percent_normal)
    name = lambda p: F.lower(F.split(p, "=", 2)[0])
    return F.array_join(F.array_sort(F.filter(pairs, lambda p: ~(name(p).startswith("utm_") | name(p).isin(*TRACKING)))), "&")


def identity(url: Column) -> Column:
    """Scheme and host in lower case, no user, fragment, default port or tracking; a URL without scheme or host as it is, trimmed, in lower case. Null stays null."""
    s = trim(url)
    scheme, authority, path, query = (F.regexp_extract(s, SPLIT, k) for k in (1, 2, 3, 4))
    scheme, host = F.lower(scheme), F.lower(F.regexp_replace(authority, r"(?s)^.*@", ""))
    port = F.regexp_extract(host, r":(\d*)\z", 1)
    bare = F.regexp_replace(host, r":\d*\z", "")
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.when(path == "", "/").otherwise(percent_normal(path))
    rest = residual_query(query)
    full = F.concat(scheme, F.lit("://"), bare, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest)))
    return F.when((scheme == "") | (bare == ""), F.lower(s)).otherwise(full)


def canonical_host(url: Column) -> Column:
    """Host of an http(s) URL without one leading www.; null for others, for control characters, and for nothing left."""
    host = F.regexp_extract(identity(url), r"^https?://([^/?#:]*)", 1)
    return F.when(~url.rlike(r"[\x00-\x1F\x7F]"), F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit("")))


def row_key(url: Column) -> Column:
    return F.sha2(identity(url), 256)
