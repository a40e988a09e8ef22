"""URL functions: canonical form, hosts, source priority, safety."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from wirelark.functions.text import strip

# Results depend on them.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid".split()
PRIMARY_DOMAINS = (
    "bleepingcomputer.com cisa.gov darkreading.com google.com googleblog.com krebsonsecurity.com meta.com "
    "microsoft.com securityweek.com thehackernews.com therecord.media"
).split()
REWRITE_DOMAINS = "benzinga.com itpro.com mexc.com newsbytesapp.com".split()
AGGREGATORS = ("gdelt", "google news")

#: RFC 3986, appendix B, with the part after ";" of the last path segment apart.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def _decoded(c: Column) -> Column:
    plain = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(c), plain)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonicalize(url: Column) -> Column:
    """One form for a page: no fragment, tracking or blank parameters, sorted query, lower-case scheme and host.

    Null stays null; a URL without a host keeps scheme and path ("https:/a").
    """
    u = F.regexp_replace(strip(url), r"[\t\r\n]", "")
    scheme = F.coalesce(F.nullif(F.lower(_part(u, 1)), F.lit("")), F.lit("https"))
    host = F.lower(_part(u, 2))
    path = F.regexp_replace(_part(u, 3), r";[^/]*$", "")
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    pairs = F.filter(
        F.transform(
            F.split(_part(u, 4), "&"),
            lambda p: F.struct(
                _decoded(F.substring_index(p, "=", 1)).alias("k"),
                _decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", ""))).alias("v"),
            ),
        ),
        lambda s: s["v"].isNotNull() & (s["v"] != "") & ~F.lower(s["k"]).isin(TRACKING),
    )
    query = F.array_join(
        F.transform(F.array_sort(pairs), lambda s: F.concat(_encoded(s["k"]), F.lit("="), _encoded(s["v"]))), "&"
    )
    rest = F.when(F.startswith(path, F.lit("/")) | (host == ""), path).otherwise(F.concat(F.lit("/"), path))
    front = F.when(host != "", F.concat(scheme, F.lit("://"), host)).otherwise(F.concat(scheme, F.lit(":")))
    return F.concat(front, rest, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def host(url: Column) -> Column:
    """Lower case, without a leading "www."; a port stays."""
    return F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")


def _within(h: Column, domains: list[str]) -> Column:
    return h.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")


def source_priority(source_name: Column, url: Column) -> Column:
    """3 primary domain, 0 rewriting domain, 1 aggregator by name, 2 any other, tried in this order."""
    h = host(url)
    return (
        F.when(_within(h, PRIMARY_DOMAINS), 3)
        .when(_within(h, REWRITE_DOMAINS), 0)
        .when(F.lower(strip(source_name)).isin(*AGGREGATORS), 1)
        .otherwise(2)
    )


@F.pandas_udf(BooleanType())
def _public_ip(h: pd.Series) -> pd.Series:
    def one(x: str | None) -> bool:
        if not x:
            return False
        try:
            ip = ipaddress.ip_address(x)
        except ValueError:
            return True
        bad = ip.is_loopback or ip.is_private or ip.is_link_local or ip.is_multicast or ip.is_reserved
        bad = bad or ip.is_unspecified or getattr(ip, "is_site_local", False)
        return ip.is_global and not bad

    return h.map(one).astype(bool)


def is_safe(url: Column) -> Column:
    """A public http(s) address without user data. Names are not resolved here. Null and malformed are unsafe.

    Only hosts that look like an IP literal go to Python.
    """
    u = strip(url)
    netloc = _part(u, 2)
    bare = F.regexp_replace(F.regexp_replace(F.lower(netloc), r":\d*$", ""), r"\.+$", "")
    inner = F.regexp_replace(bare, r"^\[|\]$", "")
    literal = inner.rlike(r"^[0-9.]+$|:")
    ok = (
        F.lower(_part(u, 1)).isin("http", "https")
        & ~F.contains(netloc, F.lit("@"))
        & (inner != "")
        & ~inner.isin("localhost", "localhost.localdomain")
        & ~bare.rlike(r"\s")
    )
    return F.coalesce(ok & F.when(literal, _public_ip(F.when(literal, inner))).otherwise(F.lit(True)), F.lit(False))
