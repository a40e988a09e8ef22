"""Fetching over HTTP: every address is checked, also those a page redirects to, and no body is read past a limit.

fetch_pages() is a DataFrame step (one row an address, on Arrow batches) for runs that fetch their pages themselves. The
network and name resolution are arguments, so that both can be replaced. Defined results: an address that is null, unsafe or
cannot be fetched gives a row with a null body and an error; repeated addresses are fetched once a batch.
"""

from __future__ import annotations

import ipaddress
import socket
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from http.client import HTTPException, HTTPMessage
from typing import NamedTuple
from urllib.error import HTTPError
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, ProxyHandler, Request, build_opener

import pandas as pd
from pyspark.sql import DataFrame

from wirelark.operators.html import CONTENT_TYPES, MAX_BYTES

HOPS, ATTEMPTS, CHUNK = 5, 3, 1 << 16


class Refused(Exception):
    """An address or an answer that is not taken; trying again would not help."""


class Answer(NamedTuple):
    status: int
    headers: dict[str, str]  # names in lower case
    body: Iterator[bytes]


def public_ip(address: str) -> bool:
    try:
        ip = ipaddress.ip_address(address.partition("%")[0])
    except ValueError:
        return False
    special = (ip.is_loopback, ip.is_private, ip.is_link_local, ip.is_multicast, ip.is_reserved, ip.is_unspecified, getattr(ip, "is_site_local", False))
    return ip.is_global and not any(special)


def resolve(host: str, port: int) -> list[str]:
    """All addresses of a name."""
    return sorted({str(x[4][0]) for x in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)})


def checked(url: str | None, resolver: Callable[[str, int], list[str]] | None = resolve) -> str:
    """The stripped address if it is public, else Refused. Without a resolver names are not looked up."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError as e:
        raise Refused(f"malformed: {e}") from e
    if parts.scheme.lower() not in ("http", "https"):
        raise Refused(f"scheme: {parts.scheme or 'none'}")
    if parts.username or parts.password:
        raise Refused("user data in the address")
    if not host or host in ("localhost", "localhost.localdomain"):
        raise Refused(f"host: {host or 'none'}")
    literal = ":" in host or all(c in "0123456789." for c in host)
    if literal and not public_ip(host):
        raise Refused(f"not public: {host}")
    if not literal and resolver is not None:
        try:
            found = resolver(host, port or (443 if parts.scheme.lower() == "https" else 80))
        except OSError as e:
            raise Refused(f"no address of {host}") from e
        if not found or not all(map(public_ip, found)):
            raise Refused(f"not public: {host}")
    return url


class _Stay(HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def over_http(url: str, timeout: float, agent: str) -> Answer:
    """One request; redirects are not followed and proxies of the environment not used."""
    opener = build_opener(_Stay, ProxyHandler({}))
    try:
        got = opener.open(Request(url, headers={"User-Agent": agent}), timeout=timeout)  # noqa: S310
    except HTTPError as e:
        got = e
    headers: HTTPMessage = got.headers

    def body() -> Iterator[bytes]:
        with got:
            while part := got.read(CHUNK):
                yield part

    return Answer(got.status, {k.lower(): v for k, v in headers.items()}, body())


@dataclass(frozen=True)
class Fetcher:
    timeout: float = 15
    hops: int = HOPS
    most: int = MAX_BYTES
    attempts: int = ATTEMPTS
    agent: str = "wirelark/1.0"
    content_types: tuple[str, ...] = CONTENT_TYPES
    transport: Callable[[str, float, str], Answer] = field(default=over_http)
    resolver: Callable[[str, int], list[str]] | None = field(default=resolve)
    wait: Callable[[float], None] = field(default=time.sleep)

    def text(self, url: str | None) -> str:
        """The body of an address; Refused, OSError or HTTPException if there is none after all attempts."""
        for n in range(self.attempts):
            try:
                return self._once(url)
            except (OSError, HTTPException):
                if n + 1 == self.attempts:
                    raise
                self.wait(min(8.0, 2.0**n))
        raise Refused("no attempts")

    def _once(self, url: str | None) -> str:
        at = checked(url, self.resolver)
        for _ in range(self.hops + 1):
            got = self.transport(at, self.timeout, self.agent)
            if 300 <= got.status < 400 and got.headers.get("location"):
                at = checked(urljoin(at, got.headers["location"]), self.resolver)
                continue
            if got.status >= 500 or got.status == 429:
                raise OSError(f"status {got.status}")
            if got.status >= 300:
                raise Refused(f"status {got.status}")
            return self._body(got)
        raise Refused("too many redirects")

    def _body(self, got: Answer) -> str:
        kind = got.headers.get("content-type", "").lower()
        if kind and not any(c in kind for c in self.content_types):
            raise Refused(f"content type {kind}")
        said = got.headers.get("content-length", "")
        if said.isdigit() and int(said) > self.most:
            raise Refused(f"{said} bytes")
        made = bytearray()
        for part in got.body:
            made += part
            if len(made) > self.most:
                raise Refused(f"more than {self.most} bytes")
        charset = kind.partition("charset=")[2].partition(";")[0].strip(" \"'") or "utf-8"
        try:
            return made.decode(charset, "replace")
        except LookupError:
            return made.decode("utf-8", "replace")


def fetch_pages(rows: DataFrame, url_col: str = "url", fetcher: Fetcher | None = None) -> DataFrame:
    """url, html, error for every row of rows."""
    own = fetcher or Fetcher()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: dict[str | None, tuple[str | None, str | None]] = {}
            for u in pdf["url"]:
                if u not in got:
                    try:
                        got[u] = (own.text(u), None)
                    except (Refused, OSError, HTTPException) as e:
                        got[u] = (None, str(e) or type(e).__name__)
            yield pd.DataFrame([(u, *got[u]) for u in pdf["url"]], columns=["url", "html", "error"])

    return rows.select(rows[url_col].alias("url")).mapInPandas(run, "url string, html string, error string")
