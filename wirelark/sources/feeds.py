"""Scans of listings: feed XML, a news API's JSON, and live feeds as a Spark data source.

Payloads are landed files or rows; each parser is a DataFrame step, so that a scan of a million landed feeds is one job.
A payload that cannot be read gives no rows and harms no other.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from functools import reduce
from http.client import HTTPException
from urllib.parse import quote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wirelark.functions.url import is_safe
from wirelark.session import stage
from wirelark.sources.fetch import Fetcher, Refused

LISTING = "source_name string, source_type string, title string, url string, published_at timestamp"
SEARCH = "https://news.google.com/rss/search?"
API = "https://api.gdeltproject.org/api/v2/doc/doc?"
AGGREGATOR_HOST = "news.google.com"


def search_url(query: str, language: str = "en-US", region: str = "US", recency: str = "7d") -> str:
    q = quote_plus(f"{query} when:{recency}".strip())
    return f"{SEARCH}q={q}&hl={quote_plus(language)}&gl={quote_plus(region)}&ceid={quote_plus(region + ':en')}"


def api_url(query: str, max_articles: int, timespan_minutes: int) -> str:
    return f"{API}query={quote_plus(query)}&mode=ArtList&maxrecords={max_articles}&format=json&sort=DateDesc&timespan={timespan_minutes}min"


def _when(text: str | None) -> datetime | None:
    if not text:
        return None
    for parse in (parsedate_to_datetime, lambda t: datetime.fromisoformat(t.replace("Z", "+00:00"))):
        try:
            at = parse(text.strip())
            return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
        except (ValueError, TypeError, IndexError):
            continue
    return None


def feed_entries(xml: bytes | str, fallback: str, most: int) -> list[tuple[str, int, str | None, str | None, datetime | None]]:
    """Feed title, place, title, link and time of the first entries of an RSS or Atom feed."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rpartition("}")[2]
    kid = lambda e, *n: next((k for x in n for k in e if local(k) == x), None)
    head = kid(root, "channel") if local(root) != "feed" else root
    head = root if head is None else head
    named = kid(head, "title")
    name = (named.text or "").strip() if named is not None else ""
    out = []
    for i, e in enumerate([x for x in root.iter() if local(x) in ("item", "entry")][:most]):
        title, link = kid(e, "title"), kid(e, "link")
        href = None if link is None else (link.text or "").strip() or link.get("href")
        at = kid(e, "pubDate", "published", "date", "updated")
        out.append((name or fallback, i, (title.text or "").strip() if title is not None else None, href, _when(at.text if at is not None else None)))
    return out


def decoded_link(url: Column, decode: bool = True, decoder: Callable[[Column], Column] | None = None) -> Column:
    """Links of the aggregator go through the decoder; without one they become null and the row is dropped."""
    if not decode:
        return url
    other = decoder(url) if decoder else F.lit(None).cast("string")
    return F.when(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1) != AGGREGATOR_HOST, url).otherwise(other)


def _checked(rows: DataFrame) -> DataFrame:
    """Rows with a title and a safe link."""
    return rows.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")).filter(is_safe(F.col("url"))).withColumn(
        "url", F.trim("url")
    )


def scan_feeds(payloads: DataFrame, most: int, name: str | None = None, decode: bool = True, decoder: Callable | None = None) -> DataFrame:
    """Listings of feed payloads (columns feed_url, xml). The first entries are taken before any is checked."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (u, *e) for u, x in zip(pdf["feed_url"], pdf["xml"]) if x is not None for e in feed_entries(x, u, most)
            ]
            yield pd.DataFrame(rows, columns=["feed_url", "source_name", "pos", "title", "url", "published_at"]).astype({"pos": "int32"})

    made = payloads.select("feed_url", "xml").mapInPandas(
        parse, "feed_url string, source_name string, pos int, title string, url string, published_at timestamp"
    )
    made = made.withColumn("url", decoded_link(F.col("url"), decode, decoder)).withColumn("source_type", F.lit("rss"))
    if name:
        made = made.withColumn("source_name", F.lit(name))
    return _checked(made).select("source_name", "source_type", "title", "url", "published_at")


def scan_api(payloads: DataFrame) -> DataFrame:
    """Listings of API payloads (column json). A date that cannot be read is null, one without a zone is UTC."""
    schema = "articles array<struct<title:string,url:string,seendate:string>>"
    rows = payloads.select(F.explode(F.from_json("json", schema)["articles"]).alias("a")).select("a.*")
    at = F.coalesce(F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp("seendate"))
    made = rows.select(F.lit("GDELT").alias("source_name"), F.lit("gdelt").alias("source_type"), "title", "url", at.alias("published_at"))
    return _checked(made)


def gather(readers: Sequence[Callable[[], DataFrame]], spark: SparkSession) -> DataFrame:
    """The union of all scans; a scan that fails is left out.

    Each scan is run and written by itself, so that one that fails while it runs harms no other.
    """
    made = []
    for read in readers:
        try:
            made.append(stage(read(), "scan"))
        except Exception:  # noqa: BLE001
            continue
    if not made:
        return spark.createDataFrame([], LISTING)
    return reduce(lambda a, b: a.unionByName(b), made)


def newest_first(listings: DataFrame) -> DataFrame:
    """listings with original_index: newest first, no time last, ties by source, title and URL."""
    from pyspark.sql import Window

    at = F.coalesce("published_at", F.lit("1970-01-01 00:00:00").cast("timestamp"))
    w = Window.orderBy(at.desc(), "source_name", "title", "url")  # one run's listings, bounded by sources x limit
    return listings.withColumn("original_index", (F.row_number().over(w) - 1).cast("bigint"))


class FeedPartition(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


#: Feeds may also come as JSON or under a type of their own.
FEED_TYPES = ("xml", "rss", "atom", "json", "text/")


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetcher: Fetcher) -> None:
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.fetcher = fetcher

    def partitions(self):
        return [FeedPartition(u) for u in self.urls] or [FeedPartition("")]

    def read(self, partition):
        if not partition.url:
            return
        try:
            yield (partition.url, self.fetcher.text(partition.url))
        except (Refused, OSError, HTTPException):
            return


class FeedSource(DataSource):
    """spark.read.format("newsfeed").option("urls", ...): one task a feed; a feed that fails gives no row.

    Addresses are checked as those of pages are, with each redirect; bodies have a limit (see sources.fetch). A subclass can
    bring a fetcher of its own.
    """

    fetcher: Fetcher | None = None

    @classmethod
    def name(cls) -> str:
        return "newsfeed"

    def schema(self) -> str:
        return "feed_url string, xml string"

    def reader(self, schema) -> FeedReader:
        options = dict(self.options)
        own = self.fetcher or Fetcher(timeout=float(options.get("timeout", "15")), content_types=FEED_TYPES)
        return FeedReader(options, own)
