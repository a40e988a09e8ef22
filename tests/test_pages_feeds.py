from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wirelark.operators import html
from wirelark.sources import feeds, fetch

STORY = "The council confirmed on Friday that its payroll was copied by intruders. " * 8


def one(spark, page, **kw):
    return html.extracted(spark.createDataFrame([(page,)], "html string"), **kw).first()


def test_furniture_is_dropped(spark):
    r = one(spark, f"<body><nav>Menu</nav><div class='no-ad x'>Kept</div><div class='social-share'>Gone</div><div id='ad'>Gone</div><p>{STORY}</p><footer>End</footer></body>")
    assert r.full_text.startswith("Kept The council") and "Gone" not in r.full_text and "End" not in r.full_text


def test_longest_article_wins_and_advertisement_goes(spark):
    r = one(spark, f"<body><div>Side</div><article>{STORY}</article><article>{STORY}Advertisement more</article></body>")
    assert r.full_text.endswith("more") and "Advertisement" not in r.full_text and "Side" not in r.full_text


def test_null_empty_and_large_pages(spark):
    df = html.extracted(spark.createDataFrame([(1, None), (2, ""), (3, "<body>" + "x" * 200), (4, "<nav>x</nav>")], "i int, html string"), max_bytes=100)
    assert all(r.full_text is None and r.abstract is None for r in df.collect())


def test_abstracts(spark):
    meta = "A description that is long enough to be taken when no sentence of the page is."
    df = spark.createDataFrame([("Short. " + "This sentence is long enough to be taken as it stands here. " * 4, None), ("Nope.", meta), ("Menu and comment stuff that is long enough to be a sentence here.", None)], "t string, m string")
    got = [r[0] for r in df.select(html.abstract(F.col("t"), F.col("m"), 130)).collect()]
    assert got[0] == ("This sentence is long enough to be taken as it stands here. " * 2).strip()
    assert got[1] == meta and got[2] == ""


def test_clip(spark):
    c = lambda t, n: spark.createDataFrame([(t,)], "t string").select(html.clip_at_sentence(F.col("t"), n)).first()[0]
    assert c("Aaa bbb. Ccc ddd.", 10) == "Aaa bbb."
    assert c("word " * 20, 52) == ("word " * 10).strip()
    assert c("short", 10) == "short"


def test_content_types(spark):
    df = spark.createDataFrame([("text/html; charset=x", True), (None, True), ("image/png", False)], "c string, w boolean").select(html.content_type_ok(F.col("c")).alias("g"), "w")
    assert all(r.g == r.w for r in df.collect())


RSS = """<rss><channel><title>Feed</title>
<item><title>No link</title></item>
<item><title>Good</title><link>https://a.test/1</link><pubDate>Thu, 01 May 2025 12:00:00 +0200</pubDate></item>
<item><title>Bad host</title><link>http://127.0.0.1/</link></item>
<item><title>Search</title><link>https://news.google.com/x</link></item>
<item><title>Late</title><link>https://a.test/2</link></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom</title><entry><title>E</title><link href="https://b.test/"/><updated>2025-05-01T00:00:00Z</updated></entry></feed>'


def test_feeds(spark):
    p = spark.createDataFrame([("https://f.test", RSS), ("https://g.test", ATOM), ("https://h.test", "<broken"), ("https://i.test", None)], "feed_url string, xml string")
    got = sorted((r.source_name, r.title, r.url, r.published_at) for r in feeds.scan_feeds(p, 4).collect())
    assert got == [("Atom", "E", "https://b.test/", datetime(2025, 5, 1)), ("Feed", "Good", "https://a.test/1", datetime(2025, 5, 1, 10))]
    decoded = feeds.scan_feeds(p, 4, "Name", True, lambda u: F.concat(F.lit("https://c.test/"), F.length(u))).collect()
    assert {r.source_name for r in decoded} == {"Name"} and any(r.url.startswith("https://c.test/") for r in decoded)


def test_api(spark):
    j = '{"articles":[{"title":"A","url":"https://a.test","seendate":"20250501T120000Z"},{"title":"B","url":"https://b.test","seendate":"soon"},{"title":"","url":"https://c.test"}]}'
    got = feeds.scan_api(spark.createDataFrame([(j,), ("oops",), (None,)], "json string")).collect()
    assert sorted((r.title, r.published_at) for r in got) == [("A", datetime(2025, 5, 1, 12)), ("B", None)]


def test_gather_leaves_failing_scans_out(spark):
    ok = spark.createDataFrame([("s", "rss", "t", "u", None)], feeds.LISTING)
    assert feeds.gather([lambda: ok, lambda: spark.read.parquet("/nowhere"), lambda: 1 / 0], spark).count() == 1
    assert feeds.gather([], spark).count() == 0


def test_newest_first(spark):
    rows = [("a", "rss", "1", "u1", None), ("a", "rss", "2", "u2", datetime(2025, 1, 1)), ("a", "rss", "3", "u3", datetime(2025, 2, 1))]
    got = feeds.newest_first(spark.createDataFrame(rows, feeds.LISTING)).orderBy("original_index").collect()
    assert [r.title for r in got] == ["3", "2", "1"]


def test_urls_of_scans():
    assert feeds.search_url("a b").startswith("https://news.google.com/rss/search?q=a+b+when%3A7d&hl=en-US&gl=US&ceid=US%3Aen")
    assert "query=x&mode=ArtList&maxrecords=5&format=json&sort=DateDesc&timespan=60min" in feeds.api_url("x", 5, 60)


def answers(table):
    """A transport that answers from a table, and the addresses that it was asked for."""
    asked = []

    def transport(url, timeout, agent):
        asked.append(url)
        got = table[url]
        if isinstance(got, list):
            got = got.pop(0)
        if isinstance(got, Exception):
            raise got
        status, headers, body = got
        return fetch.Answer(status, headers, iter([body]))

    return transport, asked


def fetcher(table, **more):
    transport, asked = answers(table)
    return fetch.Fetcher(transport=transport, resolver=lambda h, p: ["93.184.216.34"], wait=lambda s: None, **more), asked


def test_live_feed_source(spark):
    own, _ = fetcher({"https://f.test/x": (200, {"content-type": "application/rss+xml"}, RSS.encode()), "https://g.test/x": (404, {}, b"")}, content_types=feeds.FEED_TYPES)

    class Own(feeds.FeedSource):
        fetcher = own

    spark.dataSource.register(Own)
    df = spark.read.format("newsfeed").option("urls", "https://f.test/x https://g.test/x file:///etc/hostname http://127.0.0.1/").load()
    assert [r.feed_url for r in df.collect()] == ["https://f.test/x"]
    assert feeds.scan_feeds(df, 10, decode=False).count() == 3


@pytest.mark.parametrize("url", [
    None, "", "file:///etc/hostname", "ftp://a.test/", "https://u:p@a.test/", "https://localhost/", "https://localhost./", "http://127.0.0.1/", "http://10.0.0.8/x", "http://169.254.1.1/",
    "http://224.0.0.9/", "http://240.0.0.9/", "http://[::1]/", "http://a.test:99999/", "//a.test/", "http:///x",
])
def test_unsafe_addresses_are_refused(url):
    with pytest.raises(fetch.Refused):
        fetch.checked(url, lambda h, p: ["93.184.216.34"])


def test_names_are_resolved_where_a_resolver_is_given():
    assert fetch.checked(" https://a.test/x ", lambda h, p: ["93.184.216.34"]) == "https://a.test/x" == fetch.checked("https://a.test/x", None)
    for found in ([], ["10.0.0.1"], ["93.184.216.34", "127.0.0.1"], ["fe80::1%eth0"]):
        with pytest.raises(fetch.Refused):
            fetch.checked("https://a.test/x", lambda h, p, found=found: found)


def test_redirects_are_checked_at_every_hop():
    own, asked = fetcher({"https://a.test/": (302, {"location": "/b"}, b""), "https://a.test/b": (301, {"location": "http://10.0.0.7/"}, b"")})
    with pytest.raises(fetch.Refused):
        own.text("https://a.test/")
    assert asked == ["https://a.test/", "https://a.test/b"]
    own, asked = fetcher({"https://a.test/": (302, {"location": "/"}, b"")})
    with pytest.raises(fetch.Refused):
        own.text("https://a.test/")
    assert len(asked) == 6


def test_bodies_are_limited_and_decoded():
    html = {"content-type": "text/html; charset=latin-1"}
    own, _ = fetcher({"https://a.test/": (200, html, "é".encode("latin-1")), "https://b.test/": (200, {"content-length": "99"}, b"x"), "https://c.test/": (200, {}, b"x" * 11), "https://d.test/": (200, {"content-type": "image/png"}, b"x"), "https://e.test/": (200, {}, b"\xff ok")}, most=10)
    assert own.text("https://a.test/") == "é" and own.text("https://e.test/") == "\ufffd ok"
    for u in "bcd":
        with pytest.raises(fetch.Refused):
            own.text(f"https://{u}.test/")


def test_attempts():
    own, asked = fetcher({"https://a.test/": [OSError("reset"), (503, {}, b""), (200, {}, b"ok")], "https://b.test/": [(404, {}, b"")], "https://c.test/": [OSError("x")] * 3})
    assert own.text("https://a.test/") == "ok" and len(asked) == 3
    with pytest.raises(fetch.Refused):
        own.text("https://b.test/")
    with pytest.raises(OSError):
        own.text("https://c.test/")


def test_pages_are_fetched_as_a_step(spark):
    own, _ = fetcher({"https://a.test/": (200, {}, b"<p>x</p>"), "https://b.test/": (404, {}, b"")})
    df = spark.createDataFrame([("https://a.test/",), ("https://a.test/",), ("https://b.test/",), (None,), ("file:///etc/hostname",)], "url string").withColumn("html", F.lit("clash"))
    got = fetch.fetch_pages(df, fetcher=own).collect()
    assert len(got) == 5 and {(r.url, r.html) for r in got if r.error is None} == {("https://a.test/", "<p>x</p>")}
    assert fetch.fetch_pages(df.limit(0), fetcher=own).count() == 0


def test_a_scan_that_fails_while_it_runs_is_left_out(spark):
    ok = spark.createDataFrame([("s", "rss", "t", "u", None)], feeds.LISTING)
    bad = ok.withColumn("title", F.raise_error(F.lit("broken feed")).cast("string"))
    assert feeds.gather([lambda: bad, lambda: ok], spark).count() == 1
