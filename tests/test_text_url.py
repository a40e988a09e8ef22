import hashlib
import re
from datetime import datetime
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

from pyspark.sql import functions as F

from wirelark.functions import text, url

TRACKING = set(url.TRACKING)


def canon(u):
    p = urlparse(u.strip())
    q = urlencode(sorted((k, v) for k, v in parse_qsl(p.query) if k.lower() not in TRACKING))
    path = re.sub(r"/+", "/", p.path or "/")
    return urlunparse((p.scheme.lower() or "https", p.netloc.lower(), path.rstrip("/") or "/", "", q, ""))


URLS = [
    "https://Example.com//a//b/?utm_source=x&b=2&a=1#frag", "http://a.test", "HTTPS://A.test/", "https://a.test/p;x=1?q=%C3%A9+y&empty=&UTM_Medium=z",
    "https://a.test/p/;v?k=a%zz", "  https://a.test/x?b=~*&a=%2F ", "https://a.test:8080/x/?fbclid=1", "https://a.test/?a=1&a=0&b", "https://a.test/%7Eu?x=1%202",
]


def test_canonical_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS] + [(None,)], "u string").select("u", url.canonicalize(F.col("u")).alias("c"))
    for r in df.collect():
        assert r.c == (None if r.u is None else canon(r.u)), r.u


def test_canonical_urls_once_is_enough(spark):
    c = spark.createDataFrame([(u,) for u in URLS], "u string").select(url.canonicalize(F.col("u")).alias("c"))
    assert c.filter(url.canonicalize(F.col("c")) != F.col("c")).count() == 0


def test_safe_urls(spark):
    cases = {
        "https://example.test/a": True, "http://8.8.8.8/x": True, "https://[2001:4860:4860::8888]/": True, "ftp://a.test": False, "https://u:p@a.test": False,
        "http://localhost/": False, "http://localhost./": False, "http://127.0.0.1/": False, "http://10.0.0.1": False, "http://169.254.1.1": False,
        "http://[::1]/": False, "http://0.0.0.0/": False, "http://224.0.0.1/": False, "https:///path": False, "notaurl": False, "": False, None: False,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", url.is_safe(F.col("u")).alias("ok"))
    assert {r.u: r.ok for r in df.collect()} == cases


def test_hash_keys_ignore_case_and_space(spark):
    rows = [("A  b", "Some Text\n"), ("a b", "some text"), ("a b", None)]
    df = spark.createDataFrame(rows, "t string, x string")
    got = df.select(text.content_hash(F.col("x")).alias("h"), text.fingerprint(F.col("t"), F.col("x")).alias("f")).collect()
    assert got[0].h == got[1].h == hashlib.sha256(b"some text").hexdigest()
    assert got[0].f == got[1].f == hashlib.sha256(b"a b some text").hexdigest()
    assert got[2].h is None and got[2].f is None


def test_fingerprint_is_cut_before_it_is_normalised(spark):
    df = spark.createDataFrame([("t", " " * 2999 + "ab"), ("t", "a")], "t string, x string")
    a, b = [r[0] for r in df.select(text.fingerprint(F.col("t"), F.col("x"))).collect()]
    assert a == b


def test_title_terms(spark):
    df = spark.createDataFrame([("Agencies patched ACME flaws after phishing - Daily News", "Patching ACME flaw takes days")], "a string, b string")
    r = df.select(
        text.salient_terms(F.col("a")).alias("a"), text.shared_terms(text.salient_terms(F.col("a")), text.salient_terms(F.col("b"))).alias("s"),
        F.array_sort(text.entity_terms(F.col("a"))).alias("e"), text.without_source(F.col("a")).alias("w"),
    ).first()
    assert set(r.a) == {"agency", "patch", "acme", "vulnerability"}
    assert r.s == ["acme", "patch", "vulnerability"]
    assert r.e == ["acme"]
    assert r.w == "Agencies patched ACME flaws after phishing"


def test_lead_and_iso(spark):
    df = spark.createDataFrame(
        [("One. Two! Three? Four. Five.", datetime(2025, 1, 2, 3, 4, 5)), ("x", datetime(2025, 1, 2, 3, 4, 5, 60)), ("", None)], "x string, t timestamp"
    )
    got = df.select(text.lead(F.col("x")).alias("l"), text.iso_or_unknown(F.col("t")).alias("t")).collect()
    assert got[0].l == "One. Two! Three? Four."
    assert [g.t for g in got] == ["2025-01-02T03:04:05+00:00", "2025-01-02T03:04:05.000060+00:00", "unknown"]


def test_source_priority(spark):
    rows = [("x", "https://www.cisa.gov/a", 3), ("GDELT", "https://news.itpro.com/", 0), (" Google News", "https://a.test", 1), ("x", "https://notcisa.gov.test", 2), ("gdelt", "https://blog.google.com", 3)]
    df = spark.createDataFrame(rows, "n string, u string, p int").select(url.source_priority(F.col("n"), F.col("u")).alias("g"), "p")
    assert all(r.g == r.p for r in df.collect())
