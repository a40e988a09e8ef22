import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wirelark.operators import store
from wirelark.params import Params
from wirelark.plans.fold import fold_incidents
from wirelark.plans.pipeline import Store, run
from wirelark.sources.feeds import LISTING
from wirelark.streaming import runs

NOW = datetime(2025, 5, 2, 12)
P = Params(recipient_email="desk@a.test", digest_recipient_email="digest@a.test")
BODY = "The {} office confirmed that staff lost access to the {} portal after a false letter. Letters were sent to {} clerks. {} auditors were called."


def body(seed):
    r = random.Random(seed)
    w = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    return " ".join(BODY.format(w(), w(), w(), w()) + " " + " ".join(w() for _ in range(30)) for _ in range(2))


@pytest.fixture
def empty(spark):
    return Store(*[spark.createDataFrame([], t) for t in store.TABLES.values()])


def listing(spark, *rows):
    """rows: title, url, hours before now, source."""
    made = [(i, s, "rss", t, u, None if h is None else NOW - timedelta(hours=h)) for i, (t, u, h, s) in enumerate(rows)]
    return spark.createDataFrame(made, "original_index bigint, " + LISTING)


def pages(spark, **texts):
    return spark.createDataFrame([(f"https://{k}.test/", t, "An abstract.") for k, t in texts.items()] or [("x", None, None)], "url string, full_text string, abstract string")


def verdict(kind="incident", attack="phishing"):
    return lambda df: df.withColumns({"article_type": F.lit(kind), "attack_type": F.lit(attack).cast("string")})


def named(confidence=0.9, name=None):
    who = F.coalesce(F.lit(name).cast("string"), F.concat(F.lit("Org "), F.col("original_index").cast("string")))
    return lambda df: df.withColumn("victim", F.struct(who.alias("victim_name"), F.lit("company").alias("victim_category"), F.lit(confidence).alias("confidence"), F.lit("x").alias("reason")))


def go(spark, rows, texts, held, params=P, classify=None, extract=None, send=lambda *a: None):
    r = run(listing(spark, *rows), pages(spark, **texts), held, NOW, params, classify or verdict(), extract or named(), send)
    return r, r.metrics.first().asDict(), {x.original_index: x for x in r.outcomes.collect()}


def test_one_url_twice(spark, empty):
    r, m, o = go(spark, [("A", "https://a.test/", 1, "S"), ("A", "https://a.test/?utm_source=x", 2, "S")], {"a": body(1)}, empty)
    assert m["processed"] == 2 and m["alerts_sent"] == 1 and m["skipped"] == 1
    a = r.store.alerts.first()
    assert (a.channel, a.status, a.recipient_email, a.routing_reason) == ("immediate", "sent", "desk@a.test", None)


def test_copies_keep_the_newest_and_the_better_source(spark, empty):
    texts = {"a": body(1), "b": body(1), "cisa.gov": body(2), "news.itpro": body(2)}
    rows = [("A", "https://a.test/", 5, "S"), ("A", "https://b.test/", 1, "S")]
    _, m, o = go(spark, rows, texts, empty)
    assert o[0].stage == "current_run" and o[0].reason == "content_hash,fingerprint,near_similarity" and o[1].outcome == "accepted"
    assert m["skipped"] == 1


def test_run_again_skips_all(spark, empty):
    rows = [("A", "https://a.test/", 1, "S"), ("B", "https://b.test/", 1, "S")]
    texts = {"a": body(1), "b": body(2)}
    r, m, _ = go(spark, rows, texts, empty)
    assert m["alerts_sent"] == 2
    _, m2, o2 = go(spark, rows, texts, r.store)
    assert m2["skipped"] == 2 and {x.stage for x in o2.values()} == {"stored_url"}


def test_stored_near_duplicate_is_dropped_or_replaces(spark, empty):
    long = body(3)
    r, _, _ = go(spark, [("Ferry ledger stolen by gang", "https://a.test/", 3, "Google News")], {"a": long}, empty)
    again = [("Ferry ledger stolen by gang today", "https://b.test/", 1, "Google News")]
    _, m, o = go(spark, again, {"b": long + " More."}, r.store)
    assert o[0].stage == "stored_near" and m["skipped"] == 1
    better = [("Ferry ledger stolen by gang today", "https://b.test/", 1, "S")]
    r2, _, o2 = go(spark, better, {"b": long + " More."}, r.store)
    assert o2[0].outcome == "accepted" and o2[0].matched_id == 1
    art = r2.store.articles.collect()
    assert len(art) == 1 and art[0].id == 1 and art[0].url == "https://b.test/" and r2.store.alerts.count() == 2 and r2.store.fingerprints.count() == 1


def test_repeat_incident(spark, empty):
    rows = [("A", "https://a.test/", 1, "S"), ("B", "https://b.test/", 2, "S")]
    r, m, o = go(spark, rows, {"a": body(1), "b": body(2)}, empty, extract=named(name="Acme Inc"))
    assert m["alerts_sent"] == 1 and o[1].reason == "duplicate_incident" and r.store.articles.count() == 1


def test_topic_duplicate_in_the_digest(spark, empty):
    text = body(4)
    rows = [("Ferry ledger stolen northgate", "https://a.test/", 1, "S"), ("Northgate ferry ledger copied", "https://b.test/", 2, "S")]
    other = text.replace("a", "a")[: len(text) * 2 // 3] + " " + body(5)[:150]
    p = Params(current_run_near_duplicate_threshold=0.99)
    _, m, o = go(spark, rows, {"a": text, "b": other}, empty, p, verdict("opinion", None))
    assert o[1].reason == "topic_similarity" and m["digest_queued"] == 1 and m["digest_sent"] == 1


def test_low_confidence_goes_to_the_digest(spark, empty):
    r, m, _ = go(spark, [("A", "https://a.test/", 1, "S")], {"a": body(1)}, empty, extract=named(0.2))
    a = r.store.alerts.first()
    assert (a.channel, a.routing_reason, a.status, a.recipient_email) == ("digest", "low_victim_confidence", "sent", "digest@a.test")
    assert a.subject == "Cyber News Digest: 1 queued items" and m["digest_sent"] == 1


def test_out_of_scope_is_held_back(spark, empty):
    r, m, _ = go(spark, [("A", "https://a.test/", 1, "S")], {"a": body(1)}, empty, classify=verdict("out_of_scope", None))
    a = r.store.alerts.first()
    assert (a.status, a.routing_reason, m["skipped"], m["digest_sent"]) == ("skipped", "out_of_scope", 1, 0)


def test_failing_sender(spark, empty):
    r, m, _ = go(spark, [("A", "https://a.test/", 1, "S")], {"a": body(1)}, empty, send=lambda *a: "no route")
    a = r.store.alerts.first()
    assert (a.status, a.error_message, m["alerts_sent"], m["errors"]) == ("failed", "no route", 0, 0)


def test_no_page_old_rows_and_empty_run(spark, empty):
    rows = [("A", "https://a.test/", 1, "S"), ("B", "https://b.test/", 400, "S"), ("C", "https://c.test/", None, "S")]
    _, m, o = go(spark, rows, {"c": body(1)}, empty)
    assert o[0].reason == "no_content" and 1 not in o and o[2].outcome == "accepted"
    _, m, o = go(spark, [], {}, empty)
    assert m["processed"] == 0 and o == {}


def test_incident_fold_equals_the_plain_rule(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["k", "l", None]), None if r.random() < 0.1 else NOW + timedelta(hours=r.randint(0, 300))) for i in range(60)]
    want, held = {}, {}
    for i, k, t in rows:
        ok = k is None or not any(t is None or h is None or abs(t - h) <= timedelta(hours=48) for h in held.get(k, []))
        want[i] = ok
        if ok and k:
            held.setdefault(k, []).append(t)
    got = fold_incidents(spark.createDataFrame(rows, "i bigint, k string, t timestamp"), "k", "t", "i", 48).collect()
    assert {x.i: x.accepted for x in got} == want


def test_streams(spark, tmp_path):
    rows = [(0, "k", NOW), (1, "k", NOW + timedelta(hours=1)), (2, "l", NOW), (3, "k", NOW + timedelta(hours=60))]
    schema = "o bigint, k string, t timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    seen = []
    q = runs.scheduled(src, lambda df, n: seen.append((n, df.count())), str(tmp_path / "c0"))
    q.awaitTermination(90)
    assert seen == [(0, 4)]
    for name, df in (("first", runs.first_of_key(src, "k")), ("inc", runs.incidents(src, "k", "t", "o", 48)), ("within", runs.first_of_key_within(src, "k", "t", 5)), ("fresh", runs.fresh(src, "t", 1))):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination(90)
    got = lambda n: sorted(r.o for r in spark.read.schema(schema).parquet(str(tmp_path / n)).collect())
    assert len(got("first")) == 2 and got("inc") == [0, 2, 3] and len(got("within")) == 2 and got("fresh") == []
