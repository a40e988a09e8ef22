from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wirelark import queries
from wirelark.operators import dedupe, route, store
from wirelark.operators.ranges import within_hours
from wirelark.params import ConfigError, Params, load_params

T = datetime(2025, 5, 1, 12)
ENV = {"SMTP_HOST": "h", "SMTP_USERNAME": "u", "SMTP_PASSWORD": "p", "SENDER_EMAIL": "s@a.test", "RECIPIENT_EMAIL": "r@a.test", "DATABASE_URL": "d"}


def test_params_from_environment():
    p = load_params(ENV | {"RSS_FEEDS": '["https://a.test", " "]', "GOOGLE_NEWS_QUERIES": "a, b,", "DIGEST_ENABLED": "no", "MAX_ARTICLE_AGE_HOURS": "24", "NEAR_DUPLICATE_LOOKBACK_HOURS": ""})
    assert p.rss_feeds == ("https://a.test",) and p.google_news_queries == ("a", "b") and not p.digest_enabled
    assert p.digest_topic_dedupe_lookback_hours == 24 and p.near_window_hours == 48 and p.digest_recipient == "r@a.test"
    with pytest.raises(ConfigError):
        load_params({k: v for k, v in ENV.items() if k != "SMTP_HOST"})
    with pytest.raises(ConfigError):
        load_params(ENV | {"RSS_FEEDS": "[1]"})
    with pytest.raises(ConfigError):
        load_params(ENV | {"SMTP_PORT": "x"})


def test_digest_cap_counts_queued_rows_only(spark):
    rows = [(i, "out_of_scope" if i % 2 else "opinion") for i in range(8)]
    df = spark.createDataFrame(rows, "original_index bigint, routing_reason string")
    got = {r.original_index: (r.status, r.digest_reason) for r in route.with_digest_status(df, Params(digest_max_items_per_run=2)).collect()}
    assert [got[i][0] for i in (0, 2, 4)] == ["queued", "queued", "skipped"]
    assert got[4][1] == "digest_overflow_or_disabled" and got[1] == ("skipped", "out_of_scope")
    off = route.with_digest_status(df, Params(digest_enabled=False, suppress_out_of_scope_digest=False)).collect()
    assert {r.status for r in off} == {"skipped"}


def test_digest_text(spark):
    e = route.digest_entry(F.col("t"), F.lit("S"), F.lit(None).cast("string"), F.lit("V"), F.lit("unknown"), F.lit("L"))
    q = spark.createDataFrame([(2, "b", "two"), (1, "b", "one"), (3, "a", "x")], "original_index bigint, routing_reason string, t string").withColumn("entry", e)
    d = route.digest(q).first()
    assert d.subject == "Cyber News Digest: 3 queued items"
    item = "- {}\n  Source: S\n  Attack type: unknown\n  Victim: V\n  Published date: unknown\n  Link: L"
    want = "Queued items by reason:\n\n\nReason: a (1)\n\n{}\n\n\nReason: b (2)\n\n{}\n\n{}\n".format(*(item.format(t) for t in ("x", "one", "two")))
    assert d.body == want
    assert route.digest(q.limit(0)).first().body == "No digest items."


def test_subject_is_cut_at_a_blank(spark):
    long = "word " * 40
    r = spark.createDataFrame([(long, "company", "a"), (" X  y ", "hospital", "b")], "v string, k string, a string").select(route.subject(F.col("v"), F.col("k"), F.col("a")).alias("s")).collect()
    assert r[0].s == ("word " * 24).strip() + " was attacked using a" and r[1].s == "[X y] was attacked using b"


def test_windows(spark):
    df = spark.createDataFrame([(T, T - timedelta(hours=48), None, True), (T, T - timedelta(hours=48, seconds=1), None, False), (None, T, None, True), (T, None, T, True), (T, None, T - timedelta(days=9), False)], "c timestamp, p timestamp, k timestamp, w boolean")
    got = df.select(dedupe.within(F.col("c"), F.col("p"), F.col("k"), 48).alias("g"), "w", dedupe.within(F.col("c"), F.col("p"), F.col("k"), 0).alias("off")).collect()
    assert all(r.g == r.w and r.off for r in got)
    pair = df.select(dedupe.pair_within(F.col("c"), F.col("p"), 0).alias("g")).collect()
    assert [r.g for r in pair] == [False, False, True, True, True]


def test_within_hours_equals_a_nested_loop(spark):
    a = [(i, T + timedelta(minutes=37 * i)) for i in range(30)] + [(99, None)]
    b = [(i, T + timedelta(minutes=53 * i)) for i in range(30)]
    got = within_hours(spark.createDataFrame(a, "x bigint, at timestamp"), spark.createDataFrame(b, "y bigint, ref timestamp"), "at", "ref", 2)
    want = {(x, y) for x, s in a for y, t in b if s and abs(s - t) <= timedelta(hours=2)}
    assert {(r.x, r.y) for r in got.collect()} == want


def test_incident_duplicates(spark):
    stored = spark.createDataFrame([(1, "k", T, T), (2, "n", None, T), (3, None, T, T)], "id bigint, incident_key string, published_at timestamp, created_at timestamp")
    rows = spark.createDataFrame(
        [(0, "k", T + timedelta(hours=48), None), (1, "k", T + timedelta(hours=49), None), (2, "k", None, None), (3, "k", T, 1), (4, "n", T, None), (5, None, T, None)],
        "original_index bigint, incident_key string, published_at timestamp, replaced_id bigint",
    )
    assert {r.original_index for r in dedupe.incident_duplicates(rows.withColumnRenamed("published_at", "published_at"), stored.withColumnRenamed("published_at", "pub").withColumn("published_at", F.col("pub")).drop("pub"), 48).collect()} == {0, 2, 4}


def test_insert_conflicts_leave_the_replaced_row_out(spark):
    a = spark.createDataFrame([(1, "u1", "h1"), (2, "u2", "h2")], "id bigint, canonical_url string, content_hash string")
    f = spark.createDataFrame([(1, "f1"), (2, "f2")], "article_id bigint, fingerprint string")
    rows = spark.createDataFrame([(0, "u1", "x", "x", None), (1, "u1", "h1", "f1", 1), (2, "z", "h2", "f1", 1), (3, "z", "z", "f2", 1), (4, "z", "z", "z", None)], "i bigint, canonical_url string, content_hash string, fingerprint string, replaced_id bigint")
    got = {r.i: r.conflict_type for r in dedupe.insert_conflicts(rows, a, f).collect()}
    assert got == {0: "canonical_url", 1: None, 2: "content_hash", 3: "fingerprint", 4: None}


def test_store_changes(spark):
    a = spark.createDataFrame([(1, T, "old", "s" * 3), (2, T, "keep", None)], "id bigint, created_at timestamp, title string, source_name string")
    rows = spark.createDataFrame([(9, T, "new", "s" * 2000, None), (7, T, "over", None, 1)], "id bigint, created_at timestamp, title string, source_name string, replaced_id bigint")
    got = {r.id: (r.title, r.source_name and len(r.source_name)) for r in store.insert_or_replace(a, rows).collect()}
    assert got == {1: ("over", None), 2: ("keep", None), 9: ("new", 1024)}
    f = spark.createDataFrame([(5, 1, "a", T)], "id bigint, article_id bigint, fingerprint string, created_at timestamp")
    new = spark.createDataFrame([(1, 1, "b", T), (2, 2, "c", T)], "id bigint, article_id bigint, fingerprint string, created_at timestamp")
    assert sorted((r.id, r.article_id, r.fingerprint) for r in store.upsert_fingerprints(f, new).collect()) == [(2, 2, "c"), (5, 1, "b")]
    assert store.days_of("30") == 30
    for bad in ("0", "01", "-1", "1.5", "x", ""):
        with pytest.raises(ValueError):
            store.days_of(bad)


def test_tables_are_created_once(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS wl_test LOCATION '{tmp_path}'")
    assert len(store.initialize(spark, "wl_test")) == 3 and store.initialize(spark, "wl_test") == []
    spark.sql("DROP DATABASE wl_test CASCADE")


def test_insert_or_replace_keeps_every_row(spark, tmp_path):
    a = [(i, T, f"old {i}", "s") for i in range(1, 61)]
    spark.createDataFrame(a, "id bigint, created_at timestamp, title string, source_name string").coalesce(1).write.parquet(f"{tmp_path}/articles.parquet")
    c = [(i, 1 if i < 120 else 2, "s", f"new {i}") for i in range(130)]
    spark.createDataFrame(c, "original_index bigint, batch_no bigint, source_name string, title string").coalesce(1).write.parquet(f"{tmp_path}/candidates.parquet")
    got = {r.id: r.title for r in queries.insert_or_replace(spark, str(tmp_path)).collect()}
    over = {i + 1: f"new {i}" for i in range(50)}
    assert got == {i: f"old {i}" for i in range(51, 61)} | over | {10000000 + i: f"new {i}" for i in range(50, 130)}
