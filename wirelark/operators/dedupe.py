"""Duplicates within a run and against stored articles, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.functions import text, url
from wirelark.operators.graph import connected_components
from wirelark.operators.tfidf import near_pairs, top_match
from wirelark.session import stage


def candidate_columns(df: DataFrame) -> DataFrame:
    """df with canonical_url, content_hash, fingerprint, similarity_document, topic_document, source_priority."""
    t, x, a = F.col("title"), F.col("full_text"), F.coalesce(F.col("abstract"), F.lit(""))
    return df.withColumns({
        "canonical_url": url.canonicalize(F.col("url")),
        "content_hash": text.content_hash(x),
        "fingerprint": text.fingerprint(t, x),
        "similarity_document": text.similarity_document(t, a, x),
        "topic_document": text.topic_document(t, a, x),
        "source_priority": url.source_priority(F.col("source_name"), F.col("url")),
    })


def fresh(df: DataFrame, as_of: Column, max_age_hours: int) -> DataFrame:
    """Rows of the last hours and rows without a time; 0 or less keeps all."""
    if max_age_hours <= 0:
        return df
    return df.filter(F.col("published_at").isNull() | (F.col("published_at") >= as_of - F.make_interval(hours=F.lit(max_age_hours))))


def not_stored(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose canonical URL is not stored; to be called before pages are fetched."""
    return df.join(stored.select("canonical_url").distinct(), "canonical_url", "left_anti")


def stored_exact(df: DataFrame, articles: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """df with matched_id and reason where content hash (first) or fingerprint is stored; the smallest id of a key counts."""
    h = articles.groupBy("content_hash").agg(F.min("id").alias("_h"))
    f = fingerprints.groupBy("fingerprint").agg(F.min("article_id").alias("_f"))
    made = df.join(h, "content_hash", "left").join(f, "fingerprint", "left")
    reason = F.when(F.col("_h").isNotNull(), "content_hash").when(F.col("_f").isNotNull(), "fingerprint")
    return made.withColumns({"matched_id": F.coalesce("_h", "_f"), "reason": reason}).drop("_h", "_f")


def within(candidate: Column, published: Column, created: Column, hours: int | None) -> Column:
    """A stored row is in the window of a candidate: a missing time, or no window, lets it in."""
    if hours is None or hours <= 0:
        return F.lit(True)
    ref = F.coalesce(published, created)
    apart = F.abs(F.unix_micros(candidate) - F.unix_micros(ref))
    return F.coalesce(apart <= F.lit(hours * 3_600_000_000), F.lit(True))


def pair_within(a: Column, b: Column, hours: int) -> Column:
    """Two rows of a run are in one window; a missing time lets them in, a window of 0 hours does not."""
    return F.coalesce(F.abs(F.unix_micros(a) - F.unix_micros(b)) <= F.lit(hours * 3_600_000_000), F.lit(True))


def guard(score: Column, left: Column, right: Column, least: float = 0.40) -> Column:
    """A low score needs shared title terms or names."""
    terms = F.size(text.shared_terms(text.salient_terms(left), text.salient_terms(right))) > 0
    names = F.size(text.shared_entities(text.entity_terms(left), text.entity_terms(right))) > 0
    return (score >= F.lit(least)) | terms | names


def exact_edges(df: DataFrame) -> DataFrame:
    """src, dst, reason: each row and the first one of its canonical URL, content hash or fingerprint."""
    made = None
    for key in ("canonical_url", "content_hash", "fingerprint"):
        first = df.groupBy(key).agg(F.min("original_index").alias("src"), F.count("*").alias("_n")).filter("_n > 1")
        e = df.select(key, F.col("original_index").alias("dst")).join(first, key).filter("src < dst").select("src", "dst", F.lit(key).alias("reason"))
        made = e if made is None else made.unionByName(e)
    return made


def near_edges(df: DataFrame, threshold: float, window_hours: int, least: float = 0.40) -> DataFrame:
    """src, dst, score of the pairs of a run that are similar, close in time and past the guard."""
    pairs = near_pairs(df, threshold, "original_index", "similarity_document")
    side = lambda i, s: df.select(F.col("original_index").alias(i), F.col("title").alias(f"title_{s}"), F.col("published_at").alias(f"at_{s}"))
    rows = pairs.join(side("i", "a"), "i").join(side("j", "b"), "j")
    rows = rows.filter(pair_within(F.col("at_a"), F.col("at_b"), window_hours) & guard(F.col("score"), F.col("title_a"), F.col("title_b"), least))
    return rows.select(F.col("i").alias("src"), F.col("j").alias("dst"), "score")


def current_run(df: DataFrame, threshold: float, window_hours: int, near: bool = True, least: float = 0.40) -> DataFrame:
    """original_index, component, survivor, reasons, max_score of every row of a run.

    The survivor of a component is its row of the highest source priority, then the newest, then the first.
    """
    e = exact_edges(df).withColumn("score", F.lit(None).cast("double"))
    if near:
        n = near_edges(df, threshold, window_hours, least).withColumn("reason", F.lit("near_similarity"))
        e = e.unionByName(n.select("src", "dst", "reason", "score"))
    e = stage(e, "run-edges")
    comp = connected_components(e)
    tags = e.join(comp.select(F.col("node").alias("src"), "component"), "src").groupBy("component").agg(
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.max("score").alias("max_score")
    )
    rows = df.join(comp, F.col("original_index") == F.col("node"), "left").withColumn("component", F.coalesce("component", "original_index"))
    key = F.struct("source_priority", "published_at", (-F.col("original_index")).alias("o"))
    top = rows.groupBy("component").agg(F.max(key).alias("k")).select("component", (-F.col("k.o")).alias("survivor"))
    return rows.select("original_index", "component").join(top, "component").join(tags, "component", "left")


def recents(articles: DataFrame, limit: int) -> DataFrame:
    """The newest stored articles with pos from 0; none if limit is 0 or less. A top-k, not a sort."""
    from pyspark.sql import Window

    cut = articles.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(max(0, limit))
    w = Window.orderBy(F.col("created_at").desc(), F.col("id").desc())  # over limit rows at most
    return cut.withColumn("pos", F.row_number().over(w) - 1)


def stored_near(df: DataFrame, recent: DataFrame, threshold: float, hours: int | None, least: float = 0.40) -> DataFrame:
    """original_index, match_id, score, decision (keep, drop, replace) of the candidates with a stored near-duplicate.

    recent: id, pos, title, abstract, article_text, source_name, url, published_at, created_at; bounded by recents().
    """
    r = recent.select(
        "id", "pos", text.similarity_document(F.col("title"), F.coalesce("abstract", F.lit("")), F.col("article_text")).alias("doc"),
        F.col("title").alias("r_title"), F.col("published_at").alias("r_pub"), F.col("created_at").alias("r_at"),
        url.source_priority(F.col("source_name"), F.col("url")).alias("r_prio"),
    )
    c = df.select(F.col("original_index").alias("id"), F.col("similarity_document").alias("doc"), "title", "published_at", "source_priority")

    def allowed(met: DataFrame) -> DataFrame:
        times = met.join(c.select(F.col("id").alias("i"), "published_at"), "i").join(r.select(F.col("id").alias("j"), "r_pub", "r_at"), "j")
        return times.filter(within(F.col("published_at"), F.col("r_pub"), F.col("r_at"), hours)).select(*met.columns)

    best = top_match(c.select("id", "doc"), r.select("id", "pos", "doc"), threshold, allowed)
    rows = best.join(c.drop("doc"), "id").join(r.select(F.col("id").alias("match_id"), "r_title", "r_prio"), "match_id")
    decision = (
        F.when(~guard(F.col("score"), F.col("title"), F.col("r_title"), least), "keep")
        .when(F.col("source_priority") > F.col("r_prio"), "replace")
        .otherwise("drop")
    )
    return rows.select(F.col("id").alias("original_index"), "match_id", "score", decision.alias("decision"))


def incident_duplicates(df: DataFrame, stored: DataFrame, hours: int) -> DataFrame:
    """Rows of df with a stored row of the same incident key within the window; replaced_id is left out of account."""
    s = stored.filter("incident_key is not null").select("incident_key", F.col("id").alias("s_id"), F.coalesce("published_at", "created_at").alias("s_at"))
    apart = F.abs(F.unix_micros("published_at") - F.unix_micros("s_at")) <= F.lit(hours * 3_600_000_000)
    on = (df["incident_key"] == s["incident_key"]) & F.coalesce(apart, F.lit(True)) & ~F.coalesce(F.col("replaced_id") == F.col("s_id"), F.lit(False))
    return df.join(s, on, "left_semi")


def insert_conflicts(df: DataFrame, articles: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """df with conflict_type: the first of canonical_url, content_hash, fingerprint that another article holds."""
    made, cols = df, []
    for key, table, id_col in (("canonical_url", articles, "id"), ("content_hash", articles, "id"), ("fingerprint", fingerprints, "article_id")):
        # two smallest ids of a key are enough to find one that is not the replaced row
        low = table.groupBy(key).agg(F.min(id_col).alias(f"_{key}0"), F.max(id_col).alias(f"_{key}1"))
        made = made.join(low, key, "left")
        other = F.col(f"_{key}0").isNotNull() & (
            F.col("replaced_id").isNull() | (F.col(f"_{key}0") != F.col("replaced_id")) | (F.col(f"_{key}1") != F.col("replaced_id"))
        )
        cols.append(F.when(other, key))
    return made.withColumn("conflict_type", F.coalesce(*cols)).drop(*[f"_{k}{i}" for k in ("canonical_url", "content_hash", "fingerprint") for i in (0, 1)])
