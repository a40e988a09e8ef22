"""A query for each operator over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelark.functions import text, url
from wirelark.operators import classify, dedupe, html, route, store, tfidf, victim
from wirelark.operators.graph import connected_components
from wirelark.operators.ranges import within_hours
from wirelark.params import Params
from wirelark.plans.fold import fold_incidents
from wirelark.session import shared_dir, spread, stage, table
from wirelark.sources import feeds
from wirelark.streaming import runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2025-10-01 00:00:00"

# Parts of SQL that several queries share.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sq(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"


def _norm(c: str) -> str:
    return _sq(f"lower({c})")


def _sim(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), 'https?://[^\\s]+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


_SUFFIX = r"\s+-\s+[\pL\pN_ .,&''()]{2,80}$"


def _title(c: str) -> str:
    return f"regexp_replace({c}, '{_SUFFIX}', '')"


_ALIAS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in text.TOPIC_ALIASES.items()) + "}"


def _topic_list(c: str) -> str:
    return f"list_transform(string_split({_sim(c)}, ' '), lambda t: coalesce({_ALIAS}[t], t))"


def _salient(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in text.TOPIC_STOP)
    return f"list_distinct(list_filter({_topic_list(_title(c))}, lambda t: length(t) > 2 and not list_contains([{stop}], t)))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _ts(s: str) -> Column:
    return F.lit(s + "Z").cast("timestamp")


# ---------------------------------------------------------------- hash keys and exact duplicates


@query(f"""
    select encode_hash as content_hash, min(doc_id) as kept, count(*) as copies
    from (select doc_id, sha256({_norm('text')}) as encode_hash from documents where text is not null) group by 1
""")
def content_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    h = docs.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


@query(f"""
    with h as (select source, doc_id, sha256({_norm('text')}) as h from documents where text is not null),
         k as (select h, min(doc_id) as kept from h group by h)
    select source, count(*) as docs, count(k.kept) as kept from h left join k on h.doc_id = k.kept group by source
""")
def kept_per_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    h = docs.select("source", "doc_id", text.content_hash(F.col("text")).alias("h"))
    k = h.groupBy("h").agg(F.min("doc_id").alias("kept")).select("kept")
    return h.join(k, h["doc_id"] == k["kept"], "left").groupBy("source").agg(F.count("*").alias("docs"), F.count("kept").alias("kept"))


@query(f"""
    select id, sha256({_norm('article_text')}) as content_hash,
           sha256({_norm("title || ' ' || substring(article_text, 1, 3000)")}) as fingerprint from articles
""")
def hash_keys(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles")
    return a.select(
        "id", text.content_hash(F.col("article_text")).alias("content_hash"), text.fingerprint(F.col("title"), F.col("article_text")).alias("fingerprint")
    )


def _canon_ctes(source: str) -> str:
    """CTE q over a relation of original_index and url, with canonical_url in cu."""
    return rf"""
    cp as (
        select original_index, regexp_replace(regexp_replace(url, '^{_WS}+|{_WS}+$', '', 'g'), '[\t\r\n]', '', 'g') as u from {source}
    ),
    cs as (
        select original_index, '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?' as re, u from cp
    ),
    cq as (
        select original_index, coalesce(nullif(lower(regexp_extract(u, re, 1)), ''), 'https') as scheme, lower(regexp_extract(u, re, 2)) as host,
               regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, re, 3), ';[^/]*$', ''), '/+', '/', 'g'), '/$', '') as path,
               list_sort(list_filter(list_transform(string_split(regexp_extract(u, re, 4), '&'),
                   lambda x: [url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))]),
                   lambda x: x[2] <> '' and not list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid'], lower(x[1])))) as pairs
        from cs
    ),
    cu as (
        select original_index,
           case when host <> '' then scheme || '://' || host else scheme || ':' end || case when path = '' then '/' else path end
           || case when len(pairs) > 0 then '?' || list_aggregate(list_transform(pairs,
                lambda x: replace(url_encode(x[1]), '%20', '+') || '=' || replace(url_encode(x[2]), '%20', '+')), 'string_agg', '&') else '' end as canonical_url
        from cq
    )
    """


@query(f"with {_canon_ctes('listings')} select * from cu")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listings").select("original_index", url.canonicalize(F.col("url")).alias("canonical_url"))


@query("""
    select id, sha256(trim(regexp_replace(regexp_replace(lower(victim_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) || '|' ||
           trim(regexp_replace(regexp_replace(lower(attack_type), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))) as incident_key
    from articles
""")
def incident_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("id", text.incident_key(F.col("victim_name"), F.col("attack_type")).alias("incident_key"))


@query("""
    select original_index from candidates c where canonical_url is null
        or not exists (select 1 from articles a where a.canonical_url = c.canonical_url)
""")
def stored_url_anti(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.not_stored(table(spark, d, "candidates"), table(spark, d, "articles")).select("original_index")


@query("""
    select c.original_index, coalesce(h.id, f.id) as matched_id,
           case when h.id is not null then 'content_hash' when f.id is not null then 'fingerprint' end as reason
    from candidates c
    left join (select content_hash, min(id) as id from articles group by 1) h on h.content_hash = c.content_hash
    left join (select fingerprint, min(article_id) as id from article_fingerprints group by 1) f on f.fingerprint = c.fingerprint
""")
def stored_exact(spark: SparkSession, d: str) -> DataFrame:
    made = dedupe.stored_exact(table(spark, d, "candidates"), table(spark, d, "articles"), table(spark, d, "article_fingerprints"))
    return made.select("original_index", "matched_id", "reason")


@query("""
    with c as (select *, cast(null as bigint) as replaced_id from candidates)
    select original_index, case
        when exists (select 1 from articles a where a.canonical_url = c.canonical_url) then 'canonical_url'
        when exists (select 1 from articles a where a.content_hash = c.content_hash) then 'content_hash'
        when exists (select 1 from article_fingerprints f where f.fingerprint = c.fingerprint) then 'fingerprint' end as conflict_type
    from c
""")
def insert_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").withColumn("replaced_id", F.lit(None).cast("bigint"))
    made = dedupe.insert_conflicts(c, table(spark, d, "articles"), table(spark, d, "article_fingerprints"))
    return made.select("original_index", "conflict_type")


@query("""
    with k as (
        select original_index, 'canonical_url' as reason, min(original_index) over (partition by canonical_url) as first from candidates where canonical_url is not null
        union all select original_index, 'content_hash', min(original_index) over (partition by content_hash) from candidates where content_hash is not null
        union all select original_index, 'fingerprint', min(original_index) over (partition by fingerprint) from candidates where fingerprint is not null
    )
    select first as src, original_index as dst, reason from k where first < original_index
""")
def exact_edges(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.exact_edges(table(spark, d, "candidates"))


# ---------------------------------------------------------------- documents, terms, similarity


@query(f"""
    select id, concat_ws(' ', nullif({_sim(_title('title'))}, ''), nullif({_sim('abstract')}, ''),
           nullif({_sim('substring(article_text, 1, 4000)')}, '')) as doc from articles
""")
def similarity_docs(spark: SparkSession, d: str) -> DataFrame:
    a = spread(table(spark, d, "articles"))
    return a.select("id", text.similarity_document(F.col("title"), F.col("abstract"), F.col("article_text")).alias("doc"))


def _topic_sql(c: str) -> str:
    return f"nullif(array_to_string({_topic_list(c)}, ' '), '')"


@query(f"""
    select id, concat_ws(' ', t, t, a, x) as doc from (select id, {_topic_sql(_title('title'))} as t, {_topic_sql('abstract')} as a,
           {_topic_sql('substring(article_text, 1, 4000)')} as x from articles)
""")
def topic_docs(spark: SparkSession, d: str) -> DataFrame:
    a = spread(table(spark, d, "articles"))
    return a.select("id", text.topic_document(F.col("title"), F.col("abstract"), F.col("article_text")).alias("doc"))


@query(f"select id, list_sort({_salient('title')}) as terms from articles")
def salient_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("id", F.array_sort(text.salient_terms(F.col("title"))).alias("terms"))


@query(f"""
    with p as (select id, title, lag(title) over (partition by source_name order by id) as before from articles),
         t as (select id, {_salient('title')} as a, {_salient('before')} as b from p where before is not null),
         s as (select id, a, b, list_intersect(a, b) as c from t)
    select id, case when len(c) >= 2 or (len(c) > 0 and len(c) / len(list_distinct(list_concat(a, b))) >= 0.25) then list_sort(c) else [] end as shared from s
""")
def shared_terms(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source_name").orderBy("id")
    p = table(spark, d, "articles").select("id", "title", F.lag("title").over(w).alias("before")).filter("before is not null")
    return p.select("id", text.shared_terms(text.salient_terms(F.col("title")), text.salient_terms(F.col("before"))).alias("shared"))


def _entities(c: str) -> str:
    """The sorted names of a title, as in entity_terms."""
    head = f"case when contains({c}, ' - ') then regexp_extract({c}, '^(.*) - .*$', 1) else {c} end"
    known = ", ".join(f"'{k}'" for k in text.KNOWN_ENTITIES)
    bare = "trim(x, '.,:;!?()[]{}')"
    found = f"regexp_extract_all({head}, '\\b[A-Z][A-Za-z0-9&.-]{{2,}}\\b|\\b[A-Z]{{2,}}\\b')"
    kept = f"list_filter({found}, lambda x: length({bare}) > 2 and (upper(x) = x or regexp_matches(x[2:], '[A-Z]') or list_contains([{known}], lower({bare}))))"
    return f"list_sort(list_distinct(list_transform({kept}, lambda x: lower({bare}))))"


@query(r"""
    with t as (select id, regexp_extract_all(case when contains(title, ' - ') then regexp_extract(title, '^(.*) - .*$', 1) else title end,
                      '\b[A-Z][A-Za-z0-9&.-]{2,}\b|\b[A-Z]{2,}\b') as found from articles),
         k as (select id, list_filter(found, lambda x: length(trim(x, '.,:;!?()[]{}')) > 2 and (upper(x) = x or regexp_matches(x[2:], '[A-Z]')
                      or list_contains(['acme','cisa','deepseek','google','meta','microsoft','nso','openai','whatsapp'], lower(trim(x, '.,:;!?()[]{}'))))) as kept from t)
    select id, list_sort(list_distinct(list_transform(kept, lambda x: lower(trim(x, '.,:;!?()[]{}'))))) as terms from k
""")
def entity_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("id", F.array_sort(text.entity_terms(F.col("title"))).alias("terms"))


_STOP = ", ".join(f"'{w}'" for w in tfidf.STOP)


def _tf_sql(source: str) -> str:
    """CTEs w (words), tf, n, wt over a relation of id and doc."""
    return rf"""
        words as (select id, list_filter(regexp_extract_all(lower(doc), '[\pL\pN_]{{2,}}'), lambda x: not list_contains([{_STOP}], x)) as ws from {source}),
        terms as (select id, unnest(list_concat(ws, list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2]))) as term from words),
        tf as (select id, term, cast(count(*) as double) as tf from terms group by 1, 2),
        n as (select count(*) as n from {source}),
        dfs as (select term, count(*) as df from tf group by 1),
        raw as (select id, tf.term, tf * (ln((1 + n.n) / (1 + df)) + 1) as raw from tf join dfs using (term), n),
        norm as (select id, sqrt(sum(raw * raw)) as norm from raw group by 1),
        wt as (select id, term, raw / norm as w from raw join norm using (id))
    """


@query(f"with d as (select doc_id as id, text as doc from documents), {_tf_sql('d')} select id, count(*) as terms, round(max(w), 6) as top, round(sum(w), 4) as total from wt group by id")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("doc"))
    w = tfidf.weights(tfidf.counts(docs), docs.count())
    return w.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.max("w"), 6).alias("top"), F.round(F.sum("w"), 4).alias("total"))


_CDOC = f"""c as (select original_index as id, concat_ws(' ', nullif({_sim(_title('title'))}, ''), nullif({_sim('abstract')}, ''),
    nullif({_sim('substring(full_text, 1, 4000)')}, '')) as doc from candidates)"""


@query(f"""
    with {_CDOC}, {_tf_sql('c')}
    select a.id as i, b.id as j, round(sum(a.w * b.w), 6) as score from wt a join wt b on a.term = b.term and a.id < b.id
    group by 1, 2 having sum(a.w * b.w) >= 0.34
""")
def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = dedupe.candidate_columns(spread(table(spark, d, "candidates")))
    p = tfidf.near_pairs(c, 0.34, "original_index", "similarity_document")
    return p.select("i", "j", F.round("score", 6).alias("score"))


@query(f"""
    with {_CDOC},
    r as (select -1 - id as id, row_number() over (order by created_at desc, id desc) as pos, concat_ws(' ', nullif({_sim(_title('title'))}, ''),
          nullif({_sim('abstract')}, ''), nullif({_sim('substring(article_text, 1, 4000)')}, '')) as doc
          from (select * from articles order by created_at desc, id desc limit 500)),
    u as (select id, doc from c where trim(doc) <> '' union all select id, doc from r), {_tf_sql('u')},
    s as (select a.id as i, b.id as j, sum(a.w * b.w) as score from wt a join wt b on a.term = b.term and a.id >= 0 and b.id < 0
          group by 1, 2 having sum(a.w * b.w) >= 0.38),
    k as (select s.*, row_number() over (partition by i order by round(score, 9) desc, pos) as rn from s join r on r.id = s.j)
    select i as original_index, -1 - j as match_id, round(score, 6) as score from k where rn = 1
""")
def stored_top_match(spark: SparkSession, d: str) -> DataFrame:
    """The best of the 500 newest stored articles for every candidate."""
    c = dedupe.candidate_columns(spread(table(spark, d, "candidates")))
    r = dedupe.recents(spread(table(spark, d, "articles")), 500)
    stored = r.select((-1 - F.col("id")).alias("id"), "pos", text.similarity_document(F.col("title"), F.col("abstract"), F.col("article_text")).alias("doc"))
    m = tfidf.top_match(c.select(F.col("original_index").alias("id"), F.col("similarity_document").alias("doc")), stored, 0.38)
    return m.select(F.col("id").alias("original_index"), (-1 - F.col("match_id")).alias("match_id"), F.round("score", 6).alias("score"))


@query()
def stored_topic_match(spark: SparkSession, d: str) -> DataFrame:
    """The best of the 500 newest stored articles that shares title terms, each candidate in a corpus of its own."""
    c = dedupe.candidate_columns(spread(table(spark, d, "candidates")))
    cand = c.select(F.col("original_index").alias("id"), F.col("topic_document").alias("doc"), text.salient_terms(F.col("title")).alias("terms"))
    r = dedupe.recents(spread(table(spark, d, "articles")), 500)
    doc = text.topic_document(F.col("title"), F.col("abstract"), F.col("article_text"))
    return tfidf.topic_match(cand, r.select("id", "pos", doc.alias("doc"), text.salient_terms(F.col("title")).alias("terms")), 0.40)


def _prio_sql(name: str, link: str) -> str:
    h = rf"regexp_replace(lower(regexp_extract({link}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '')"
    one = lambda ds: rf"regexp_matches({h}, '(^|\.)({'|'.join(x.replace('.', chr(92) + '.') for x in ds)})$')"
    return f"case when {one(url.PRIMARY_DOMAINS)} then 3 when {one(url.REWRITE_DOMAINS)} then 0 when lower(trim({name})) in ('gdelt', 'google news') then 1 else 2 end"


@query(f"""
    with {_CDOC},
    r as (select -1 - id as id, row_number() over (order by created_at desc, id desc) as pos, title, published_at, created_at, {_prio_sql('source_name', 'url')} as prio,
          concat_ws(' ', nullif({_sim(_title('title'))}, ''), nullif({_sim('abstract')}, ''), nullif({_sim('substring(article_text, 1, 4000)')}, '')) as doc
          from (select * from articles order by created_at desc, id desc limit 500)),
    u as (select id, doc from c where trim(doc) <> '' union all select id, doc from r), {_tf_sql('u')},
    s as (select a.id as i, b.id as j, sum(a.w * b.w) as score from wt a join wt b on a.term = b.term and a.id >= 0 and b.id < 0
          group by 1, 2 having sum(a.w * b.w) >= 0.38),
    k as (select s.*, x.title as lt, r.title as rt, {_prio_sql('x.source_name', 'x.url')} as lp, r.prio as rp, row_number() over (partition by i order by round(score, 9) desc, pos) as rn
          from s join r on r.id = s.j join candidates x on x.original_index = s.i
          where coalesce(abs(epoch_us(x.published_at) - epoch_us(coalesce(r.published_at, r.created_at))) <= 172800000000, true)),
    g as (select *, list_intersect({_salient('lt')}, {_salient('rt')}) as shared_t, list_distinct(list_concat({_salient('lt')}, {_salient('rt')})) as all_t,
          list_intersect({_entities('lt')}, {_entities('rt')}) as shared_n from k where rn = 1)
    select i as original_index, -1 - j as match_id, round(score, 6) as score, case
        when not (score >= 0.40 or len(shared_t) >= 2 or (len(shared_t) > 0 and len(shared_t) / len(all_t) >= 0.25) or len(shared_n) > 0) then 'keep'
        when lp > rp then 'replace' else 'drop' end as decision from g
""")
def stored_near_decisions(spark: SparkSession, d: str) -> DataFrame:
    c = dedupe.candidate_columns(spread(table(spark, d, "candidates")))
    made = dedupe.stored_near(c, dedupe.recents(spread(table(spark, d, "articles")), 500), 0.38, 48)
    return made.withColumn("score", F.round("score", 6))


@query(f"""
    with recursive {_CDOC}, {_tf_sql('c')}, {_canon_ctes('candidates')},
    base as (select original_index as v, canonical_url as cu, sha256({_norm('full_text')}) as ch, sha256({_norm("title || ' ' || substring(full_text, 1, 3000)")}) as fp,
             published_at as ts, {_salient('title')} as terms, {_entities('title')} as ents, {_prio_sql('source_name', 'url')} as prio from (select * exclude (canonical_url) from candidates) join cu using (original_index)),
    keys as (select v, 'canonical_url' as reason, cu as k from base union all select v, 'content_hash', ch from base union all select v, 'fingerprint', fp from base),
    firsts as (select v, reason, min(v) over (partition by reason, k) as f from keys where k is not null),
    dots as (select a.id as i, b.id as j, sum(a.w * b.w) as score from wt a join wt b on a.term = b.term and a.id < b.id group by 1, 2 having sum(a.w * b.w) >= 0.34),
    near as (select i, j, score, list_intersect(x.terms, y.terms) as shared_t, list_distinct(list_concat(x.terms, y.terms)) as all_t, list_intersect(x.ents, y.ents) as shared_n
             from dots join base x on x.v = i join base y on y.v = j where coalesce(abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 172800000000, true)),
    edges as (select f as s, v as t, reason, cast(null as double) as score from firsts where f < v
              union all select i, j, 'near_similarity', score from near
              where score >= 0.40 or len(shared_t) >= 2 or (len(shared_t) > 0 and len(shared_t) / len(all_t) >= 0.25) or len(shared_n) > 0),
    sides as (select s as x, t as y from edges union select t, s from edges),
    reach(x, c) as (select distinct x, x from sides union select sides.y, reach.c from reach join sides on sides.x = reach.x),
    comp as (select x as v, min(c) as component from reach group by x),
    tags as (select component, string_agg(distinct reason, ',' order by reason) as reasons, max(score) as max_score from edges join comp on comp.v = edges.s group by 1),
    full_ as (select base.v, coalesce(component, base.v) as component, prio, ts from base left join comp using (v))
    select v as original_index, component, first_value(v) over (partition by component order by prio desc, ts desc nulls last, v) as survivor, reasons, round(max_score, 6) as max_score
    from full_ left join tags using (component)
""")
def current_run_survivors(spark: SparkSession, d: str) -> DataFrame:
    """All candidates as one run: groups of duplicates and the survivor of each."""
    c = stage(dedupe.candidate_columns(spread(table(spark, d, "candidates"))), "q-candidates")
    return dedupe.current_run(c, 0.34, 48).withColumn("max_score", F.round("max_score", 6))


@query("""
    with recursive k as (
        select original_index as v, 'u' || canonical_url as k from candidates where canonical_url is not null
        union all select original_index, 'h' || content_hash from candidates where content_hash is not null
        union all select original_index, 'f' || fingerprint from candidates where fingerprint is not null
    ),
    e as (select distinct a.v as x, b.v as y from k a join k b using (k) where a.v <> b.v),
    r(v, c) as (select distinct x, x from e union select e.y, r.c from r join e on e.x = r.v)
    select v as node, min(c) as component from r group by v
""")
def exact_components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(dedupe.exact_edges(table(spark, d, "candidates")))


# ---------------------------------------------------------------- times, orders, limits


@query(f"select original_index from listings where published_at is null or published_at >= timestamptz '{AS_OF}+00' - interval 168 hour")
def fresh_listings(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.fresh(table(spark, d, "listings"), _ts(AS_OF), 168).select("original_index")


@query("""
    select source_name, original_index from listings
    qualify row_number() over (partition by source_name order by original_index) <= 50
""")
def first_per_source(spark: SparkSession, d: str) -> DataFrame:
    return route.first_per_source(table(spark, d, "listings"), "source_name", "original_index", 50).select("source_name", "original_index")


@query("select id, row_number() over (order by created_at desc, id desc) - 1 as pos from articles order by created_at desc, id desc limit 500")
def recent_articles(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.recents(table(spark, d, "articles"), 500).select("id", F.col("pos").cast("bigint").alias("pos"))


@query("""
    select id from articles a where incident_key is not null and exists (
        select 1 from articles b where b.incident_key = a.incident_key and b.id <> a.id
        and (a.published_at is null or abs(epoch_us(a.published_at) - epoch_us(coalesce(b.published_at, b.created_at))) <= 172800000000))
""")
def incident_duplicates(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles")
    rows = a.select("id", "incident_key", "published_at", F.col("id").alias("replaced_id"))
    stored = a.select("id", "incident_key", F.col("published_at").alias("p"), "created_at").withColumnRenamed("p", "published_at")
    return dedupe.incident_duplicates(rows.select(F.col("id").alias("own"), "incident_key", F.col("published_at"), "replaced_id"), stored.select(
        "id", F.col("incident_key"), F.coalesce("published_at", "created_at").alias("created_at")).withColumn("published_at", F.lit(None).cast("timestamp")), 48
    ).select(F.col("own").alias("id"))


@query("""
    select c.original_index, count(*) as articles from candidates c join articles a
        on abs(epoch_us(c.published_at) - epoch_us(coalesce(a.published_at, a.created_at))) <= 6 * 3600000000 group by 1
""")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many stored articles are within six hours of a candidate."""
    c = table(spark, d, "candidates").select("original_index", F.col("published_at").alias("at")).filter("at is not null")
    a = table(spark, d, "articles").select(F.coalesce("published_at", "created_at").alias("ref"))
    return within_hours(c, a, "at", "ref", 6).groupBy("original_index").agg(F.count("*").alias("articles"))


@query()
def incident_fold(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").withColumn("at", F.coalesce("published_at", "created_at"))
    return fold_incidents(a, "incident_key", "at", "id", 48)


# ---------------------------------------------------------------- sources and URLs


@query("""
    select source_name, source_type, title, url, published_at from listings
    union all select source_name, source_type, title, url, published_at from candidates
""")
def union_of_sources(spark: SparkSession, d: str) -> DataFrame:
    cols = ["source_name", "source_type", "title", "url", "published_at"]
    return feeds.gather([lambda: table(spark, d, "listings").select(*cols), lambda: table(spark, d, "candidates").select(*cols)], spark)


@query()
def safe_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listings").select("original_index", url.is_safe(F.col("url")).alias("safe"))


@query("select original_index from listings where coalesce(title, '') <> '' and coalesce(url, '') <> ''")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listings").filter("coalesce(title, '') <> '' and coalesce(url, '') <> ''").select("original_index")


_HOST = r"regexp_replace(lower(regexp_extract(canonical_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '')"


@query(rf"""
    select id, {_HOST} as host, case
        when regexp_matches({_HOST}, '(^|\.)({'|'.join(x.replace('.', chr(92) + '.') for x in url.PRIMARY_DOMAINS)})$') then 3
        when regexp_matches({_HOST}, '(^|\.)({'|'.join(x.replace('.', chr(92) + '.') for x in url.REWRITE_DOMAINS)})$') then 0
        when lower(trim(source_name)) in ('gdelt', 'google news') then 1 else 2 end as priority from articles
""")
def source_priorities(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles")
    return a.select("id", url.host(F.col("canonical_url")).alias("host"), url.source_priority(F.col("source_name"), F.col("canonical_url")).alias("priority"))


# ---------------------------------------------------------------- classification and victims


def _lead_sql(c: str) -> str:
    return rf"substring(array_to_string(string_split(regexp_replace({c}, '([.!?]){_WS}+', '\1' || chr(31), 'g'), chr(31))[1:4], ' '), 1, 1500)"


def _re_sql(p: str) -> str:
    return "(?i)" + p.replace("'", "''")


def _score_sql(patterns: list[str], w: tuple[float, float, float]) -> str:
    parts = [f"case when regexp_matches({c}, '{_re_sql(p)}') then {x} else 0.0 end" for p in patterns for c, x in zip(("t", "l", "b"), w)]
    return " + ".join(f"cast({p} as double)" for p in parts)


_CLS = f"with a as (select id, title as t, {_lead_sql('article_text')} as l, substring(article_text, 1, 6000) as b from articles)"
_ATT = ", ".join(f"struct_pack(s := {_score_sql(p, (0.65, 0.3, 0.12))}, o := {-i}, n := '{n}')" for i, (n, p) in enumerate(classify.ATTACKS.items()))


@query(f"{_CLS}, m as (select id, list_max([{_ATT}]) as m from a) select id, round(least(m.s, 1.0), 6) as confidence, case when least(m.s, 1.0) >= 0.25 then m.n end as attack_type from m")
def attack_types(spark: SparkSession, d: str) -> DataFrame:
    a = classify.with_classification(spread(table(spark, d, "articles")).drop("attack_type", "article_type"), text="article_text")
    return a.select("id", F.round("attack_confidence", 6).alias("confidence"), "attack_type")


_GROUPS = {"incident": classify.INCIDENT, "campaign": classify.CAMPAIGN, "advisory": classify.ADVISORY, "press": classify.PRESS, "legal": classify.LEGAL, "opinion": classify.OPINION}


@query(f"{_CLS} select id, " + ", ".join(f"round(least({_score_sql(p, (0.5, 0.3, 0.2))}, 1.0), 6) as {k}" for k, p in _GROUPS.items()) + " from a")
def type_scores(spark: SparkSession, d: str) -> DataFrame:
    a = spread(table(spark, d, "articles")).select("id", F.col("title").alias("t"), text.lead(F.col("article_text")).alias("l"), F.substring("article_text", 1, 6000).alias("b"))
    return a.select("id", *[F.round(classify.pattern_score(p, F.col("t"), F.col("l"), F.col("b")), 6).alias(k) for k, p in _GROUPS.items()])


_SCOPE = " or ".join(f"regexp_matches(c4, '{_re_sql(p)}')" for p in classify.CYBER_SCOPE)
_OOS = " ".join(f"when regexp_matches(c2, '{_re_sql(p)}') then '{r}'" for r, p in classify.OUT_OF_SCOPE.items())
_CORPUS = "s as (select id, t || ' ' || l || ' ' || substring(b, 1, 4000) as c4, t || ' ' || l || ' ' || substring(b, 1, 2000) as c2 from a)"


@query(f"{_CLS}, {_CORPUS} select id, {_SCOPE} as in_scope, case {_OOS} end as explicit_reason from s")
def scope(spark: SparkSession, d: str) -> DataFrame:
    a = spread(table(spark, d, "articles")).select("id", F.col("title").alias("t"), text.lead(F.col("article_text")).alias("l"), F.substring("article_text", 1, 6000).alias("b"))
    t, l, b = F.col("t"), F.col("l"), F.col("b")
    return a.select("id", classify.in_scope(t, l, b).alias("in_scope"), classify.scope_reason(t, l, b).alias("explicit_reason"))


_RUNGS = """case when o is not null then 'out_of_scope' when not s then 'out_of_scope' when press >= 0.8 then 'press_release' when legal >= 0.8 then 'legal_followup'
    when advisory >= 0.8 and incident < 0.8 then 'advisory' when opinion >= 0.8 and incident < 0.8 then 'opinion' when incident >= 0.8 then 'incident'
    when campaign >= 0.7 then 'campaign_report' when advisory >= 0.6 then 'advisory' when legal >= 0.6 then 'legal_followup' when press >= 0.6 then 'press_release'
    else 'opinion' end"""


@query(f"{_CLS}, {_CORPUS}, g as (select a.id, case {_OOS} end as o, {_SCOPE} as s, " + ", ".join(f"least({_score_sql(p, (0.5, 0.3, 0.2))}, 1.0) as {k}" for k, p in _GROUPS.items()) + f" from a join s using (id)) select id, {_RUNGS} as article_type from g")
def article_types(spark: SparkSession, d: str) -> DataFrame:
    a = classify.with_classification(spread(table(spark, d, "articles")).drop("attack_type", "article_type"), text="article_text")
    return a.select("id", "article_type")


@query()
def classification_reasons(spark: SparkSession, d: str) -> DataFrame:
    a = classify.with_classification(spread(table(spark, d, "articles")).drop("attack_type", "article_type"), text="article_text")
    return a.select("id", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("articles"))


def _cue_sql(cues: list[str], c: str = "org_name") -> str:
    return " or ".join(f"contains(lower({c}), '{x}')" for x in cues)


def _kind_sql(c: str) -> str:
    rungs = " ".join(f"when {_cue_sql(x, c)} then '{k}'" for k, x in victim.CUES.items())
    return f"case {rungs} when regexp_matches({c}, '^\\p{{Lu}}[^\\s]*\\s+\\p{{Lu}}') then 'company' end"


def _words_sql(ws: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in ws)


_FOUND = ", ".join("regexp_extract_all({c}, '" + p.replace("'", "''") + "', 1)" for p in victim.PATTERNS)
_FOUND = _FOUND.replace("{2,80}", "{{2,80}}").replace("\\p{L}\\p{N}", "\\pL\\pN")
_NOISE = " ".join(f"when regexp_matches(name, '{x.replace('(?U)', '')}') then 'navigation_noise'" for x in victim.NOISE)
_EDGES = "^[ .,:;|-]+|[ .,:;|-]+$"


@query(f"""
    with a as (select id, title as t, substring(article_text, 1, {victim.BODY}) as b from articles),
    r as (select id, 1 as f, cast(0.65 as double) as w, flatten([{_FOUND.format(c='t')}]) as l from a
          union all select id, 2, cast(0.4 as double), flatten([{_FOUND.format(c='b')}]) from a),
    u as (select id, f, w, unnest(l) as raw, generate_subscripts(l, 1) as o from r),
    n as (select id, f, w, o, regexp_replace(regexp_replace(raw, '{_EDGES}', '', 'g'), '{_WS}+', ' ', 'g') as name from u),
    m as (select *, string_split(name, ' ') as ws from n where length(name) >= 3 and lower(name) not in ({_words_sql(victim.STOP)})),
    j as (select *, {_kind_sql('name')} as kind, case when len(ws) > 8 then 'too_many_words'
            when list_has_any(list_transform(ws, lambda x: lower(x)), [{_words_sql(victim.GENERIC)}]) then 'generic_entity'
            when list_has_any(list_transform(ws, lambda x: trim(lower(x), '.,:;')), [{_words_sql(victim.PRODUCTS)}]) then 'product_fragment'
            {_NOISE} when contains(name, ' - ') then 'dash_noise' when len(regexp_extract_all(name, '\\p{{Nd}}')) > 3 then 'digit_noise' end as noise from m),
    s as (select *, least(w + case when len(ws) between 2 and 8 then cast(0.15 as double) else 0 end + case when kind <> 'company' then cast(0.15 as double) else 0 end
            + case when len(list_filter(ws[1:2], lambda x: regexp_matches(x, '^\\p{{Lu}}'))) > 0 then cast(0.1 as double) else 0 end, 1.0) as score,
            regexp_replace(name, '{_EDGES}', '', 'g') as final from j),
    best as (select * from s where noise is null and kind is not null and length(final) >= 3
             qualify row_number() over (partition by id order by f, round(score, 9) desc, o) = 1),
    seen as (select id, bool_or(noise = 'generic_entity') as generic, bool_or(noise is not null) as noisy from s group by id)
    select a.id, final as victim_name, kind as victim_category, round(coalesce(score, 0.0), 6) as confidence,
        case when f = 1 then 'matched_title' when f = 2 then 'matched_body' when coalesce(generic, false) then 'generic_entity'
             when coalesce(noisy, false) then 'noisy_candidate' else 'no_named_org' end as reason
    from a left join best using (id) left join seen using (id)
""")
def victims(spark: SparkSession, d: str) -> DataFrame:
    a = victim.with_victim(spread(table(spark, d, "articles")).select("id", "title", "article_text"), text="article_text")
    return a.select("id", "victim.*").withColumn("confidence", F.round("confidence", 6))


@query("select org_id, case " + " ".join(f"when {_cue_sql(c)} then '{k}'" for k, c in victim.CUES.items()) + r" when regexp_matches(org_name, '^\p{Lu}[^\s]*\s+\p{Lu}') then 'company' end as category from organisations")
def org_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "organisations").select("org_id", victim.category(F.col("org_name")).alias("category"))


# ---------------------------------------------------------------- routing, alerts, digests


def _routed(spark: SparkSession, d: str) -> DataFrame:
    """Stored articles with the routing that their stored verdicts give."""
    a = table(spark, d, "articles").withColumn("attack", F.nullif("attack_type", F.lit("unknown")))
    sure = F.col("victim_name") != route.UNKNOWN_VICTIM
    return a.withColumns({
        "immediate": route.immediate(F.col("article_type"), F.col("attack"), sure),
        "routing_reason": route.routing_reason(F.col("article_type"), F.col("attack"), sure, F.lit(False)),
    })


_ROUTED = """
    r as (select *, article_type = 'incident' and attack_type <> 'unknown' and victim_name <> 'Unknown entity' as immediate,
        case when article_type <> 'incident' then article_type when attack_type = 'unknown' then 'out_of_taxonomy'
             when victim_name = 'Unknown entity' then 'low_victim_confidence' else 'qualified_incident' end as routing_reason from articles)
"""


@query(f"with {_ROUTED} select id, immediate, routing_reason from r")
def routing_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("id", "immediate", "routing_reason")


_DIGEST = f"""{_ROUTED},
    q as (select id, routing_reason = 'out_of_scope' as suppressed, routing_reason,
          case when routing_reason <> 'out_of_scope' then row_number() over (partition by routing_reason = 'out_of_scope' order by id) end as rn from r where not immediate)
"""


@query(f"""
    with {_DIGEST} select id, suppressed, case when rn <= 100 then 'queued' else 'skipped' end as status,
        case when suppressed or rn <= 100 then routing_reason else 'digest_overflow_or_disabled' end as digest_reason from q
""")
def digest_status(spark: SparkSession, d: str) -> DataFrame:
    made = route.with_digest_status(_routed(spark, d).filter("not immediate"), Params(), "id")
    return made.select("id", "suppressed", "status", "digest_reason")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    made = route.with_digest_status(_routed(spark, d).filter("not immediate"), Params(), "id").filter("status = 'queued'")
    victim_ = F.nullif("victim_name", F.lit(route.UNKNOWN_VICTIM))
    entry = route.digest_entry(F.col("title"), F.col("source_name"), F.col("attack"), victim_, text.iso_or_unknown(F.col("published_at")), F.col("url"))
    return made.withColumn("entry", entry)


_ISO = "coalesce(case when epoch_us(published_at) % 1000000 = 0 then strftime(published_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') else strftime(published_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%f+00:00') end, 'unknown')"
_ENTRY = f"""e as (select q.routing_reason, q.id, chr(10) || '- ' || title || chr(10) || '  Source: ' || source_name || chr(10) || '  Attack type: ' || attack_type
    || chr(10) || '  Victim: ' || case when victim_name = 'Unknown entity' then 'n/a' else victim_name end || chr(10) || '  Published date: ' || {_ISO}
    || chr(10) || '  Link: ' || url as entry from q join articles a using (id) where rn <= 100)"""


@query(f"""
    with {_DIGEST}, {_ENTRY} select routing_reason, count(*) as items,
        chr(10) || 'Reason: ' || routing_reason || ' (' || count(*) || ')' || chr(10) || string_agg(entry, chr(10) order by id) || chr(10) as block from e group by 1
""")
def digest_groups(spark: SparkSession, d: str) -> DataFrame:
    return route.digest_groups(_queue(spark, d), "id")


@query(f"""
    with {_DIGEST}, {_ENTRY}, g as (select routing_reason, count(*) as items,
        chr(10) || 'Reason: ' || routing_reason || ' (' || count(*) || ')' || chr(10) || string_agg(entry, chr(10) order by id) || chr(10) as block from e group by 1)
    select 'Cyber News Digest: ' || sum(items)::bigint || ' queued items' as subject,
        regexp_replace('Queued items by reason:' || chr(10) || chr(10) || string_agg(block, chr(10) order by routing_reason), '{_WS}+$', '') || chr(10) as body from g
""")
def digest(spark: SparkSession, d: str) -> DataFrame:
    return route.digest(_queue(spark, d), "id")


def _inline_sql(c: str, n: int) -> str:
    s = _sq(c)
    cut = f"substring({s}, 1, {n})"
    last = f"(length({cut}) - instr(reverse({cut}), ' '))"
    return f"case when length({s}) <= {n} then {s} when contains({cut}, ' ') and {last} >= 20 then substring({cut}, 1, {last}) else {cut} end"


@query(f"""
    select id, case when victim_category = 'company' then v else '[' || v || ']' end || ' was attacked using ' || t as subject,
        'Abstract:' || chr(10) || coalesce(nullif({_sq('abstract')}, ''), 'No abstract available.') || chr(10) || chr(10) || 'Attack type: ' || attack_type || chr(10)
        || 'Victim: ' || victim_name || chr(10) || 'Victim category: ' || victim_category || chr(10) || 'Source: ' || source_name || chr(10)
        || 'Published date: ' || {_ISO} || chr(10) || 'Article link: ' || url || chr(10) as body
    from (select *, {_inline_sql('victim_name', 120)} as v, {_inline_sql('attack_type', 80)} as t from articles)
""")
def alert_texts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "articles").select(
        "id",
        route.subject(c("victim_name"), c("victim_category"), c("attack_type")).alias("subject"),
        route.alert_body(c("abstract"), c("attack_type"), c("victim_name"), c("victim_category"), c("source_name"), c("published_at"), c("url")).alias("body"),
    )


@query(f"""
    with {_ROUTED} select id, 'Title: ' || title || chr(10) || 'Source: ' || source_name || chr(10) || 'Routing reason: ' || routing_reason || chr(10) || 'Attack type: '
        || attack_type || chr(10) || 'Victim: ' || victim_name || chr(10) || 'Published date: ' || {_ISO} || chr(10) || 'Article link: ' || url || chr(10) as body
    from r where not immediate
""")
def audit_bodies(spark: SparkSession, d: str) -> DataFrame:
    r = _routed(spark, d).filter("not immediate")
    c = F.col
    return r.select("id", route.audit_body(c("title"), c("source_name"), c("routing_reason"), c("attack_type"), c("victim_name"), c("published_at"), c("url")).alias("body"))


@query("""
    select count(*) as processed, count(*) filter (channel = 'immediate' and status = 'sent') as alerts_sent,
        cast(max(case when channel = 'digest' and status = 'sent' then 1 else 0 end) as bigint) as digest_sent,
        count(*) filter (channel = 'digest' and status in ('queued', 'sent', 'failed')) as digest_queued,
        count(*) filter (status = 'skipped') as skipped, count(*) filter (false) as errors from alerts
""")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "alerts").select("channel", "status", F.lit("accepted").alias("outcome"), (F.col("status") == "skipped").alias("suppressed"))
    return route.run_metrics(rows)


# ---------------------------------------------------------------- stored tables


@query(f"""
    with t as (select id from articles where created_at >= timestamptz '{AS_OF}+00' - interval 30 day)
    select (select count(*) from t) as articles_deleted, (select count(*) from article_fingerprints where article_id in (select id from t)) as article_fingerprints_deleted,
        (select count(*) from alerts where article_id in (select id from t)) as alerts_deleted
""")
def retention_counts(spark: SparkSession, d: str) -> DataFrame:
    made = store.retention_counts(table(spark, d, "articles"), table(spark, d, "article_fingerprints"), table(spark, d, "alerts"), _ts(AS_OF), 30)
    return made.withColumnRenamed("fingerprints_deleted", "article_fingerprints_deleted")


@query(f"""
    select 'articles' as name, id from articles where not created_at >= timestamptz '{AS_OF}+00' - interval 30 day
    union all select 'article_fingerprints', f.id from article_fingerprints f where not exists (select 1 from articles a where a.id = f.article_id and created_at >= timestamptz '{AS_OF}+00' - interval 30 day)
    union all select 'alerts', f.id from alerts f where not exists (select 1 from articles a where a.id = f.article_id and created_at >= timestamptz '{AS_OF}+00' - interval 30 day)
""")
def retention_delete(spark: SparkSession, d: str) -> DataFrame:
    names = ("articles", "article_fingerprints", "alerts")
    left = store.retention_delete(*[table(spark, d, n) for n in names], _ts(AS_OF), 30)
    a, f, l = [x.select(F.lit(n).alias("name"), "id") for n, x in zip(names, left)]
    return a.unionAll(f).unionAll(l)


@query("select id, title, url, created_at from articles where abstract ilike '%ransom%' or article_text ilike '%credential theft%' or abstract ilike '%credential theft%' or article_text ilike '%ransom%'")
def triage(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles")
    return store.triage(a, "ransom").unionByName(store.triage(a, "credential theft")).distinct()


_OVER = "c as (select original_index, batch_no, source_name, title, canonical_url, cast(case when batch_no = 1 then original_index % 50 + 1 end as bigint) as replaced_id from candidates qualify batch_no <> 1 or row_number() over (partition by batch_no, original_index % 50 order by original_index) = 1)"


@query(f"""
    with {_OVER} select id, coalesce(c.title, a.title) as title, coalesce(c.source_name, a.source_name) as source_name from articles a left join c on c.replaced_id = a.id
    union all select 10000000 + original_index, title, source_name from c where replaced_id is null
""")
def insert_or_replace(spark: SparkSession, d: str) -> DataFrame:
    """The first row of batch 1 for each of 50 articles replaces it; every other row is inserted.

    The SQL drops the other rows of batch 1, so that the two agree only where batch 1 has one row an article, as in sf0.01.
    """
    a = table(spark, d, "articles").select("id", "created_at", "title", "source_name")
    slot = F.col("original_index") % 50
    first = F.row_number().over(Window.partitionBy("batch_no", slot).orderBy("original_index"))
    c = table(spark, d, "candidates").withColumn("_r", first)
    c = c.withColumn("replaced_id", F.when((F.col("batch_no") == 1) & (F.col("_r") == 1), slot + 1).cast("bigint"))
    rows = c.select((F.lit(10000000) + F.col("original_index")).alias("id"), _ts(AS_OF).alias("created_at"), "title", "source_name", "replaced_id")
    return store.insert_or_replace(a, rows).select("id", "title", "source_name")


@query("select id, case when status = 'queued' then 'sent' else status end as status, case when status = 'queued' then null else error_message end as error_message, case when status = 'queued' then 'digest' else subject end as subject from alerts")
def alert_updates(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "alerts")
    none = F.lit(None).cast("string")
    changes = a.filter("status = 'queued'").select("id", F.lit("sent").alias("status"), none.alias("error_message"), F.lit("digest").alias("subject"), none.alias("body"))
    return store.update_alerts(a, changes).select("id", "status", "error_message", "subject")


# ---------------------------------------------------------------- pages


@query(f"""
    select id, nullif(trim(regexp_replace(regexp_replace({_sq("article_text")}, '(?i)\\bAdvertisement\\b', '', 'g'), ' +', ' ', 'g')), '') as full_text from articles
""")
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text of pages made of stored texts, furniture around them."""
    esc = F.replace(F.replace(F.col("article_text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    esc = F.replace(esc, F.lit("&amp;"), F.lit("&amp;amp;"))
    esc = F.replace(esc, F.lit("&lt;"), F.lit("&amp;lt;"))
    page = F.concat(F.lit("<html><body><nav>Menu</nav><div class='ad-box'>Buy</div><div>"), esc, F.lit("</div><footer>End</footer></body></html>"))
    pages = spread(table(spark, d, "articles")).select("id", page.alias("html"))
    return html.extracted(pages).select("id", "full_text")


@query()
def abstracts(spark: SparkSession, d: str) -> DataFrame:
    a = spread(table(spark, d, "articles"))
    return a.select("id", html.abstract(text.squeeze(F.col("article_text")), F.col("abstract")).alias("abstract"))


@query()
def full_run(spark: SparkSession, d: str) -> DataFrame:
    """A run over all candidates against the stored tables; every row's outcome."""
    from datetime import datetime

    from wirelark.plans.pipeline import Store, run

    c = table(spark, d, "candidates")
    listings = c.select("original_index", "source_name", "source_type", "title", "url", "published_at")
    pages = c.groupBy("url").agg(F.max(F.struct("original_index", "full_text", "abstract")).alias("p")).select("url", "p.full_text", "p.abstract")
    held = Store(table(spark, d, "articles"), table(spark, d, "article_fingerprints"), table(spark, d, "alerts"))
    done = run(listings, pages, held, datetime(2026, 1, 1), Params(max_article_age_hours=0))
    return done.outcomes


# ---------------------------------------------------------------- streams


def _streamed(spark: SparkSession, d: str, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over a table gives once it has read all of it; its rows go through a file sink."""
    schema = table(spark, d, name).schema
    made = make(spark.readStream.schema(schema).parquet(f"{d}/{name}.[p]arquet"))  # a pattern, since a plain path has to be a folder
    out = f"{shared_dir(spark)}/wirelark-stream-{uuid.uuid4().hex}"
    q = made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/rows")


@query("select distinct url from listings")
def stream_first_of_key(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, "listings", lambda s: runs.first_of_key(s.select("url"), "url"))


@query()
def stream_incidents(spark: SparkSession, d: str) -> DataFrame:
    """Articles by the time they were stored; the same rule as incident_fold over rows with a key."""
    return _streamed(spark, d, "articles", lambda s: runs.incidents(s, "incident_key", "created_at", "id", 48))


@query("select original_index from listings where published_at is null")
def stream_fresh(spark: SparkSession, d: str) -> DataFrame:
    """All stored times are older than the limit now, so rows without a time are what passes."""
    return _streamed(spark, d, "listings", lambda s: runs.fresh(s, "published_at", 1).select("original_index"))
