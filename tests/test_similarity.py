import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wirelark.functions.text import salient_terms
from wirelark.operators import tfidf
from wirelark.operators.graph import connected_components

STOP = set(tfidf.STOP)


def grams(doc):
    w = [x for x in re.findall(r"[^\W]{2,}", (doc or "").lower()) if x not in STOP]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def vectors(docs):
    tf = {k: Counter(grams(d)) for k, d in docs.items()}
    df = Counter(t for c in tf.values() for t in c)
    out = {}
    for k, c in tf.items():
        raw = {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1
        out[k] = {t: v / norm for t, v in raw.items()}
    return out


def dot(a, b):
    return sum(v * b.get(t, 0) for t, v in a.items())


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = {}
    for i in range(n):
        docs[i] = " ".join(r.choices(words, k=r.randint(0, 14))) if i % 3 or i == 0 else docs[i - 1] + " " + r.choice(words)
    docs[n] = ""
    return docs


def test_stop_list():
    assert len(STOP) == 318


@pytest.mark.parametrize("threshold", [0.34, 0.7])
def test_near_pairs_equal_brute_force(spark, threshold):
    docs = corpus(40, 1)
    v = vectors(docs)
    want = {(i, j): dot(v[i], v[j]) for i in docs for j in docs if i < j and dot(v[i], v[j]) >= threshold}
    got = tfidf.near_pairs(spark.createDataFrame(list(docs.items()), "id bigint, doc string"), threshold).collect()
    assert {(r.i, r.j) for r in got} == set(want)
    assert all(abs(r.score - want[r.i, r.j]) < 1e-9 for r in got)


def test_top_match_equals_brute_force(spark):
    docs = corpus(40, 2)
    cand = {k: d for k, d in docs.items() if k < 20}
    stored = {100 + k: d for k, d in docs.items() if k >= 20}
    v = vectors({k: d for k, d in cand.items() if d.strip()} | stored)
    want = {}
    for i, d in cand.items():
        if d.strip():
            s, p = max((round(dot(v[i], v[j]), 12), -j) for j in stored)
            if s >= 0.2:
                want[i] = (-p, s)
    got = tfidf.top_match(
        spark.createDataFrame(list(cand.items()), "id bigint, doc string"), spark.createDataFrame([(k, k, d) for k, d in stored.items()], "id bigint, pos bigint, doc string"), 0.2
    ).collect()
    assert {r.id for r in got} == set(want)
    assert all(abs(r.score - want[r.id][1]) < 1e-9 for r in got)


def test_topic_match_takes_the_best_that_shares_terms(spark):
    stored = [(1, 0, "ferry ledger stolen northgate", ["ferry", "ledger"]), (2, 1, "ferry ledger stolen northgate clinic", ["clinic", "roster"])]
    cand = [(7, "ferry ledger stolen northgate clinic", ["clinic", "roster"]), (8, "ferry ledger stolen northgate clinic", ["other"])]
    got = tfidf.topic_match(
        spark.createDataFrame(cand, "id bigint, doc string, terms array<string>"), spark.createDataFrame(stored, "id bigint, pos bigint, doc string, terms array<string>"), 0.1
    ).collect()
    assert [(r.id, r.match_id, r.shared) for r in got] == [(7, 2, ["clinic", "roster"])]
    v = vectors({0: cand[0][1], 1: stored[0][2], 2: stored[1][2]})
    assert abs(got[0].score - dot(v[0], v[2])) < 1e-9


def test_no_documents(spark):
    e = spark.createDataFrame([], "id bigint, doc string")
    assert tfidf.near_pairs(e, 0.3).count() == 0
    assert spark.createDataFrame([(None,)], "t string").select(salient_terms("t")).count() == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=16))
def test_components_equal_union_find(spark, edges):
    parent = list(range(13))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r.node: r.component for r in got.collect()} == want


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)], "src bigint, dst bigint")
    got = connected_components(e).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


def test_no_pair_below_the_threshold_is_written(spark, monkeypatch):
    """A frequent phrase in all documents pairs everything; what is staged and shuffled must not grow with those pairs."""
    docs = {i: f"common phrase everywhere own{i} mark{i} sign{i} story{i} item{i}" + (" twin tale told" if i in (3, 900) else "") for i in range(1000)}
    docs[900] = docs[3] + " more"
    rows = {}
    kept = tfidf.stage

    def counted(df, name, **by):
        made = kept(df, name, **by)
        rows[name] = rows.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(tfidf, "stage", counted)
    got = tfidf.near_pairs(spark.createDataFrame(list(docs.items()), "id bigint, doc string"), 0.5).collect()
    v = vectors(docs)
    assert [(r.i, r.j) for r in got] == [(3, 900)] and abs(got[0].score - dot(v[3], v[900])) < 1e-9
    assert max(rows.values()) <= len(docs), rows


@pytest.mark.parametrize("threshold", [0.1, 0.34, 0.7])
def test_blocks_give_what_one_block_gives(spark, monkeypatch, threshold):
    docs = corpus(40, 5)
    table = spark.createDataFrame(list(docs.items()), "id bigint, doc string")
    one = {(r.i, r.j): r.score for r in tfidf.near_pairs(table, threshold).collect()}
    monkeypatch.setattr(tfidf, "BLOCK_DOCS", 11)
    many = {(r.i, r.j): r.score for r in tfidf.near_pairs(table, threshold).collect()}
    v = vectors(docs)
    want = {(i, j): dot(v[i], v[j]) for i in docs for j in docs if i < j and dot(v[i], v[j]) >= threshold}
    assert set(one) == set(many) == set(want)
    assert all(abs(one[k] - want[k]) < 1e-9 and abs(many[k] - want[k]) < 1e-9 for k in want)


def test_topic_match_makes_no_row_of_a_shared_term(spark, monkeypatch):
    docs = corpus(40, 7)
    stored = {100 + k: d for k, d in docs.items() if k >= 20 and d}
    cand = {k: d for k, d in docs.items() if k < 20}
    want = {}
    for i, d in cand.items():
        v = vectors(stored | {i: d})
        s, p = max((round(dot(v[i], v[j]), 12), -j) for j in stored)
        if s >= 0.2:
            want[i] = (-p, s)
    monkeypatch.setattr(tfidf, "BLOCK_DOCS", 7)
    got = tfidf.topic_match(
        spark.createDataFrame([(k, d, ["a", "b"]) for k, d in cand.items()], "id bigint, doc string, terms array<string>"),
        spark.createDataFrame([(k, k, d, ["a", "b"]) for k, d in stored.items()], "id bigint, pos bigint, doc string, terms array<string>"), 0.2,
    )
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.match_id for r in got.collect()} == {i: m for i, (m, _) in want.items()}
    assert all(abs(r.score - want[r.id][1]) < 1e-9 for r in got.collect())
