import base64
import os
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wirelark.llm import canon, encode, names, pack

BPE = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"
needs = pytest.mark.skipif(not os.path.exists(BPE), reason="no tokenizer files")


@pytest.fixture(scope="module")
def oracle():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "a", "Hello world's  end\n\n\tx", "aaaaaaaaaaaaaaaaaaaaaaaaa", "日本語 テスト", "naïve café 12345 $$$ <|endoftext|>", "é" * 500, "x" * 3000 + " y", "🚨👩‍💻"]


@needs
def test_encoding_equals_the_library(oracle):
    r = encode.Replay(BPE)
    assert r.encode(TEXTS + [None]).to_pylist() == [oracle.encode_ordinary(t) for t in TEXTS] + [[]]


@needs
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_encoding_any_text(oracle, texts):
    assert encode.Replay(BPE).encode(texts).to_pylist() == [oracle.encode_ordinary(t) for t in texts]


@needs
def test_encoding_round_trip_and_forgetting(spark, oracle, monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 1)
    df = spark.createDataFrame(list(enumerate(TEXTS + [None])), "doc_id bigint, text string").selectExpr("*", "1 as ids")
    got = {r.doc_id: r.ids for r in encode.encoded(df).collect()}
    assert [oracle.decode(got[i]) for i in range(len(TEXTS))] == TEXTS and got[len(TEXTS)] == []
    assert encode.encoded(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_windows_hold_their_items(sizes):
    at = pack.fill(sizes, 100)
    load = {}
    for s, w in zip(sizes, at):
        load[w] = load.get(w, 0) + s
    assert len(at) == len(sizes) and all(v <= 100 for v in load.values())


def test_windows_are_full():
    r = random.Random(1)
    sizes = [r.randint(1, 900) for _ in range(1500)]
    at = pack.fill(sizes, 2048)
    assert sum(sizes) / (2048 * (max(at) + 1)) > 0.97
    near = pack.differencing([4, 5, 6, 7, 8], 2)
    assert sorted(sum([4, 5, 6, 7, 8][k] for k in w) for w in near) == [14, 16]


def test_containers(spark):
    rows = [(i, n) for i, n in enumerate([5000, 2048, 4096, 0, None, 1, 1, 2047, 700, 700, 700])]
    got = pack.packed(spark.createDataFrame(rows, "doc_id bigint, n_tokens int"), shard=4).collect()
    load, parts = {}, {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.piece_no, r.n_tokens))
    assert all(v <= 2048 for v in load.values())
    assert {d: sum(n for _, n in p) for d, p in parts.items()} == {i: n or 0 for i, n in rows}
    assert [len(parts[i]) for i in range(11)] == [3, 1, 2, 1, 1, 1, 1, 1, 1, 1, 1]
    assert pack.packed(spark.createDataFrame([], "doc_id bigint, n_tokens int")).count() == 0


@pytest.mark.parametrize("n", [800, 900])
def test_windows_rise_one_by_one(n):
    r = random.Random(5)
    sizes = [r.randint(300, 2048) for _ in range(n)]
    m = max(1, -(-sum(sizes) // 2048))
    while max(sum(sizes[k] for k in w) for w in pack.differencing(sizes, m)) > 2048:
        m += 1
    assert max(pack.fill(sizes, 2048)) + 1 == m > 400


def test_full_pieces_share_no_container(spark):
    rows = [(1, 4200 * 8), (2, 8 * 5), (3, 7), (2**52, 24), (4, 4200 * 8 + 1)]
    got = pack.packed(spark.createDataFrame(rows, "doc_id bigint, n_tokens int"), capacity=8, shard=2).collect()
    whole = [r.container for r in got if r.n_tokens == 8]
    assert len(whole) == len(set(whole)) == 4200 + 5 + 3 + 4200 and max(whole) < 0
    assert len({(r.doc_id, r.piece_no) for r in got}) == len(got) and sum(r.n_tokens for r in got) == sum(n for _, n in rows)


SAME = [
    ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("ﬁne oﬃce", "fine office"), ("café", "café"), ("zero​width﻿", "zerowidth"), ("soft­hyphen", "softhyphen"), ("no break", "no break"),
    ("pаyрal", "paypal"), ("Ον", "Ov"), ("\U0001d400\U0001d5ba", "Aa"), ("non‑breaking", "non-breaking"), ("Ё", "Ë"), ("\U0002f800", "\u4e3d"), ("\U0002fa1d", "\U0002a600"), ("a\ufe50 b\ufe57", "a, b!"), ("\ufe35a\ufe36", "(a)"), ("a\ufe19", "a\u2026"), ("\ufe30", "\u2025"), ("ạ̇", "ạ̇"),
]
OTHER = [("a", "A"), ("e", "é"), ("x²", "x2"), ("a-b", "a—b"), ("1", "2"), ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb"), ("“a”", '"a"'), ("a b", "a  b"), ("и", "й"), ("か", "が")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_looking_texts_have_one_form(a, b):
    assert canon.skeleton(a) == canon.skeleton(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_visible_differences_stay(a, b):
    assert canon.skeleton(a) != canon.skeleton(b)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab ́̈eé​‍аａﬁ­ह्‌\U0001f469가\r\n"), max_size=14))
def test_canonical_form_is_stable_and_composed(text):
    once = canon.canonical(text)
    assert canon.canonical(once) == once and unicodedata.is_normalized("NFC", once)
    form = canon.skeleton(text)
    assert canon.skeleton(form) == form == canon.skeleton(once)


@pytest.mark.parametrize("text, form", [
    ("Москва, Россия", "Москва, Россия"), ("Мoсква", "Москва"), ("Αθήνα", "Αθήνα"), ("аpple рie", "apple pie"), ("The сор ran", "The cop ran"), ("Не все", "Не все"), ("\U0002f800", "\u4e3d"),
])
def test_words_keep_their_script(text, form):
    assert canon.canonical(text) == form and canon.skeleton(text) == canon.skeleton(form)


def test_pairs_of_same_looking_texts(spark):
    rows = [(1, "paypal"), (2, "pаypal"), (3, "paypal"), (4, "Paypal"), (5, None), (6, ""), (7, " "), (8, " "), (9, "​"), (10, "x" * 300_000 + " y"), (11, "x" * 300_000 + " y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' as form", "'c' as own")
    assert {(r.doc_id_a, r.doc_id_b) for r in canon.same_looking(df).collect()} == {(1, 2), (2, 3), (10, 11)}
    assert {r.id: r.canonical_text for r in canon.canonical_texts(df).collect()}[5] is None
    assert canon.same_looking(df.limit(0)).count() == 0


ORGS = [
    (1, "Baipruck Foods Ltd", "Fexsalt"), (2, "Bezkkond Insurance Inc", "Oak"), (3, "Beckkond Insurance Inc", "Oak"), (4, "Jameath General Hospital", "Jameath"),
    (5, "Ministry of Public Works of Cuwulm", "Cuwulm"), (6, "Harkjos & Jaivafeark Partners LLP", "Fasted"), (7, "University of Jameath", "Jameath"),
    (8, "Saint Thockzack Hospital", "Volothkar"), (9, "Rawusail School of Mines", "Rawusail"), (10, "Gaizupax Telecom Holdings Ltd", "Y"),
] + [(20 + i, f"{w} Foods Ltd", w) for i, w in enumerate(("Velmorat", "Quistan", "Drofenil", "Wakelow", "Zurmanth"))]
ORGS += [(100 * k + i, f.format(w), w) for k, f in enumerate(("Saint {} Hospital", "{} General Hospital", "University of {}", "{} Telecom Holdings Ltd", "{} School of Mines", "Ministry of Public Works of {}"), 1)
         for i, w in enumerate(("Abravenel", "Bostrikad", "Hymbalow", "Dorvangil", "Espinolk", "Fortunak"))]
MEANS = {
    "BAIPRUCK FOODS LTD": 1, "Baipruckfoods Ltd.": 1, "Foods Baipruck Limited": 1, "Biapruck Foods Ltd": 1, "the Baipruck Foods Ltd group": 1, "Baipruk_Foods": 1, "Baipruck Foods Ltd (Fexsalt)": 1,
    "St. Thockzack Hosp.": 8, "staff at Saint Thokzak Hospital": 8, "M.P.W.C.": 5, "Min. of Public Works of Cuwulm": 5, "Jaivafeark & Harkjos Partners LLP": 6, "Rawusail S. of M.": 9,
    "Jameath Gen Hospital": 4, "Univ of Jameath": 7, "Gaizupax Telecommunications Hldgs Limited": 10, "Bezkkond  Insurance": 2,
}
NONE = ["Baipruck Rowing Club", "Jameath", "customers of the portal", "Officials", "", " ", None, "Loklolt General Hospital", "Zoo of Cuwulm", "Unknown entity", "Bexkkond Insurance Inc"]


def test_spellings(spark):
    from pyspark.sql import functions as F

    rows = [(i, n) for i, n in enumerate([*MEANS, *NONE, "Baipruck Foods Ltd", "BAIPRUCK FOODS LTD"])]
    orgs = spark.createDataFrame(ORGS, "org_id bigint, org_name string, city string").withColumn("name", F.lit("clash"))
    df = spark.createDataFrame(rows, "id bigint, victim_name string").withColumn("org_id", F.lit(0))
    got = {r.id: r.org_id for r in names.linked(df, orgs).collect()}
    want = {i: MEANS[n] for i, n in rows if n in MEANS}
    assert got == want
    assert names.linked(df.limit(0), orgs).count() == 0 and names.linked(df, orgs.limit(0)).count() == 0


def test_initials_of_a_merged_spelling(spark):
    rows = [(1, "Velmorat Foods"), (2, "V.F."), (3, "Quistan Foods"), (4, "Q. F.")]
    orgs = spark.createDataFrame([o for o in ORGS if o[1] in {f"{w} Foods Ltd" for w in ("Velmorat", "Quistan", "Drofenil", "Wakelow", "Zurmanth", "Baipruck")}], "org_id bigint, org_name string, city string")
    df = spark.createDataFrame(rows, "id bigint, victim_name string")
    assert {r.id: r.org_id for r in names.linked(df, orgs).collect()} == {1: 20, 2: 20, 3: 21, 4: 21}


def test_names_that_no_rare_word_leads_to(spark):
    """Organisations of common words only, words joined and split, edits at both ends of a word, and long initials."""
    ends = ("Foods", "Telecom", "Shipping", "Textiles", "Robotics", "Airlines")
    names_ = [f"{w} {v} Ltd" for w in ("Northern", "Western", "Central", "Eastern", "Coastal", "Highland") for v in ends]
    names_ += ["Gaizupaxel Mining Ltd", "Baip Ruck Mining Ltd", "Amber Birch Cedar Dogwood Elder Fig Ginkgo Hazel Ivy Juniper"]
    orgs = spark.createDataFrame([(i, n, f"City{i}") for i, n in enumerate(names_)], "org_id bigint, org_name string, city string")
    means = {"NORTHERN FOODS LTD": 0, "Northern Fods Ltd": 0, "WesternTelecom Ltd": 7, "Higland Airlnes Ltd": 35, "Giazupaxle Mining Ltd": 36, "BaipRuck Minnig Ltd": 37, "A.B.C.D.E.F.G.H.I.J.": 38}
    rows = [(i, n) for i, n in enumerate([*means, "Northern", "Foods Ltd", "portal"])]
    df = spark.createDataFrame(rows, "id bigint, victim_name string")
    assert {r.id: r.org_id for r in names.linked(df, orgs).collect()} == {i: means[n] for i, n in rows if n in means}


def test_a_word_two_edits_away_does_not_stand_for_a_longer_name(spark):
    orgs = spark.createDataFrame([(1, "Forthas Energy Company", "Cazalt")] + [(10 + i, f"{w} Energy Company", w) for i, w in enumerate(("Velmorat", "Quistan", "Drofenil", "Wakelow", "Zurmanth"))], "org_id bigint, org_name string, city string")
    df = spark.createDataFrame([(1, "customers of the portal"), (2, "Fortas Energy Co")], "id bigint, victim_name string")
    assert {r.id: r.org_id for r in names.linked(df, orgs).collect()} == {2: 1}


def test_edits():
    assert names.edits("abc", "acb", 2) == 1 and names.edits("abc", "abc", 2) == 0 and names.edits("abc", "xyz", 2) == 3 and names.edits("ab", "abcde", 2) == 3
