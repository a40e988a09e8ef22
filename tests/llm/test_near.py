import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wirelark.llm import best, history, near, pages
from wirelark.session import stage

from helpers import jaccard, shingles

T = datetime(2025, 5, 1)
WORDS = [f"wo{a}{b}" for a in "bcdfghklm" for b in "aeiou"]


def story(r, n=60):
    return ". ".join(" ".join(r.choices(WORDS, k=12)).capitalize() for _ in range(n // 12)) + "."


def edited(r, text, edits):
    w = text.split()
    for _ in range(edits):
        i = r.randrange(len(w))
        w[i : i + 1] = r.choice([[], [r.choice(WORDS)], [w[i], r.choice(WORDS)]])
    return " ".join(w)


def collection(seed, n=60):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        texts.append(edited(r, r.choice(texts), r.randint(0, 9)) if texts and r.random() < 0.6 else story(r))
    return texts + [None, "", "two words", "A clinic in Oakden said its system had been restored.", "a clinic in OAKDEN said, its system had been restored!"]


def plain_groups(texts, limit=0.5):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= limit:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def stored(spark, texts):
    rows = [(i, f"https://h.test/{i}", "S", t, "", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id bigint, url string, source_name string, article_text string, abstract string, toks string")


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    texts = collection(seed)
    got = {r.id: r.group_id for r in near.groups(stage(pages.story_sets(stored(spark, texts)), "t")).collect()}
    want = plain_groups(texts)
    sizes = {g: sum(1 for x in want.values() if x == g) for g in want.values()}
    assert got == {i: g for i, g in want.items() if sizes[g] > 1}


def test_one_text_that_half_of_all_rows_have(spark):
    r = random.Random(7)
    hot = story(r)
    texts = [hot] * 150 + [edited(r, hot, 2) for _ in range(50)] + [story(r) for _ in range(50)]
    got = near.groups(stage(pages.story_sets(stored(spark, texts)), "t")).collect()
    assert {x.id for x in got} == set(range(200)) and {x.group_id for x in got} == {0}


def test_pairs_and_empty_tables(spark):
    g = spark.createDataFrame([(1, 1), (2, 1), (5, 1), (7, 7)], "id bigint, group_id bigint")
    assert {(p.id_a, p.id_b) for p in near.pairs_of(g).collect()} == {(1, 2), (1, 5), (2, 5)}
    assert near.groups(stage(pages.story_sets(stored(spark, ["x"]).limit(0)), "t")).count() == 0


def test_pairs_of_a_group_of_many_blocks(spark):
    n = 3 * near.BLOCK + 7
    g = spark.range(n).selectExpr("id", "0L as group_id")
    p = near.pairs_of(g)
    assert p.count() == p.distinct().count() == n * (n - 1) // 2 and p.filter("id_a >= id_b").isEmpty()


def candidates(spark, rows):
    return spark.createDataFrame(rows, "original_index bigint, batch_no int, url string, title string, full_text string, source_name string")


def entries(spark, seed):
    r = random.Random(seed)
    texts = collection(seed, 30)
    arts = [(i, f"https://h.test/a{i}", "S", texts[i], "", f"Title {i}") for i in range(20)] + [(20, "https://h.test/tk", "S", "TKTK", "", "T")]
    cands = [
        (i, 1 + i // 8, r.choice([f"https://h.test/a{i}?utm_source=q", f"https://h.test/c{i}"]), f"Cand {i % 9}", (texts + texts[5:12])[20 + i] if i < 22 else "TKTK", "S") for i in range(24)
    ]
    return arts, cands


def plain_repeats(arts, cands):
    canon = lambda u: u.split("?")[0]
    norm = lambda t: None if t is None else " ".join(t.lower().split())
    seen = [(canon(u), norm(t) if t != "TKTK" else None, norm(f"{ti} {t[:3000]}") if t not in (None, "TKTK") else None, shingles(t) if t != "TKTK" else set()) for _, u, _, t, _, ti in arts]
    out = set()
    for i, _, u, ti, t, _ in sorted(cands, key=lambda c: (c[1], c[0])):
        me = (canon(u), norm(t), norm(f"{ti} {t[:3000]}") if t is not None else None, shingles(t))
        if any(me[0] == s[0] or any(me[k] is not None and me[k] == s[k] for k in (1, 2)) or me[3] and s[3] and jaccard(me[3], s[3]) >= 0.5 for s in seen):
            out.add(i)
        seen.append(me)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats_equal_brute_force(spark, seed):
    arts, cands = entries(spark, seed)
    a = spark.createDataFrame(arts, "id bigint, url string, source_name string, article_text string, abstract string, title string")
    got = {r.original_index for r in history.repeats(a, candidates(spark, cands), buckets=2).collect()}
    assert got == plain_repeats(arts, cands)


def test_batch_by_batch_gives_the_same(spark):
    arts, cands = entries(spark, 3)
    a = spark.createDataFrame(arts, "id bigint, url string, source_name string, article_text string, abstract string, title string")
    c = candidates(spark, cands)
    h = history.History(spark, buckets=2)
    h.append(history.article_entries(a))
    got = set()
    for b in sorted({x[1] for x in cands}):
        h.append(history.candidate_entries(c.filter(F.col("batch_no") == b)))
        got |= {r.id & ((1 << 44) - 1) for r in h.probe(b << 44).collect()}
    assert got == plain_repeats(arts, cands)


def test_texts_are_keyed_and_written_once(spark, monkeypatch):
    arts, cands = entries(spark, 3)
    a = spark.createDataFrame(arts, "id bigint, url string, source_name string, article_text string, abstract string, title string")
    c, names = candidates(spark, cands), []
    plan = history.candidate_entries(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan  # the pass that reads a text makes its keys
    monkeypatch.setattr(history, "stage", lambda df, name: (names.append(name), stage(df, name))[1])
    got = {r.original_index for r in history.repeats(a, c, buckets=2).collect()}
    assert got == plain_repeats(arts, cands)
    assert names.count("history-batch") == 1  # the stored entries are staged already


def test_text_keys_are_those_of_the_columns(spark):
    import pyarrow as pa

    from wirelark.functions import text

    odd = [None, "", " \n", "A  b\x1c\u00a0C", "ΟΔΟΣ ΣΑΣ", "İstanbul Straße", "𝒜 b" * 1100, "x" * 2999 + "Σ y", "x" * 2998 + " Σa", "a\u200bb\u2003c\x85d", "é" * 5000]
    rows = [(t, title) for t in odd for title in (None, "", " Ti  tle\t", "ΤΙΤΛΟΣ")]
    df = spark.createDataFrame(rows, "t string, title string").coalesce(1)
    want = df.select("t", "title", F.substring(text.content_hash("t"), 1, 32).alias("a"), F.substring(text.fingerprint(F.col("title"), F.col("t")), 1, 32).alias("b")).collect()
    got = history.text_keys(pa.array([r.t for r in want], pa.string()), pa.array([r.title for r in want], pa.string()))
    assert [x.to_pylist() for x in got] == [[r.a for r in want], [r.b for r in want]]


def test_sets_of_many_texts_are_those_of_each(monkeypatch):
    import numpy as np

    from wirelark.llm import sets

    texts = [None, "", "one", "one two", "one two three", "a b c d", "A_b c-d É ß", "İs ΣΑΣ x_y 3rd", "", *[t for t in collection(9) if t], "wo " * 9000, "end of it"]
    skip = np.array([i % 7 == 6 for i in range(len(texts))])
    m = sets.Maker()
    for many in (1, 40, sets.AT_ONCE):
        monkeypatch.setattr(sets, "AT_ONCE", many)
        got = dict(zip(sets.NAMES, (x.to_pylist() for x in m.arrays(texts, skip))))
        for i, t in enumerate(texts):
            three, four, words = m.grams("" if skip[i] else t or "")
            assert (got["n"][i], got["words"][i]) == (len(three), words)
            assert got["toks"][i] == three.astype(np.uint32).view(np.int32).tolist()
            assert got["keys"][i] == (m.keys(four).tolist() if len(three) else [])
            marked = {64 * j + k for j in range(16) for k in range(64) if got[f"b{j}"][i] >> (8 * (k // 8) + 7 - k % 8) & 1}
            assert marked == {int(x) & 1023 for x in three}


def hot_cell(spark, n, seed=5):
    """Entries that all share one key, numbers -n to n - 1; every tenth later one is near an earlier one. Also the numbers of these."""
    import numpy as np

    r = np.random.default_rng(seed)
    rows, true = [], set()
    for i in range(2 * n):
        toks = r.integers(-(2**31), 2**31, size=int(r.integers(100, 140)))
        if i > n and i % 10 == 0:
            toks = np.r_[np.array(rows[int(r.integers(0, i))][7])[9:], 1, 2, 3]
            true.add(i - n)
        bits = np.zeros(1024, dtype=np.uint8)
        bits[toks & 1023] = 1
        longs = np.packbits(bits).view(np.int64).tolist()
        rows.append((i - n, False, f"u{i}", f"t{i}", f"p{i}", len(toks), i, sorted(toks.tolist()), *longs, [7, 100 + i]))
    ddl = "seq bigint, residue boolean, url_key string, text_key string, print_key string, n int, set_hash bigint, toks array<int>, "
    return spark.createDataFrame(rows, ddl + ", ".join(f"b{i} bigint" for i in range(16)) + ", keys array<bigint>"), true


def test_pairs_of_a_cell_of_common_wording_are_never_rows(spark, monkeypatch):
    made, true = hot_cell(spark, 150)
    asked, compare, agreed = [], near.compare, getattr(near, "agreed", None)
    monkeypatch.setattr(near, "compare", lambda pairs, *a, **k: (asked.append(pairs.count()), compare(pairs, *a, **k))[1])
    if agreed:
        monkeypatch.setattr(near, "agreed", lambda met, *a, **k: (asked.append(met.count()), agreed(met, *a, **k))[1])
    for block, rows in ((history.BLOCK, 10_000), (16, 37)):
        monkeypatch.setattr(history, "BLOCK", block)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        h = history.History(spark, buckets=2)
        h.append(made.filter("seq < 0"))
        h.append(made.filter("seq >= 0"))
        got = {r.id for r in h.probe(0).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == true
    assert max(asked) <= 300  # of 33,675 pairs


@pytest.mark.parametrize("dense", [False, True])
def test_bounds_in_a_task_are_those_of_rows(spark, monkeypatch, dense):
    import pyarrow as pa

    monkeypatch.setattr(history, "CHUNK", 500 if dense else 10**6)
    monkeypatch.setattr(history, "SIDE", 33)
    made, _ = hot_cell(spark, 60)
    bits = [f"b{i}" for i in range(16)]
    e = made.selectExpr("seq as id", "n", *bits)
    kinds = e.filter("id < 40").selectExpr("id % 2 as key", "0 as block", "id", "false as query", "n", *bits)
    cells = kinds.unionByName(e.filter("id >= 0").selectExpr("id % 2 as key", "0 as block", "id", "true as query", "n", *bits))
    rows = pa.Table.from_pandas(cells.orderBy("key", "block", "id", F.desc("query")).toPandas()).combine_chunks().to_batches()[0]
    got = {(x, y) for b in history.possible(rows, 0.05) for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist())}
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("b.id") < F.col("a.id")) & (F.col("a.id") >= 0) & (F.col("b.id") < 40) & (F.col("a.id") % 2 == F.col("b.id") % 2))
    want = {(x, y) for x, y in pairs.filter(near.possible("a", "b", 0.05)).select("a.id", "b.id").collect()}
    assert got == want and 10 < len(want) < pairs.count()


def test_recall_of_the_keys_at_the_limit():
    import numpy as np

    from wirelark.llm.sets import Maker

    m, r, hit, n = Maker(), random.Random(11), 0, 0
    for _ in range(300):
        a = story(r, 240)
        b = edited(r, a, 26)
        x, y = (m.grams(t) for t in (a, b))
        j = len(np.intersect1d(x[0], y[0])) / len(np.union1d(x[0], y[0]))
        if j >= 0.5:
            n += 1
            hit += bool((m.keys(x[1]) == m.keys(y[1])).any())
    assert n > 50 and hit / n >= 0.95


def test_survivors(spark):
    g = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)], "id bigint, group_id bigint")
    day = lambda n: datetime(2025, 5, n)
    rows = [(1, "low", day(1), day(9)), (2, "top", datetime(1970, 1, 1), day(9)), (3, "top", day(20), day(9)), (8, None, None, day(9)), (9, "gone", None, None)]
    a = spark.createDataFrame(rows, "id bigint, source_name string, published_at timestamp, created_at timestamp")
    s = spark.createDataFrame([("low", 0), ("top", 3)], "source_name string, source_priority int")
    w = spark.createDataFrame([(1, 50), (2, 60), (3, 60), (8, 0), (9, 0)], "id bigint, words int")
    got = {(r.group_id, r.field_name, r.id) for r in best.survivors(g, a, s, w).collect()}
    assert got == {(1, "source_name", 2), (1, "article_text", 2), (1, "published_at", 1), (8, "source_name", 8), (8, "article_text", 8)}


def test_consensus_takes_the_value_nearest_to_the_vote(spark):
    base = "Clinic restores its booking system after nine days"
    values = [base, base.replace("nine", "ten"), base + " (report)", base.replace("Clinic", "The clinic"), None, " "]
    rows = [(i, v) for i, v in enumerate(values)] + [(100 + i, f"{base} {'x' * i}") for i in range(70)] + [(200, "Only"), (201, None)]
    g = spark.createDataFrame([(i, 1 if i < 200 else 2) for i, _ in rows], "id bigint, group_id bigint")
    got = {r.group_id: r.title for r in best.consensus(g, spark.createDataFrame(rows, "id bigint, title string"), "title").collect()}
    assert got[1].startswith(base) and got[2] == "Only"


def test_ties_of_the_consensus_go_to_the_frequent_then_the_smaller_value(spark):
    rows = [(1, "b c"), (2, "a c"), (3, "x y"), (4, "x z"), (5, "x z")]
    g = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 2)], "id bigint, group_id bigint")
    got = {r.group_id: r.title for r in best.consensus(g, spark.createDataFrame(rows, "id bigint, title string"), "title").collect()}
    assert got[2] == "x z" and got[1] in ("a c", "b c")
