import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wirelark.llm import body, pages, repeats, residue, tree
from wirelark.llm.blocks import blocks

STORY = "The clinic in Northgate said on Tuesday that its booking system had been restored from a clean copy."
SCHEMA = "id bigint, url string, source_name string, article_text string, abstract string, title string"


def flags(*texts, recurrent=None):
    hosts = residue.Hosts(pa.array(["h"] * len(texts)), pa.array([recurrent] * len(texts), pa.list_(pa.int64()))) if recurrent else None
    return residue.flags(pa.array(texts, pa.string()), hosts).tolist()


def key(line):
    return int(residue.line_keys(pa.array([line]))[0])


def test_tree_learns_its_table():
    x, y = body.labelled()
    assert ((tree.score(body.model(), x) >= 0.5) == y).mean() > 0.97


def test_tree_on_held_out_pages():
    page = (
        "Sections > Home > Policy\nWe use cookies. Accept all\nBy Ada Byron\n" + STORY + "\nHow the key was lost\n"
        "Two nurses noticed the fault on Monday and called the help desk at once.\n- reset every badge\nMost read\n1. Why the night train stops at every barn\n"
        "Village choir sings for the last time in its old hall\nCopyright 2022 The Bell. All rights reserved."
    )
    b, bad = body.furniture(pa.array([page]))
    assert bad.tolist() == [True, True, True, False, False, False, False, True, True, True, True]


def test_blocks_of_null_empty_and_long_texts():
    b = blocks(pa.array([None, "", "\n\n", "a\n\nb", "x " * 200_000], pa.string()))
    assert b.no.tolist() == [1, 1, 1, 2, 3, 1, 2, 3, 1] and b.full.sum() == 3
    assert body.main_texts(pa.array([None, "", STORY], pa.string())) == ["", "", STORY]


@pytest.mark.parametrize("text", [
    "Dear {{ first_name }},", STORY + " It was {% amount %} then.", STORY + "\nSaid [[SPOKESPERSON]] today.", "On ${date} we saw it.", "TKTK", "%%LEAD%%", "<%= body %>", "__headline__",
    "Page not found. The link may be old.", "503 Service Unavailable", "Please enable JavaScript to use a.test.", "Sign in to keep reading.", "lorem ipsum dolor", "null", "N/A",
    "Menu\nHome\n404 Not Found\nAll rights reserved", "We could not find the story you asked for (ab4ef655). It may have been removed by the editor.",
    "Back to top\nCould not load this page. Go back and try the link again in a few minutes from now.", "Menu\nThis is sample copy for the front page. Replace it with your own text before publishing.",
    "a.test is down for planned maintenance.", "Zugriff verweigert", "<AMOUNT here>", "[object Object]",
])
def test_residue(text):
    assert flags(text) == [True]


@pytest.mark.parametrize("text", [
    None, "", " \n", STORY, "The payload tried {{12*3}} in a form to see whether the engine would run it.", "A request with ${env:key} in its header was blocked by the old filter.",
    "Visitors saw a 404 page for nine hours, and the notice \"access denied\" stayed until Monday.", STORY + " [Continue]", "The reply was {\"status\": 3} from the ward of a clinic in Northgate.",
    "Menu\nHome\nSearch this site", STORY + "\nError 500",
])
def test_no_residue(text):
    assert flags(text) == [False]


FILL = "Lorem ipsum " + " ".join(f"quorn{'abcdefghijklmnopqrst'[i]}" for i in range(20)) + "."
LONG = [
    FILL, "Menu\nHome\n" + FILL + "\nAll rights reserved",
    "Please enable JavaScript in the settings of your browser and then load this page again, since a.test shows its stories with scripts that have to run first.",
    "404 Not Found. The page you asked for is gone. It may have moved to another place. Use the search or go back to the front page.",
    "at run (/srv/app/main.js:10:2) at load (/srv/app/load.js:33:9) at async start (/srv/app/start.js:7:1) at next (/srv/app/q.js:8:4) at each (/srv/app/q.js:9:4) at all (/srv/app/q.js:9:5) at end (/srv/app/q.js:9:6)",
]


@pytest.mark.parametrize("text", LONG)
def test_long_lines_of_evidence(text):
    assert max(len(x.split()) for x in text.split("\n")) > 20 and flags(text) == [True]


@pytest.mark.parametrize("text", [
    "Error 503 was all that visitors of the clinic in Northgate saw for nine hours on Monday, until the vendor had put a clean copy back.",
    "Page not found. " + STORY + " " + STORY, STORY + " Visitors saw a notice. Page not found. That was all for nine hours on Monday.",
    "Qwerty was again the most common of the nine million words in the leak that the clinic in Northgate reported on Monday to the police.",
])
def test_long_lines_of_stories(text):
    assert flags(text) == [False]


def test_boilerplate_of_a_host_is_subtracted():
    line = "Our readers in all nine districts can call the desk at any hour of the day."
    text = line + "\n503 Service Unavailable"
    assert flags(text) == [False]
    assert flags(text, recurrent=[key(line.replace("nine", "these"))]) == [True]
    assert flags(text, STORY + "\n503 Service Unavailable", recurrent=[key(line)]) == [True, False]


def test_keys_agree_with_spark(spark):
    lines = ["Tell a friend", "ÄÖ-ü 12", "12 !", "", " One two-three 4th four five six: seven eight, nine ten!", STORY]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(residue.line_key(F.col("x"))).collect()]
    assert [k or 0 for k in got] == [key(x) for x in lines]


def articles(spark, rows):
    return spark.createDataFrame([(i, f"https://h{i % 2}.test/{i}", "S", t, a, "x") for i, (t, a) in enumerate(rows)], SCHEMA)


def test_page_operators(spark):
    df = articles(spark, [(STORY + "\nAdvertisement\n\nMenu", "Menu"), ("TKTK", "Menu"), (None, None), (STORY, "Page not found."), ("", "")])
    assert {(r.id, r.field_name) for r in pages.residue_found(df).collect()} == {(1, "article_text"), (3, "abstract")}
    assert {(r.id, r.field_name, r.line_no) for r in pages.furniture_found(df).collect()} == {(0, "article_text", 2), (0, "article_text", 4), (0, "abstract", 1)}
    for f in (pages.residue_found, pages.furniture_found, pages.story_sets):
        assert f(df.limit(0)).count() == 0


def test_notices_by_counts(spark):
    said = "Nothing of this kind is held on our shelves under the mark that was given ({}). The clerks may have moved it."
    titles = ["Storm shuts road", "Choir sings again", "Bread gets dearer", "Lamp posts vanish", "Goats win prize", "Tram runs late"]
    rows = [(i, f"https://h{i % 3}.test/{i}", "S", "Menu\n" + said.format(f"a{i}f{i}"), None, t) for i, t in enumerate(titles)]
    # copies of one story under other titles, and one page alone
    copy = "The clerks of the city found the ledger of the harbour in a cellar and gave it back to the crew at once."
    rows += [(10 + i, f"https://h{i % 3}.test/x{i}", "S", copy, None, f"{t.split()[0]} at Larkfield") for i, t in enumerate(titles)]
    rows.append((30, "https://h1.test/y", "S", said.replace("clerks", "nurses"), None, "Once more"))
    df = spark.createDataFrame(rows, "id bigint, url string, source_name string, article_text string, abstract string, title string")
    assert {r.id for r in pages.residue_found(df).collect()} == set(range(6))
    assert {r.id for r in pages.story_sets(df).collect()} == {*range(10, 16), 30}
    assert {(r.id, r.line_no) for r in pages.furniture_found(df.union(df.limit(0))).collect()} == set()


def test_recurrent_lines(spark):
    df = articles(spark, [("Call the desk 1\n" + "x" * (i + 1) + STORY, "") for i in range(20)])
    got = {r.host: set(r["keys"]) for r in residue.recurrent_lines(df, "url", "article_text").collect()}
    assert got == {"h0.test": {key("call the desk")}, "h1.test": {key("call the desk")}}


def plain_repeats(rows, share=0.05, least=5):
    import re
    from collections import defaultdict

    docs, where = defaultdict(int), defaultdict(lambda: defaultdict(set))
    for i, s, t in rows:
        docs[s] += 1
        for n, line in enumerate((t or "").split("\n") if t is not None else [], 1):
            k = re.sub(r"[\W\d_]+", "", line.lower())
            if k:
                where[s][k].add((i, n))
    return {p for s in where for v in where[s].values() if len({i for i, _ in v}) >= max(least, share * docs[s]) for p in v}


def test_repeated_lines_equal_the_plain_rule(spark):
    r = np.random.default_rng(3)
    lines = ["Share this!", "share  THIS", "SHARE-this 12", "Back to top", "42", "", "Ein Wort", "ein wort.", "a", "once"]
    rows = [(i, ["A", "B", None][int(r.integers(3))], "\n".join(r.choice(lines, size=int(r.integers(0, 6))).tolist() + [f"unique {'y' * i}"])) for i in range(90)] + [(90, "A", None)]
    df = spark.createDataFrame(rows, "id bigint, source_name string, article_text string").withColumn("source", F.lit(1))
    got = repeats.repeated_lines(df, share=0.3).collect()
    assert {(x.id, x.line_no) for x in got} == plain_repeats(rows, 0.3) and len(got) == len(set(got))
    left = {x.id: x.text for x in repeats.without_lines(df, repeats.repeated_lines(df, share=0.3)).collect()}
    gone = plain_repeats(rows, 0.3)
    for i, _, t in rows:
        assert left[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in gone))
    assert repeats.repeated_lines(df.limit(0)).count() == 0


def test_templates_hold_the_variants_of_a_slot(spark):
    rows = [(i, "A", f"Tell the Example Courier desk about this {w} today, please!\nonce {'x' * i}") for i, w in enumerate("letter invoice ledger form badge note".split())]
    rows += [(9, "A", None), (10, None, "Tell the Example Courier desk about this map today, please!")]
    df = spark.createDataFrame(rows, "id bigint, source_name string, article_text string")
    assert repeats.repeated_lines(df).count() == 0
    assert [tuple(r) for r in repeats.templates(df).collect()] == [("A", "telltheexamplec<*>odayplease", 6)]
    assert {(r.id, r.line_no) for r in repeats.template_lines(df).collect()} == {(i, 1) for i in range(6)}
    assert repeats.templates(df.limit(0)).count() == 0
