"""Problem 10: one form for texts that look alike but are written with different characters.

Method: a quick check isolates the unstable segments of a text (characters that another form replaces, combining marks,
invisible characters), each with the character before it as boundary context; only these are normalised, and the results
are spliced into the unchanged rest. A text without unstable characters is returned as it is; texts of plain ASCII never
leave the JVM.

Two forms. canonical() is for use as text: width and style forms and ligatures as plain letters, accents composed, all kinds
of blank as a space and of hyphen as "-", invisible characters dropped, and look-alike letters in the script of their word:
Latin in a word with Latin letters, Cyrillic (Greek, Armenian) in a word of that script, so that Russian text stays Russian.
A word of look-alikes alone has the script that most letters of the text have. skeleton() is for comparing: all look-alikes
are Latin, so that texts that read the same are equal whatever scripts they mix. Case, accents, digits, superscripts, dashes,
quotes and wording stay in both. A zero-width joiner or non-joiner stays where it shows: between emoji and within Arabic and
Indic words. Defined results: null stays null, empty stays empty; texts are used whole; both are idempotent, and the skeleton
of a canonical text is that of the text.
"""

from __future__ import annotations

import re
import unicodedata as u
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.session import stage

# Letters of other scripts that look like Latin ones, in pairs.
LOOKALIKE = (
    # Cyrillic
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԚQ ԜW ҮY ԌG ԀD аa еe оo рp сc уy хx ѕs іi јj ԛq ԝw һh ԁd ӏl ѵv үy ԌG ӀI "
    # Greek
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ αa ιi κk οo ρp υu νv ϲc ϳj "
    # Armenian, Cherokee and letters of the phonetic alphabet
    "օo սu հh ոn ցg զq ՕO ՍU ᎪA ᏴB ᏟC ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ ɑa ɡg"
)
INVISIBLE = frozenset(map(chr, (
    0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F),
    *range(0x2060, 0x2070), 0x3164, 0xFEFF, 0xFFA0, *range(0xFFF9, 0xFFFC),
)))
BLANKS = frozenset(map(chr, (0x9, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
HYPHENS = frozenset(map(chr, (0x2010, 0x2011, 0xFE63, 0xFF0D, 0x2043)))
_STYLES = ("<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<small>", "<vertical>")
#: Signs with a compatibility form of several signs that look different.
_KEEP = frozenset(map(chr, (0x2024, 0x2025, 0x2026, 0x2047, 0x2048, 0x2049)))


def _selector(o: int) -> bool:
    """A variation selector or a tag, none of which has a shape."""
    return 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0xE0000 <= o <= 0xE007F


@cache
def _tables() -> tuple[re.Pattern, dict[int, str], dict[int, str]]:
    """The pattern of unstable segments, the replacements before decomposition and the look-alikes after it."""
    like = {ord(p[0]): p[1] for p in LOOKALIKE.split()}
    first: dict[int, str] = {}
    unstable: list[int] = []
    for o in range(0x30000):
        c = chr(o)
        if 0x20 <= o < 0x7F or c == "\n" or 0xD800 <= o < 0xE000:
            continue
        if o in like:
            unstable.append(o)
            continue
        form = u.decomposition(c)
        if c in INVISIBLE or _selector(o):
            first[o] = ""
        elif c in BLANKS:
            first[o] = " "
        elif c in HYPHENS:
            first[o] = "-"
        elif form.startswith(_STYLES) and c not in _KEEP and u.category(c) != "Mn":
            one = chr(int(form.split()[1], 16))  # "…" in a vertical form is "…" too
            plain = one if one in _KEEP else u.normalize("NFKC", c)
            if plain.strip() or not c.strip():
                first[o] = plain
        d = u.normalize("NFD", first.get(o, c))
        if o in first or u.combining(c) or u.normalize("NFC", d.translate(like)) != c or 0x1160 <= o < 0x1200:
            unstable.append(o)
    for o in (*range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)):
        first[o] = ""
        unstable.append(o)
    first[0x0D] = ""
    unstable.append(0x0D)
    spans, k = [], 0
    unstable.sort()
    while k < len(unstable):
        j = k
        while j + 1 < len(unstable) and unstable[j + 1] == unstable[j] + 1:
            j += 1
        spans.append(f"\\U{unstable[k]:08x}-\\U{unstable[j]:08x}")
        k = j + 1
    return re.compile(f"(?s).?[{''.join(spans)}]+"), first, like


_EMOJI = "←-⯿〰〽\U0001f000-\U0001faff"
_JOINED = "[ؠ-ۿݐ-ݿࢠ-ࣿऀ-෿က-႟ក-៿]"
#: Joiners that show: between emoji, and between letters of scripts that join or stack.
_SHOWN = re.compile(f"(?<=[{_EMOJI}️])‍(?=[{_EMOJI}])|(?<={_JOINED})[‌‍](?={_JOINED})")


@cache
def _script(c: str) -> str:
    return u.name(c, "").split(" ")[0] if c.isalpha() else ""


@cache
def _scripts() -> tuple[re.Pattern, dict[str, dict[int, str]]]:
    """Look-alike letters, and for each other script what its look-alikes stand for among Latin letters."""
    back: dict[str, dict[int, str]] = {}
    for pair in LOOKALIKE.split():
        back.setdefault(_script(pair[0]), {}).setdefault(ord(pair[1]), pair[0])
    return re.compile(f"[{''.join(p[0] for p in LOOKALIKE.split())}]"), back


def _own_scripts(text: str) -> str:
    """text with each look-alike in the script of its word."""
    odd, back = _scripts()
    if not odd.search(text):
        return text
    like = _tables()[2]
    most = ""

    def settle(m: re.Match) -> str:
        nonlocal most
        w = m.group(0)
        if w.isascii() or not odd.search(w):
            return w
        sure = {_script(c) for c in w if ord(c) not in like} - {""}
        other = sure - {"LATIN"}
        if not sure:  # look-alikes alone
            if not most:
                seen = Counter(_script(c) for c in text if ord(c) not in like)
                seen.pop("", None)
                most = max(seen, key=lambda k: (seen[k], k == "LATIN", k)) if seen else "LATIN"
            return w if most == _script(w[0]) else w.translate(like)
        if len(other) != 1:
            return w.translate(like) if not other else w
        to = back.get(next(iter(other)), {})
        return w.translate(to) if all(ord(c) in to for c in w if _script(c) == "LATIN") else w

    return re.sub(r"[^\W\d_]+", settle, text)


def canonical(text: str | None) -> str | None:
    """The form for use as text."""
    if not text or text.isascii() and not ("\t" in text or "\r" in text):
        return text
    return u.normalize("NFC", _own_scripts(_settled(text, {})))


def skeleton(text: str | None) -> str | None:
    """The form for comparing."""
    return _settled(text, _tables()[2])


def _settled(text: str | None, like: dict[int, str]) -> str | None:
    if not text or text.isascii() and not ("\t" in text or "\r" in text):
        return text
    segment, first, _ = _tables()

    def settle(m: re.Match) -> str:
        return u.normalize("NFC", u.normalize("NFD", m.group(0).translate(first)).translate(like))

    if "\u200d" not in text and "\u200c" not in text:
        return segment.sub(settle, text)
    out, at = [], 0
    for m in _SHOWN.finditer(text):  # joiners that show stay; nothing composes across one
        out += [segment.sub(settle, text[at : m.start()]), m.group(0)]
        at = m.end()
    return "".join(out) + segment.sub(settle, text[at:])


def _formed(docs: DataFrame, id_col: str, text_col: str, form: Callable[[str | None], str | None], name: str) -> DataFrame:
    """id, text and the column name, made by form. Texts of plain ASCII are their own form and never leave the JVM."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    odd = F.coalesce(F.col("text").rlike(r"[^\x20-\x7e\n]"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([form(t) for t in b.column(1).to_pylist()], pa.string())
            yield pa.record_batch([b.column(0), b.column(1), made], names=["id", "text", name])

    slow = rows.filter(odd).mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string, {name} string")
    return rows.filter(~odd).withColumn(name, F.col("text")).unionByName(slow)


def canonical_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and canonical_text of every row."""
    return _formed(docs, id_col, text_col, canonical, "canonical_text")


def same_looking(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id_a, doc_id_b: pairs of different strings with one skeleton.

    Texts are read once and travel as hashes. Forms with one spelling alone, as exact copies have, are dropped before the join.
    """
    c = _formed(docs, id_col, text_col, skeleton, "form").filter(F.trim(F.col("form")).rlike(r"\S"))
    h = stage(c.select("id", F.md5("form").alias("form"), F.md5("text").alias("own")), "forms")
    many = h.groupBy("form").agg(F.min("own").alias("o1"), F.max("own").alias("o2")).filter("o1 <> o2").select("form")
    h = h.join(many, "form")
    a = h.select("form", F.col("id").alias("doc_id_a"), F.col("own").alias("own_a"))
    b = h.select("form", F.col("id").alias("doc_id_b"), F.col("own").alias("own_b"))
    return a.join(b, "form").filter("doc_id_a < doc_id_b and own_a <> own_b").select("doc_id_a", "doc_id_b")
