"""Text and abstract of HTML pages. Parsing is the one step here that needs Python; it runs on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Results depend on them.
DROPPED = frozenset("script style noscript header footer nav form aside".split())
BOILERPLATE = frozenset("nav menu header footer promo advert advertisement ad share social cookie newsletter subscribe".split())
CONTENT = frozenset("article-body article-content entry-content post-content single-post-content td-post-content".split())
CONTENT_STARTS = ("entry-content", "post-content", "single-post-content", "td-post-content")
NEGATED = ("no-", "without-", "disable-", "disabled-")
SELECTORS = (".entry-content", ".post-content", ".single-post-content", ".td-post-content", "[itemprop=articleBody]", "article", "main")
NOISE = (
    r"\b(menu|news search|share on|write for us|comment|features|lifestyle|fashion|film|whatsapp|linkedin|advertisement|subscribe|"
    r"cookie policy|privacy policy|follow us|unlock left|cancel subscription|queue update required|flash plugin)\b"
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAST_CONTENT, MAX_BYTES = 400, 2_000_000
CONTENT_TYPES = ("text/html", "application/xhtml+xml", "text/plain", "application/xml", "text/xml")


def is_boilerplate(value: str) -> bool:
    """An id or class word that names furniture."""
    slug = re.sub(r"[^a-z0-9]+", "-", value.lower()).strip("-")
    if not slug or slug in CONTENT or slug.startswith(CONTENT_STARTS) or slug.startswith(NEGATED):
        return False
    return not BOILERPLATE.isdisjoint(slug.split("-"))


class _Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Tree(HTMLParser):
    """A lenient tree: an unknown end tag is ignored, an end tag closes what is open within its element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v for k, v in reversed(attrs)})
        self.open[-1].kids.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def _walk(node: _Node) -> Iterator[_Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [k for k in reversed(n.kids) if isinstance(k, _Node)]


def _prune(root: _Node) -> None:
    def furniture(n: _Node) -> bool:
        values = [n.attrs.get("id") or "", *(n.attrs.get("class") or "").split()]
        return n.tag in DROPPED or any(v and is_boilerplate(v) for v in values)

    for n in list(_walk(root)):
        n.kids = [k for k in n.kids if not (isinstance(k, _Node) and furniture(k))]


def _text(node: _Node) -> str:
    parts, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if s := n.strip():
                parts.append(s)
        else:
            stack += reversed(n.kids)
    return " ".join(parts)


def _fits(n: _Node, selector: str) -> bool:
    if selector[0] == ".":
        return selector[1:] in (n.attrs.get("class") or "").split()
    if selector[0] == "[":
        k, v = selector[1:-1].split("=")
        return n.attrs.get(k) == v
    return n.tag == selector


def page_text(html: str) -> tuple[str, list[str]]:
    """The text of a page, and the contents of its description tags in order of preference."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    meta = []
    for key, value in (("property", "og:description"), ("name", "description")):
        hit = next((n for n in _walk(tree.root) if n.tag == "meta" and n.attrs.get(key) == value), None)
        if hit is not None and hit.attrs.get("content"):
            meta.append(re.sub(r"\s+", " ", hit.attrs["content"].strip()))
    _prune(tree.root)
    nodes = [n for n in _walk(tree.root) if n.tag]
    chosen = None
    for s in SELECTORS:
        long = [t for n in nodes if _fits(n, s) and len(t := _text(n)) > LEAST_CONTENT]
        if long:
            chosen = max(long, key=len)
            break
    if chosen is None:
        chosen = _text(next((n for n in nodes if n.tag == "body"), tree.root))
    one = re.sub(r"\s+", " ", unescape(chosen)).strip()
    return re.sub(r"\s+", " ", re.sub(r"\bAdvertisement\b", "", one, flags=re.I)).strip(), meta


@F.pandas_udf(StructType([StructField("full_text", StringType()), StructField("meta", ArrayType(StringType()))]))
def _parsed(html: pd.Series) -> pd.DataFrame:
    made = [page_text(h) if h is not None else (None, []) for h in html]
    return pd.DataFrame({"full_text": [t for t, _ in made], "meta": [m for _, m in made]})


def noisy(sentence: Column) -> Column:
    return (
        sentence.rlike("(?iU)" + NOISE)
        | (F.regexp_count(sentence, F.lit(r"\|")) >= 2)
        | (F.regexp_count(sentence, F.lit(" 20")) >= 3)
        | (F.regexp_count(sentence, F.lit(",")) > 8)
    )


def meaningful(sentence: Column) -> Column:
    """40 characters, a word, and letters in 55 of 100 places."""
    letters = F.length(F.regexp_replace(sentence, r"[^\p{L}]", ""))
    return (F.length(sentence) >= 40) & sentence.rlike("[A-Za-z]{3,}") & (letters / F.greatest(F.length(sentence), F.lit(1)) >= 0.55)


def _stopped(s: Column) -> Column:
    return F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))


def clip_at_sentence(text: Column, most: int) -> Column:
    """Whole sentences that fit, else the first sentence that fits alone, else a cut at a blank after 40 characters."""
    sentences = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    state = F.struct(F.lit("").alias("t"), F.lit(False).alias("stop"))

    def step(acc: Column, s: Column) -> Column:
        longer = F.when(acc["t"] == "", s).otherwise(F.concat(acc["t"], F.lit(" "), s))
        fits = ~acc["stop"] & (F.length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(acc["t"]).alias("t"), (~fits).alias("stop"))

    kept = F.aggregate(sentences, state, step, lambda a: a["t"])
    single = F.get(F.filter(sentences, lambda s: F.length(s) <= most), 0)
    cut = F.regexp_replace(F.substring(text, 1, most), r"(?U)\s+$", "")
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    hard = F.when(F.contains(cut, F.lit(" ")) & (last >= 40), F.substring(cut, F.lit(1), last)).otherwise(cut)
    whole = F.when(kept != "", _stopped(kept)).when(single.isNotNull(), _stopped(single)).otherwise(hard)
    return F.when(F.length(text) <= most, text).otherwise(whole)


def abstract(text: Column, meta: Column, most: int = 420, sentences: int = 3) -> Column:
    """The first acceptable sentences, else the page's description."""
    all_ = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    kept = F.array_join(F.slice(F.filter(all_, lambda s: meaningful(s) & ~noisy(s)), 1, sentences), " ")
    return clip_at_sentence(F.when(kept != "", kept).otherwise(F.coalesce(meta, F.lit(""))), most)


def content_type_ok(c: Column) -> Column:
    """A missing header is allowed."""
    return c.isNull() | (c == "") | F.lower(c).rlike("|".join(x.replace("+", r"\+") for x in CONTENT_TYPES))


def extracted(pages: DataFrame, html: str = "html", most: int = 420, max_bytes: int = MAX_BYTES) -> DataFrame:
    """pages with full_text and abstract; both are null for pages that are null, too large or without text."""
    fit = F.when(F.octet_length(F.col(html)) <= max_bytes, F.col(html))
    made = pages.withColumn("_p", _parsed(fit))
    text = F.nullif(F.col("_p.full_text"), F.lit(""))
    meta = F.get(F.filter(F.col("_p.meta"), lambda m: (F.length(m) >= 50) & ~noisy(m)), 0)
    return made.withColumn("full_text", text).withColumn("abstract", F.when(text.isNotNull(), abstract(text, meta, most))).drop("_p")
